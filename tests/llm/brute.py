"""Plain Python versions of what the operators compute."""

import re
import zlib
from collections import Counter

import numpy as np

MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text, low=False):
    return WORD.findall((lower(text) if low else text) if text else "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def quality(text):
    w, text = words(text), text or ""
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n
