"""Whole texts to token ids with the tokenizers library, each distinct piece of text encoded once per task.

The two byte-level vocabularies used here split a text before white space that follows anything else, and after a run of
letters that no apostrophe follows. Texts are cut at such places only, so the ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import cache

import numpy as np

#: A run of blanks and line feeds with the run of other characters after it.
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Any other white space; a text that holds some is encoded in one piece.
ODD_SPACE = re.compile(r"[^\S \n]")
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Stands before the first word of a text, which has no blank before it. White space, so no text that is cut holds it.
FIRST = "\r"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes lists of texts; remembers the ids of units seen lately (``most_units``, ``most_chars`` bound the memory).

    A unit is a word with the blank before it left out, or, if it starts with a line feed or ``FIRST``, as it stands.
    """

    def __init__(self, path: str, most_units: int = 1_000_000, most_chars: int = 24 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work to cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = self.tokenizer.normalizer is not None  # white space dropped, letters lower-cased
        self.bytes = _byte_letters()
        self.most_units, self.most_chars = most_units, most_chars
        self._reset()

    def _reset(self) -> None:
        self.ids, self.starts, self.sizes = array("I"), array("q"), array("i")
        self.known = _Numbered(self.starts, self.sizes)

    def _put(self, number: int, ids: list[int]) -> None:
        self.starts[number], self.sizes[number] = len(self.ids), len(ids)
        self.ids.extend(ids)

    def _learn(self, units: list[str]) -> None:
        known, tokenize, encode = self.known, self.tokenizer.model.tokenize, self.tokenizer.encode
        blank = "" if self.drops_space else "Ġ"

        def letters(word: str) -> list[int]:
            """A run of letters goes to the model as it is, in the alphabet of its bytes."""
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.bytes)
            return [t.id for t in tokenize(blank + word)]

        for unit in units:
            if unit.isascii() and unit.isalpha() or LATIN.fullmatch(unit):
                self._put(known[unit], letters(unit))
            elif unit[-1] in ".,;:!?" and LATIN.fullmatch(unit, 0, len(unit) - 1):
                base = unit[:-1]
                if not self.sizes[known[base]]:
                    self._put(known[base], letters(base))
                start, size = self.starts[known[base]], self.sizes[known[base]]
                self._put(known[unit], [*self.ids[start : start + size], *self._mark(unit[-1])])
            else:
                whole = unit[1:] if unit[0] == FIRST else unit if unit[0] == "\n" or self.drops_space else " " + unit
                self._put(known[unit], encode(whole, add_special_tokens=False).ids)
        known.fresh.clear()

    @cache  # noqa: B019
    def _mark(self, mark: str) -> list[int]:
        return self.tokenizer.encode(mark, add_special_tokens=False).ids

    def _units(self, text: str) -> list[str]:
        if ODD_SPACE.search(text):
            return [FIRST + text]
        if self.drops_space:
            try:
                text.encode("latin-1")
                return text.lower().split()
            except UnicodeEncodeError:
                return [FIRST + u for u in text.split()]
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return [u if u[0] == "\n" else FIRST + u for u in UNIT.findall(text)]
        units = text.replace("\n", " \n").split(" ")
        units[0] = FIRST + units[0]
        return units

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after another, each closed by ``end_id``, and how many each text has."""
        if len(self.known) > self.most_units or self.known.chars > self.most_chars:
            self._reset()
        numbers, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                units = self._units(text)
                counts[i] = len(units)
                numbers.append(np.fromiter(map(self.known.__getitem__, units), np.int32, len(units)))
        if self.known.fresh:
            self._learn(self.known.fresh[:])
        units = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        sizes = np.frombuffer(self.sizes, np.int32)[units] if len(units) else np.zeros(0, np.int32)
        before = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        lengths = before[bounds[1:]] - before[bounds[:-1]] + 1
        out = np.full(int(lengths.sum()), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(lengths) - 1] = False
        if len(units):
            out[keep] = gather(np.frombuffer(self.ids, np.uint32), np.frombuffer(self.starts, np.int64)[units], sizes)
        return out, lengths


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a vocabulary file; workers serve one task after another."""
    kept = sys.__dict__.setdefault("_tablevault_encoders", {})
    if path not in kept:
        kept.clear()
        kept[path] = Encoder(path)
    return kept[path]


class _Numbered(dict):
    """Numbers its keys as they come and makes room for their ids; ``fresh`` lists those that have none yet."""

    def __init__(self, starts: array, sizes: array):
        super().__init__()
        self.starts, self.sizes, self.fresh, self.chars = starts, sizes, [], 0

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self.starts)
        self.starts.append(0)
        self.sizes.append(0)
        self.fresh.append(unit)
        self.chars += len(unit)
        return n


def gather(store: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``store[start:start + size]``, one after another."""
    total = int(sizes.sum())
    if not total:
        return store[:0].copy()
    shift = starts - (np.cumsum(sizes) - sizes)
    return store[np.arange(total, dtype=np.int64) + np.repeat(shift, sizes)]
