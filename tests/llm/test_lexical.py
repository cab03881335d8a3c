"""Ranked search against plain Python, its shared sums, and odd items and documents."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from brute import lower
from tablevault.llm import lexical
from tablevault.llm.lexical import ranked, share

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lower(text)) if text else []


def brute(docs, items, most=50):
    """docs and items as lists of (id, text)."""
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, words = sum(1 for _, c in tfs if c), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for i, wanted in asked.items():
        found = []
        for d, c in tfs:
            m = 50 + 50 * sum(c.values()) * n_docs // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out[i] = [(r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:most], 1)]
    return {(i, *x) for i, rows in out.items() for x in rows}


def check(spark, docs, items, most=50, **shape):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("class", F.lit(0))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")).withColumn("terms", F.lit(0))
    rows = ranked(d.repartition(3), q, most).collect()
    got = {tuple(r) for r in rows}
    assert got == brute(docs, items, most)
    return got


def some_words(rng, n):
    return " ".join(rng.choice("Alpha beta gamma DELTA eps zeta eta theta iota 42 é ß-x a_b".split()) for _ in range(n))


def test_ranks_and_ties(spark):
    rng = random.Random(5)
    docs = [(i, some_words(rng, rng.randint(0, 12))) for i in range(80)] + [(3, "alpha"), (900, "alpha"), (901, "ALPHA"), (None, "alpha beta"), (7, None), (8, "")]
    items = [(i, some_words(rng, rng.randint(1, 9))) for i in range(20)] + [(50, "alpha"), (51, "Alpha"), (52, "nowhere"), (53, None), (54, "..."), (None, "beta 42"), (50, "beta")]
    check(spark, docs, items, most=5)


def test_blocks_and_waves(spark, monkeypatch):
    """Many small waves, chunks and compactions give what one gives."""
    rng = random.Random(6)
    docs = [(i, some_words(rng, rng.randint(0, 12))) for i in range(60)]
    items = [(i, some_words(rng, rng.randint(1, 9))) for i in range(25)]
    for name, value in (("BLOCK_ITEMS", 4), ("WAVE_BYTES", 900), ("CELLS", 200), ("GATHERED", 10)):
        monkeypatch.setattr(lexical, name, value)
    check(spark, docs, items, most=3)


def test_nothing_to_search(spark):
    assert check(spark, [], [(1, "a")]) == set()
    assert check(spark, [(1, "a b")], []) == set()
    assert check(spark, [(1, None), (2, "--")], [(1, "a")]) == set()


def test_long_text_and_large_item(spark):
    long_text = " ".join(f"w{i % 5000}" for i in range(200_000))
    docs = [(i, some_words(random.Random(i), 5)) for i in range(9)] + [(100, long_text)]
    check(spark, docs, [(1, " ".join(f"w{i}" for i in range(3000))), (2, "w1 alpha")])


def test_shared_sums_are_the_sets():
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(40), rng.randint(1, 20))) for _ in range(30)] + [[0, 1, 2, 3]] * 3
    pairs, parts = share(sets, 40)
    assert pairs and sum(map(len, parts)) + len(pairs) < sum(map(len, sets))

    def leaves(node):
        return [node] if node < 40 else [x for p in pairs[node - 40] for x in leaves(p)]

    assert [sorted(x for n in p for x in leaves(n)) for p in parts] == sets
    assert all(a < 40 + k and b < 40 + k for k, (a, b) in enumerate(pairs))
    assert share([], 0) == ([], [])
