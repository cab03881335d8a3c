"""Phrases against plain Python; tries, spills and filters change no count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from brute import lower
from tablevault.llm import collocation
from tablevault.llm.collocation import Filter, Subtree, collocations, phrase_key


def brute(docs, longest=3, least=10, best=2000, overlap=50):
    """docs as (text, lang)."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(
                len(q) > len(p) and 100 * b >= overlap * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()
            ):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:best], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return out


def run(spark, docs, **options):
    df = spark.createDataFrame(docs, "text string, lang string").withColumn("phrase", F.lit("clash")).withColumn("a", F.lit(0)).withColumn("_cut", F.lit(0))
    rows = collocations(df.repartition(3), **options).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


def texts(seed, n, words="a B c dé e f the of x\x01 \xa0q".split(" ")):
    rng = random.Random(seed)
    return [
        ("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None, "und"]))
        for _ in range(n)
    ]


def test_against_brute_force(spark):
    docs = texts(1, 200) + [(None, "en"), ("", "fr"), (" \t.", None), ("one two three four", "xx")] + [("of the same text of the", "en")] * 30
    assert run(spark, docs) == brute(docs)
    assert run(spark, docs, best=7, least=3, overlap=80) == brute(docs, best=7, least=3, overlap=80)
    assert run(spark, docs, longest=2) == brute(docs, longest=2)


def test_spills_bursts_and_chunks_change_nothing(spark, monkeypatch):
    docs = texts(2, 150)
    for name, value in (("TOGETHER", 17), ("MOST_WORDS", 8)):
        monkeypatch.setattr(collocation, name, value)
    assert run(spark, docs, most=20, burst=4) == brute(docs)


def test_full_filter_changes_nothing(spark, monkeypatch):
    docs = texts(3, 100)
    monkeypatch.setattr(Filter, "has", lambda self, key: np.ones(len(key), bool))
    assert run(spark, docs) == brute(docs)


def test_filter_has_all_entries(spark):
    rows = [("en" if i % 2 else "fé", f"w{i} x{i % 7}") for i in range(3000)]
    level = spark.createDataFrame(rows, "lang string, phrase string")
    keys = np.array([r["k"] for r in level.select(phrase_key(F.col("lang"), F.col("phrase")).alias("k")).collect()], np.int64).view(np.uint64)
    found = Filter.of(level)
    assert found.has(keys).all()
    assert found.has(np.arange(10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.05
    assert not Filter.of(level.limit(0)).has(keys).any()


def test_keys_agree_with_spark(spark):
    words = collocation._Words()
    ids = np.array([words[w.encode()] for w in ("the", "café", "x" * 100)])
    key = np.full(1, collocation.xxhash.xxh64_intdigest(b"en", 42), np.uint64)
    for i in ids:
        key = collocation._then(key, words.hashes()[i : i + 1])
    want = spark.range(1).select(phrase_key(F.lit("en"), F.lit("the café " + "x" * 100)).alias("k")).first()["k"]
    assert key.view(np.int64)[0] == want


def test_subtree_counts():
    rng = np.random.default_rng(0)
    keys = (rng.zipf(1.3, 20_000) % 5000).astype(np.int64)
    tree, want = Subtree([0, 6, 12], 50), Counter(keys.tolist())
    assert sum(tree.add(k) for k in np.array_split(keys, 9)) == len(want) == len(tree)
    assert tree.children is not None
    got = tree.drain()
    assert dict(zip(got[0].tolist(), got[1].tolist())) == want and len(tree) == 0


def test_long_text_and_no_rows(spark):
    docs = [(" ".join(f"w{i % 300} common pair" for i in range(60_000)), "en"), ("common pair " * 3, None)]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == set()
