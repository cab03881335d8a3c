"""Language identification by held-out accuracy; scores against exact counts and a plain model."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from brute import MEDIUM

from pyspark.sql import functions as F

from tablevault.llm import language, registry, scoring


def crc(i):
    return zlib.crc32(str(i).encode()) if i is not None else 0


def test_language_query(spark):
    rows = {r["doc_id"]: r for r in registry.queries()["op2_language_id"](spark, MEDIUM).collect()}
    docs = registry.documents(spark, MEDIUM, "doc_id", "text", "lang").collect()
    assert set(rows) == {d[0] for d in docs}
    assert all(rows[d]["held_out"] == (crc(d) % 4 == 2) for d in rows)
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    held = [d for d in docs if rows[d[0]]["held_out"] and d[2]]
    right = sum(rows[d[0]]["lang_pred"] == d[2] for d in held)
    assert right >= 0.97 * len(held)


def test_language_of_odd_texts(spark, odd_documents, no_documents):
    model = language.fit(odd_documents)
    docs = odd_documents.withColumnRenamed("n_chars", "score")
    out = language.predict(docs, model).collect()
    assert len(out) == 13 and {r["lang_pred"] for r in out if r["doc_id"] in (0, 1, 2, -3)} == {"und"}
    assert all(r["lang_pred"] in ("en", "fr", "de") for r in out if r["doc_id"] in (3, 5, 6, 7, 8, 9, 10))
    assert language.predict(no_documents, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd_documents, language.fit(no_documents)).collect()} == {"und"}


def test_ngrams_are_those_of_each_text():
    texts = ["abc", "", None, "éa", "a" * 30]
    grams, counts = language.hashed_ngrams(texts)
    assert counts.tolist() == [sum(max(0, len(f" {t or ''} ") - n + 1) for n in language.LENGTHS) for t in texts]
    for t, part in zip(texts, np.split(grams, np.cumsum(counts)[:-1])):
        alone, _ = language.hashed_ngrams([t])
        assert alone.tolist() == part.tolist()


def expected(docs):
    """Exact base figures, and the model with true counts in place of the filter's."""
    tokens = {i: [*brute.words(t, low=True), None] for i, (d, t, h) in enumerate(docs)}
    train = Counter(w for i, (_, _, h) in enumerate(docs) if not h for w in tokens[i])
    n, v = sum(train.values()), len(train)
    out = []
    for i, (d, t, h) in enumerate(docs):
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens[i])
        out.append((d, h, len(tokens[i]), sum(train[w] > 0 for w in tokens[i]), n, base))
    return out


def same(rows, docs):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, rows), key=key), sorted(expected(docs), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


def test_score_query(spark):
    rows = registry.queries()["op5_bloom_scores"](spark, MEDIUM).collect()
    docs = [(r[0], r[1], crc(r[0]) % 7 == 2) for r in registry.documents(spark, MEDIUM, "doc_id", "text").collect()]
    same(rows, docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in rows)


def test_score_odd_and_empty(spark, odd_documents, no_documents):
    docs = odd_documents.withColumn("held_out", odd_documents.doc_id % 2 == 1)
    same(scoring.score(docs.repartition(3)).collect(), [(r[0], r[1], bool(r["held_out"])) for r in docs.collect()])
    assert scoring.score(no_documents.selectExpr("*", "false held_out")).count() == 0
    none = odd_documents.selectExpr("*", "true held_out")
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in scoring.score(none).collect()} == {(0, 0, 0.0)}


def test_filter_gives_counts_back(monkeypatch):
    rng = np.random.default_rng(1)
    grams, counts = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2), rng.zipf(1.5, 20_000).clip(2, 10_000)
    levels, lowest = scoring.level_of(counts), 2
    segment_bits = 1 << 10
    bits = np.zeros(scoring.SEGMENTS * segment_bits, bool)
    for j in range(lowest, levels.max() + 1):
        for i in range(scoring.PROBES):
            bits[scoring.probe_place(grams[levels >= j], j, i, segment_bits, True)] = True
    kept = scoring.BloomCounts(np.packbits(bits, bitorder="little"), lowest)
    got = kept.levels(grams)
    assert (got >= levels).all() and (got == levels).mean() > 0.98
    assert (kept.levels(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)) > 0).mean() < 0.02
    assert np.abs(scoring.count_of(scoring.level_of(np.arange(1, 1000))) / np.arange(1, 1000) - 1).max() < 0.5


def modelled(docs):
    """Scores of the model when every word and bigram from count 1 on is read at its own level, token by token."""
    tokens = [[*brute.words(t, low=True), None] for _, t, _ in docs]
    kept = [x for x, (_, _, h) in zip(tokens, docs) if not h]
    train, pairs = Counter(w for x in kept for w in x), Counter(p for x in kept for p in zip(["start", *x], x))
    n, like = sum(train.values()) + len(train) + 1, lambda c: float(scoring.count_of(scoring.level_of(np.array([c])))[0]) if c else 0.0
    out = []
    for x in tokens:
        chances = []
        for i, w in enumerate(x):
            context, both, single = like(train[x[i - 1]]) if i else len(kept), like(pairs[x[i - 1] if i else "start", w]), (like(train[w]) + 1) / n
            weight = scoring.LAMBDA if context else 0
            chances.append(math.log10(weight * both / max(context, both, 1) + (1 - weight) * single))
        out.append(sum(chances))
    return out


def test_filter_holds_all_ngrams_at_any_segment_bound(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 60).clip(1, 3000)) for _ in range(400)]
    docs = [(i, t, i % 7 == 2) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, held_out boolean")
    monkeypatch.setattr(scoring, "SEGMENT_GRAMS", 100)  # 256 segments
    got = []
    for bound in (1 << 30, 1):  # all in 16 buckets, a bucket for each segment
        monkeypatch.setattr(scoring, "BUCKET_GRAMS", bound)
        got.append({r["doc_id"]: r["score"] for r in scoring.score(frame).collect()})
    assert got[0] == got[1]
    want = dict(enumerate(modelled(docs)))
    close = [abs(got[0][i] - want[i]) < 1e-6 for i in want]
    assert np.mean(close) > 0.5 and max(abs(got[0][i] / want[i] - 1) for i in want) < 0.05  # one-sided errors of the filter
    trained = [i for i, _, held in docs if not held]
    assert np.mean([abs(got[0][i] / want[i] - 1) for i in trained]) < 0.002


def test_segments_follow_their_entries():
    rng = np.random.default_rng(5)
    grams, counts = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2)), rng.zipf(1.5, 50_000).clip(1, 10_000)
    sums = np.where(np.arange(len(grams)) % 4 > 0, counts[: len(grams)], 0)
    true = np.where(sums > 0, scoring.level_of(sums), 0)
    for deal in (0, 4, 9):
        levels = scoring.filter_levels(grams, sums, deal)
        assert (levels >= true).all() and (levels[sums > 0] == true[sums > 0]).mean() > 0.98 and (levels[sums == 0] > 0).mean() < 0.02


def test_repeated_ids_and_texts_are_sampled(spark):
    """Rows of one id, or of one text, neither vanish from the sample nor break its bound."""
    one_id = [(7, f"the house number {i} of them", "en") if i % 2 else (7, f"la maison numero {i} pour elle", "fr") for i in range(4000)]
    copies = [(i, f"der hund und die katze {i % 40}", "de") for i in range(3000)]
    rows = spark.createDataFrame(one_id + copies, "doc_id long, text string, lang string")
    model = language.fit(rows, sample=50)
    asked = spark.createDataFrame([("the number of them",), ("maison pour elle",), ("der hund und",)], "text string").withColumn("_letters", F.lit(1))
    got = language.predict(asked, model)
    assert got.columns == ["_letters", "lang_pred", "score"] or set(got.columns) >= {"_letters", "lang_pred"}
    assert sorted(r["lang_pred"] for r in got.collect()) == ["de", "en", "fr"]
