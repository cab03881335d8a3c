"""Mixing against its contract: targets, nearness, limits, quotas, repeatability."""

from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from brute import MEDIUM

from tablevault.llm import mixing, registry


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), [s for s in names if sizes[s]]
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_} | {s: 0 for s in names if not sizes[s]}
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def check(rows, docs):
    source = defaultdict(int)
    for _, text, s in docs:
        source[s] += len(brute.words(text))
    want = brute_targets(source)
    of = Counter((d, len(brute.words(t)), source[s], round(want[s], 3)) for d, t, s in docs)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 3)) for r in rows) == of
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    by_target = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        t = by_target[(r["source_size"], r["target"])]
        t[0], t[1] = t[0] + r["taken"], max(t[1], r["size"])
    return by_target


def test_query(spark):
    query = registry.queries()["op1_mix_sources"]
    rows, again = query(spark, MEDIUM).collect(), query(spark, MEDIUM).collect()
    docs = [tuple(r) for r in registry.documents(spark, MEDIUM, "doc_id", "text", "source").collect()]
    for (_, target), (taken, largest, _) in check(rows, docs).items():
        assert abs(taken - target) <= largest
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_and_empty(spark, odd_documents, no_documents):
    planned = mixing.mix(odd_documents.withColumnRenamed("n_chars", "size").repartition(3))
    rows = [r.asDict() | {"taken": r["size"] * len(r["copies"])} for r in planned.collect()]
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in odd_documents.collect()])
    assert mixing.mix(no_documents).count() == 0
    assert mixing.mix(odd_documents.where("text = ''")).select("copies").first()[0] == []


def test_shards_get_exact_quotas(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "'a b c d' text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) source")
    planned = mixing.mix(docs, shard_words=10_000).cache()
    rows = mixing.mixed_rows(planned).select("shard", "doc_id", "epoch", "source", "position").collect()
    shards = Counter(r["shard"] for r in rows)
    assert len(shards) == 12 and max(shards.values()) < 1.3 * min(shards.values())
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows)
    hot = Counter(r["shard"] for r in rows if r["source"] == "hot")
    assert len(hot) == 12


def test_tree_walk_agrees_from_any_task():
    counts = np.array([1000, 0, 37, 250])
    whole = {s: (f.tolist(), c.tolist()) for s, f, c in mixing.split_quotas(counts, 11, range(11), 5)}
    parts = {s: (f.tolist(), c.tolist()) for lo in range(11) for s, f, c in mixing.split_quotas(counts, 11, range(lo, lo + 1), 5)}
    assert whole == parts
    assert np.array_equal(sum(np.array(c) for _, c in whole.values()), counts)
    at = np.zeros(4, int)
    for s in range(11):
        assert whole[s][0] == at.tolist() and sum(whole[s][1]) in (1287 // 11, 1287 // 11 + 1)
        at += whole[s][1]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"x": 0, "y": 7}, {"q": 4}])
def test_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    got = mixing.targets(np.array([sizes[s] for s in names], float), np.array([(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]), 1.5, 2.0)
    assert got == pytest.approx([brute_targets(sizes)[s] for s in names])
