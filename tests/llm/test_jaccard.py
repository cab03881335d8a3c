"""Components against a brute-force join over all pairs."""

import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from brute import MEDIUM

from tablevault.llm import jaccard, registry


def brute_components(docs, width=4, percent=85):
    """docs: (doc_id, text) with distinct ids."""
    sets = {}
    for d, t in docs:
        w = brute.words(t, low=True)
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    have = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            have[x].add(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for o in have[x]:
                common[o] += 1
        for o, n in common.items():
            if o < d and 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                root[b] = a
    return {(d, len(sets[d]), find(d)) for d in sets}


def test_query(spark):
    rows = registry.queries()["op8_jaccard_join"](spark, MEDIUM).collect()
    docs = [tuple(r) for r in registry.documents(spark, MEDIUM, "doc_id", "text").collect()]
    assert {tuple(r) for r in rows} == brute_components(docs) and len(rows) == len(docs)


def near_copies(seed, groups, each, edits, words=60, passage=0):
    rng, out = random.Random(seed), []
    shared = [f"p{i}" for i in range(passage)]
    for g in range(groups):
        first = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(each):
            w = list(first)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            at = rng.randrange(words)
            out.append(" ".join(w[:at] + shared + w[at:]))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("frequent,around,docs", [
    (16, 64, near_copies(1, 12, 12, 3)),
    (2, 4, near_copies(2, 3, 40, 4)),
    (3, 64, near_copies(3, 60, 2, 1, words=30, passage=60)),
    (1, 3, near_copies(4, 25, 3, 1, words=12, passage=80)),
])
def test_near_copies_and_passages(spark, monkeypatch, frequent, around, docs):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "AROUND", around)
    if around < 64:  # many cells for each signature, no round before the last
        monkeypatch.setattr(jaccard, "CELL_SHINGLES", 500)
        monkeypatch.setattr(jaccard, "ROUNDS", 0)
    out = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {tuple(r) for r in out} == brute_components(docs)


def test_without_broadcast(spark, monkeypatch):
    docs = near_copies(5, 10, 5, 2)
    monkeypatch.setattr(jaccard, "SENT_ROWS", 0)
    out = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {tuple(r) for r in out} == brute_components(docs)


def test_odd_and_empty(spark, odd_documents, no_documents):
    rows = jaccard.jaccard_components(odd_documents.withColumnRenamed("lang", "h").repartition(3)).collect()
    ids = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == 13 and ids[6] == 5 and ids[5] == 5 and ids[0] == 0 and ids[1] == 1 and ids[None] is None
    assert {r["doc_id"] for r in rows if r["n_shingles"] == 0} == {0, 1, 2}
    assert jaccard.jaccard_components(no_documents).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (502, 501)], "u long, v long")
    got = {tuple(r) for r in jaccard.components(edges).collect()}
    assert got == {(i, 0) for i in range(201)} | {(500, 500), (501, 500), (502, 500)}


def settled_rows(monkeypatch):
    """Rows of each frame that the operator settles, by name."""
    rows, settle = defaultdict(list), jaccard.settle

    def counted(df, name):
        out = settle(df, name)
        rows[name].append(out.count())
        return out

    monkeypatch.setattr(jaccard, "settle", counted)
    return rows


def test_chance_passages_make_no_pairs(spark, monkeypatch):
    rng = random.Random(6)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [[] for _ in range(60)]
    for _ in range(40):  # each passage in three unlike texts
        passage = new(8)
        for t in rng.sample(texts, 3):
            t += [*new(5), *passage]
    docs = [(i, " ".join([*t, *new(60)])) for i, t in enumerate(texts)]
    docs.append((60, docs[7][1] + " and an end"))
    rows = settled_rows(monkeypatch)
    out = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {tuple(r) for r in out} == brute_components(docs)
    assert sum(rows["pairs"]) <= 20


def test_signatures_grow_with_texts(spark, monkeypatch):
    docs = near_copies(7, 10, 2, 3, words=60, passage=1000)
    rows = settled_rows(monkeypatch)
    out = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {tuple(r) for r in out} == brute_components(docs)
    assert rows["signatures"][0] <= sum(r["n_shingles"] for r in out)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_similar_sets_share_a_part(percent):
    rng = np.random.default_rng(8)
    for n in [*range(jaccard.spare_from(percent), 40), 150, 700, 2500]:
        for _ in range(20):
            lack = int(rng.integers(jaccard.spare(n, percent) + 1))
            gain = 0
            while 100 * (n - lack) >= percent * (n + gain + 1) and rng.random() < 0.97:
                gain += 1
            values = rng.integers(1 << 63, size=n + gain, dtype=np.uint64)
            one, other = values[:n], values[lack:]
            assert np.intersect1d(jaccard.part_signatures(one, n, percent), jaccard.part_signatures(other, len(other), percent)).size


def test_dense_groups_become_forests(spark, monkeypatch):
    rows = settled_rows(monkeypatch)
    edges = [(a, b) for a in range(60) for b in range(a)] + [(100 + a, 200 + b) for a in range(20) for b in range(20)]
    got = {tuple(r) for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(60)} | {(i, 100) for i in [*range(100, 120), *range(200, 220)]}
    assert max(rows["forest"]) == 59 + 39
