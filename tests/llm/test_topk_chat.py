"""Top-k and perspective rotation against SQL and brute force."""

import math

import numpy as np
import pytest
from brute import MEDIUM
from compare import differences, duck

from tablevault.llm import chat, registry, topk


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(registry.queries()[name](spark, MEDIUM), duck(MEDIUM), registry.oracle_sql()[name]) is None


def brute_top(vectors, k):
    v = {i: [math.floor(256 * x) for x in e] for i, e in vectors}
    out = set()
    for q in (i for i in v if i % 50 == 0):
        scored = sorted(((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q))[:k]
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)}
    return out


@pytest.mark.parametrize("block,width", [(7, 3), (1000, 64)])
def test_blocks_of_any_size(spark, monkeypatch, block, width):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "DIMENSIONS", 2)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=width) * (20 if i % 9 == 0 else 1)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(30)]  # ties
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.to_integers(docs)
    assert {tuple(r) for r in topk.top_k(v, v.where("id % 50 = 0"), 5).collect()} == brute_top(rows, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [3.0]), (None, [1.0, 1.0]), (6, []), (7, [1e9, 1e7])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.to_integers(docs)
    got = [tuple(r) for r in topk.top_k(v, v.where("id % 50 = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 256 * 256 * (10**9 + 2 * 10**7)), (0, 2, 5, 256 * 256 * 3), (0, 3, 6, 0)]
    none = v.where("false")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(none, v).count() == 0


def test_rotation_of_odd_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE", 2)
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi 😀"), (1, 2, "bob", None), (1, None, None, "first"), (1, 5, "ann", "bye"), (1, 5, "ann", "bye"), (2, 0, "system", "alone"), (None, 1, "ann", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 piece", "2 start")
    out = chat.rotate(turns).collect()
    assert {(r["conv_id"], r["perspective"]) for r in out} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")} and len(out) == 19
    for key in {(r["conv_id"], r["perspective"]) for r in out}:
        mine = sorted((r for r in out if (r["conv_id"], r["perspective"]) == key), key=lambda r: r["start"])
        text = "".join(r["piece"] for r in mine)
        for r in mine:
            assert text[r["start"] : r["start"] + r["length"]] == r["piece"]
            if r["role"] == key[1]:
                assert text[r["mask_start"] : r["mask_end"]].endswith("<|im_end|>\n") and r["piece"].startswith("<|im_start|>assistant\n")
            else:
                assert r["mask_start"] is None
    assert chat.rotate(turns.where("false")).count() == 0


def test_every_row_of_a_repeated_query_id_is_searched(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [int(x) for x in rng.integers(-50, 50, 4)]) for i in [*range(40), 0, 0, 0, 7]]
    v = spark.createDataFrame(rows, "id long, v array<long>")
    got = [tuple(r) for r in topk.top_k(v, v.where("id % 50 = 0"), 5).orderBy("rank").collect()]
    scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for i, q in rows if i == 0 for j, c in rows if j != 0)
    assert got == [(0, r + 1, j, -s) for r, (s, j) in enumerate(scored[:5])]
