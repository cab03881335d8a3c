"""Feistel shards: permutation, places, odd rows, reruns over other partitions."""

import zlib

import pytest
from pyspark.sql import functions as F

from tablevault.llm import registry, sharding
from tablevault.llm.sharding import Permutation, row_at, shard_rows

MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 10, 1000, 4097])
@pytest.mark.parametrize("seed", [0, 17, 2**40 + 3])
def test_permutation_and_its_inverse(spark, n, seed):
    p = Permutation(n, seed)
    there = p.apply(spark.range(n), "id", "p")
    rows = p.apply(there, "p", "back", backwards=True).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)
    assert 0 <= p.outside <= p.sides[0]


def test_walks_longer_than_one_expression(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEPS", 1)
    n = 101  # sides 11 and 10: nine cells outside
    p = Permutation(n)
    assert p.outside == 9
    got = [r["p"] for r in p.apply(spark.range(n), "id", "p").collect()]
    monkeypatch.undo()
    assert sorted(got) == list(range(n))
    assert got == [r["p"] for r in p.apply(spark.range(n), "id", "p").collect()]


def test_order_is_mixed(spark):
    """Of a thousand neighbouring rows about as many lie in each shard, and neighbours are far apart."""
    rows = Permutation(100_000).apply(spark.range(100_000), "id", "p").orderBy("id").collect()
    p = [r["p"] for r in rows]
    for start in (0, 41_000):
        shares = [sum(x % 24 == s for x in p[start : start + 2400]) for s in range(24)]
        assert 60 < min(shares) and max(shares) < 145
    assert sum(abs(a - b) for a, b in zip(p, p[1:])) / len(p) > 30_000


def test_shards_of_odd_documents(spark, odd_documents, no_documents):
    docs = odd_documents.withColumn("SHARD", F.lit("mine")).withColumn("_row", F.lit(1)).withColumn("_p", F.lit(2)).withColumn("_part", F.lit(3))
    got = shard_rows(docs, 5).collect()
    assert [c for c in docs.columns if c != "SHARD"] == list(got[0].asDict())[:-3]
    assert len(got) == docs.count() and {r["_row"] for r in got} == {1}
    shards = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(5)}
    assert all(v == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert sorted(r["row_number"] for r in got) == list(range(len(got)))
    by_number = sorted(got, key=lambda r: r["row_number"])
    assert [r["doc_id"] for r in by_number] == sorted((r["doc_id"] for r in got), key=lambda v: (v is not None, v or 0))
    assert shard_rows(no_documents, 24).collect() == []
    with pytest.raises(ValueError):
        shard_rows(docs, 0)


def test_same_places_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_rows(docs, 24).collect()}
    other = shard_rows(docs.repartition(13, F.rand(3)), 24)
    assert one == {r["doc_id"]: (r["shard"], r["slot"]) for r in other.collect()}
    assert one != {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_rows(docs, 24, seed=18).collect()}
    asked = spark.createDataFrame([(s, i) for s in range(24) for i in range(5)], "shard int, slot long")
    found = {(r["shard"], r["slot"]): r["row_number"] for r in row_at(asked, len(one), 24).collect()}
    assert found == {(r["shard"], r["slot"]): r["row_number"] for r in other.where("slot < 5").collect()}


def test_many_equal_rows_fill_many_ranges(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = shard_rows(docs.repartition(4), 24).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(24) for i in range(125)]


def test_query(spark):
    got = registry.queries()["op11_feistel_shards"](spark, MEDIUM).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
