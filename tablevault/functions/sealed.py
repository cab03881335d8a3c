"""A digest of a table that also withstands someone who chooses its rows.

A plain sum of hashes can be forged: rows that change nothing in the sum are found by solving a small system. Here every row is expanded, under a
key, to a vector of 1,024 numbers of 16 bits, and vectors are added modulo 2^16. Finding another multiset of rows with the same sum
is a lattice problem of that dimension. The digest is still a sum: independent of order and layout, it counts copies, and the digest of
a new state is that of the old one plus rows added minus rows removed. It costs 64 SHA-256 for a row and stands beside the fast
fingerprint, which finds change and damage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablevault.functions.fingerprint import row_text

#: Numbers of a vector, numbers in one SHA-256, and what they are reckoned modulo.
LANES, LANES_OF_HASH, MODULUS = 1024, 16, 1 << 16
BLOCKS = LANES // LANES_OF_HASH
#: Rows whose vectors are added at once (2 KB each), and tasks of each core.
ROWS_ADDED, WAVES = 512, 2


def expand(text: bytes, key: bytes = b"") -> np.ndarray:
    """The vector of a row: SHA-256 of ``key:block:row`` for each block, in numbers of two bytes, larger one first."""
    hashed = b"".join(hashlib.sha256(b"%s:%d:%s" % (key, block, text)).digest() for block in range(BLOCKS))
    return np.frombuffer(hashed, ">u2").astype(np.int64)


def lanes(df: DataFrame, key: str = "") -> DataFrame:
    """``lane, value, row_count``: the vector of a table, a row for each of its numbers; ``row_count`` counts all rows. For columns of plain
    types. Rows are dealt evenly over the cluster first, for a row is small to read and dear to hash, and a file may come as few tasks. Tasks add
    up their rows, some at a time, and send one vector each, which are added with combination before the shuffle."""
    text = df.select(row_text(df).alias("text")).repartition(WAVES * df.sparkSession.sparkContext.defaultParallelism)
    prefixes = [f"{key}:{block}:".encode() for block in range(BLOCKS)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(LANES, np.int64), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), ROWS_ADDED):
                joined = b"".join([hashlib.sha256(p + t).digest() for t in texts[at : at + ROWS_ADDED] for p in prefixes])
                total += np.frombuffer(joined, ">u2").reshape(-1, LANES).sum(axis=0, dtype=np.int64)
            rows += batch.num_rows
            total %= MODULUS
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(LANES, dtype=np.int32)), pa.array(total), pa.array(np.full(LANES, rows))], names=["lane", "value", "row_count"]
            )

    vectors = text.mapInArrow(add, "lane int, value long, row_count long")
    # a row of zeros for each number, so that an empty table has a vector too
    zeros = df.sparkSession.range(0, LANES, 1, 1).select(F.col("id").cast("int").alias("lane"), F.lit(0).cast("bigint").alias("value"), F.lit(0).cast("bigint").alias("row_count"))
    both = vectors.unionByName(zeros).groupBy("lane").agg(F.sum("value").alias("value"), F.sum("row_count").alias("row_count"))
    return both.withColumn("value", F.pmod("value", F.lit(MODULUS)))


def combined(*parts: tuple[int, DataFrame]) -> DataFrame:
    """The vector of several, each with its sign: 1 for rows added, -1 for rows removed."""
    stacked = None
    for sign, part in parts:
        rows = part.select("lane", (F.col("value") * sign).alias("value"), (F.col("row_count") * sign).alias("row_count"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    summed = stacked.groupBy("lane").agg(F.sum("value").alias("value"), F.sum("row_count").alias("row_count"))
    return summed.withColumn("value", F.pmod("value", F.lit(MODULUS)))


def sealed_digest(vector: DataFrame) -> DataFrame:
    """One row ``(row_count, digest)``: SHA-256 over the numbers of a vector, in order, as text."""
    ordered = F.array_sort(F.collect_list(F.struct("lane", "value")))  # LANES entries
    found = vector.agg(F.max("row_count").alias("row_count"), ordered.alias("all"))
    return found.select("row_count", F.sha2(F.array_join(F.transform("all", lambda x: x["value"].cast("string")), ","), 256).alias("digest"))
