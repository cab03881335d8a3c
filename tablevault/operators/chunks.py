"""Content-addressed chunks: the rows of a table in ranges of their fingerprint, each named by what it holds.

A chunk's name follows from the table's columns, the range and the digest of its rows, so equal rows have equal names in every backup. A full
backup finds the names of its chunks in one narrow pass, looks them up among those that the vault holds, and writes the
rows of the others only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablevault.functions.fingerprint import FINGERPRINT, H1, LEN, digest_columns, with_fingerprint
from tablevault.operators.delta import bounded_broadcast

#: Bytes of source for a chunk at best, chunks of a table at least and at most (as powers of two), raw bytes of a file.
CHUNK_BYTES, FEWEST_BITS, MOST_BITS, FILE_BYTES = 32 << 20, 4, 20, 128 << 20
BAND, NAME = "_tv_band", "chunk"


def chunk_bits(df: DataFrame) -> int:
    """For a table that has no chunks yet."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = FEWEST_BITS
    while bits < MOST_BITS and size > CHUNK_BYTES << bits:
        bits += 1
    return bits


def band(bits: int) -> Column:
    return F.shiftrightunsigned(H1, 64 - bits).cast("int")


def chunk_names(df: DataFrame, bits: int) -> DataFrame:
    """``band, name, row_count, digest1, digest2, raw_size`` of the chunks of a table, at most 2 ** MOST_BITS rows; rows are combined before they move."""
    raw = F.coalesce(F.sum(LEN), F.lit(0)).cast("bigint").alias("raw_size")
    found = with_fingerprint(df, length=True).groupBy(band(bits).alias("band")).agg(*digest_columns(), raw)
    columns = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    label = F.concat_ws("|", F.lit(columns), F.lit(bits), "band", "row_count", "digest1", "digest2")
    return found.withColumn("name", F.sha2(label, 256))


def chunk_rows(df: DataFrame, wanted: DataFrame, bits: int, count: int) -> DataFrame:
    """The rows of the wanted chunks with their chunk's name, dealt so that a task writes one chunk, or a part of a chunk that one
    repeated row makes very large."""
    marked = with_fingerprint(df).withColumn(BAND, band(bits))
    parts = F.greatest(F.lit(1), F.ceil(F.col("raw_size") / FILE_BYTES)).cast("long")
    names = bounded_broadcast(wanted.select(F.col("band").alias(BAND), F.col("name").alias(NAME), parts.alias("_tv_parts")), count)
    rows = marked.join(names, BAND).withColumn("_tv_part", F.pmod(F.monotonically_increasing_id(), F.col("_tv_parts")))
    columns = [f"`{c}`" for c in df.columns]
    return rows.repartition(NAME, "_tv_part").select(*columns, *FINGERPRINT, NAME)


def stored_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not isinstance(f.dataType, T.NullType)]
