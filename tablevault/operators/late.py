"""Late, changed and deleted rows of a table that is known by a growing column.

Rows fall into buckets of that column. A state is kept as an invertible Bloom lookup table for each bucket: every row's fingerprint
is added to three cells of its bucket, as a count and as sums. Sketches are linear, so the difference of two of them is the sketch of what
differs, and few differing rows can be read off it again. A bucket in which too many rows differ does not decode; its rows are
compared with the stored ones. Without late changes a run reads the source's rows once and no row of the former state.

The sketch has a fixed number of cells for each bucket, whatever the rows; it is stored as parts that are added when read.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce

import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablevault.functions.fingerprint import H1, H2, digest_columns, lane_sum, with_fingerprint
from tablevault.operators.delta import COPIES, bounded_broadcast

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

BUCKET, CELL, NET, SUMS = "_tv_bucket", "_tv_cell", "_tv_net", ("n", "sum1", "sum2", "checks")
SKETCH = f"{BUCKET} bigint, {CELL} int, n bigint, sum1 decimal(38,0), sum2 decimal(38,0), checks decimal(38,0)"
#: Cells of each of the three hash functions: about a hundred differing rows of a bucket can be told.
CELLS, HASHES, CHECK_START = 48, 3, 99
#: Rows of a bucket at best, and buckets that a first state has at most.
BUCKET_ROWS, MOST_BUCKETS = 20_000, 1 << 18
#: Bucket of rows without a value.
NO_VALUE = -(1 << 62)
#: Parts of a sketch that are read together before they are added up.
MOST_PARTS = 8


# --- buckets --------------------------------------------------------------------------------


def number_of(column: str, dtype: T.DataType) -> Column:
    """A whole number that grows with the column and does not depend on the session's time zone."""
    c = F.col(f"`{column}`")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        seconds = F.unix_date(c.cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60 + F.second(c)
        return seconds * 1_000_000
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    raise ValueError(f"late rows of {column}: no buckets for {dtype.simpleString()}")


def bucket_width(df: DataFrame, column: str) -> int:
    """Width that gives buckets of ``BUCKET_ROWS`` rows if the rows were spread evenly."""
    number = number_of(column, df.schema[column].dataType)
    found = df.agg(F.count(number).alias("n"), F.min(number).alias("low"), F.max(number).alias("high")).first()
    wanted = max(1, min(found["n"] // BUCKET_ROWS, MOST_BUCKETS))
    return max(1, -(-((found["high"] or 0) - (found["low"] or 0) + 1) // wanted))


def with_bucket(df: DataFrame, column: str, width: int) -> DataFrame:
    number = number_of(column, df.schema[column].dataType)
    return df.withColumn(BUCKET, F.coalesce(F.call_function("div", number, F.lit(width).cast("bigint")), F.lit(NO_VALUE).cast("bigint")))


def prints(df: DataFrame, column: str, width: int) -> DataFrame:
    return with_bucket(with_fingerprint(df), column, width).select(BUCKET, H1, H2)


def _limit(dtype: T.DataType, number: int) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(number).cast("bigint"))
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=number))).cast("timestamp_ntz")
    if isinstance(dtype, T.DateType):
        return F.lit(str((datetime(1970, 1, 1) + timedelta(days=number)).date())).cast("date")
    return F.lit(number)


def in_buckets(df: DataFrame, column: str, width: int, buckets: DataFrame, count: int) -> DataFrame:
    """Rows of some buckets. The outermost of them also bound the column itself, which a scan can use."""
    ends = buckets.agg(F.min(BUCKET).alias("any"), F.min(F.when(F.col(BUCKET) != NO_VALUE, F.col(BUCKET))).alias("low"), F.max(BUCKET).alias("high")).first()
    c, dtype = F.col(f"`{column}`"), df.schema[column].dataType
    if ends["low"] is None:
        df = df.where(c.isNull())
    else:
        try:
            near = (c >= _limit(dtype, (ends["low"] - 1) * width)) & (c <= _limit(dtype, (ends["high"] + 1) * width))
            df = df.where(near | c.isNull() if ends["any"] == NO_VALUE else near)
        except OverflowError:
            pass  # bounds beyond the calendar: no help for the scan
    found = with_bucket(df, column, width)
    return found.join(bounded_broadcast(buckets.select(BUCKET), count), BUCKET, "left_semi").select(*[f"`{n}`" for n in df.columns])


# --- sketches -------------------------------------------------------------------------------


def cells(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """The sketch of ``bucket, h1, h2``; cells are summed before they are shuffled. ``weight`` counts a row several times, or away."""
    place = [(F.pmod(F.xxhash64(F.lit(i), H1, H2), F.lit(CELLS)) + i * CELLS).cast("int") for i in range(HASHES)]
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    each = rows.select(BUCKET, H1, H2, w.alias(NET), F.xxhash64(F.lit(CHECK_START), H1, H2).alias("check"), F.explode(F.array(*place)).alias(CELL))
    by = None if weight is None else NET
    return each.groupBy(BUCKET, CELL).agg(F.sum(NET).alias("n"), lane_sum(H1, by).alias("sum1"), lane_sum(H2, by).alias("sum2"), lane_sum("check", by).alias("checks"))


def added(parts: list[DataFrame], signs: list[int] | None = None) -> DataFrame:
    """Sum of sketches; those of negative sign are taken away."""
    signed = [p if s > 0 else p.withColumns({c: -F.col(c) for c in SUMS}) for p, s in zip(parts, signs or [1] * len(parts))]
    total = reduce(DataFrame.unionByName, signed).groupBy(BUCKET, CELL)
    return total.agg(F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS[1:]])


def read_sketch(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(SKETCH).parquet(*paths)


def digests_of(sketch: DataFrame) -> DataFrame:
    """Digest of each bucket: every row is in one cell of the first hash function."""
    first = sketch.where(F.col(CELL) < CELLS).groupBy(BUCKET)
    return first.agg(F.sum("n").alias("row_count"), *[F.sum(f"sum{i}").cast("decimal(38,0)").alias(f"digest{i}") for i in (1, 2)])


def digests(rows: DataFrame) -> DataFrame:
    return rows.groupBy(BUCKET).agg(*digest_columns())


def differing_buckets(before: DataFrame, now: DataFrame) -> DataFrame:
    """Buckets whose digests differ, in a frame of one column."""
    names = ("row_count", "digest1", "digest2")
    both = before.withColumn("s", F.lit(-1)).unionByName(now.withColumn("s", F.lit(1)))
    # signs only, no products: those would round digests of more than 28 digits
    net = [F.sum(F.when(F.col("s") == 1, F.col(c)).otherwise(-F.col(c))).alias(c) for c in names]
    return both.groupBy(BUCKET).agg(*net).where("row_count <> 0 or digest1 <> 0 or digest2 <> 0").select(BUCKET)


def _chained(start: int, h1: int, h2: int) -> int:
    """The same 64-bit hash as the engine's over an int and two longs."""
    value = xxhash.xxh64_intdigest(struct.pack("<i", start), seed=42)
    for h in (h1, h2):
        value = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=value)
    return value - (1 << 64) if value >= 1 << 63 else value


def places(h1: int, h2: int) -> list[int]:
    return [_chained(i, h1, h2) % CELLS + i * CELLS for i in range(HASHES)]


def peel(rows: Iterable[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]] | None:
    """Fingerprints and net copies in a difference given as ``cell, n, sum1, sum2, checks``; nothing if it cannot be read.

    A cell that holds one fingerprint only, in any number of copies, is known by its check; it is taken out of its other
    cells, until all are empty."""
    table = {cell: list(sums) for cell, *sums in rows}
    found: dict[tuple[int, int], int] = {}
    waiting = list(table)
    while waiting:
        cell = waiting.pop()
        n, s1, s2, checks = table[cell]
        if n == 0 or s1 % n or s2 % n or checks % n:
            continue
        h1, h2, check = s1 // n, s2 // n, checks // n
        if not (-(1 << 63) <= h1 < 1 << 63 and -(1 << 63) <= h2 < 1 << 63) or check != _chained(CHECK_START, h1, h2):
            continue
        if cell not in places(h1, h2):
            continue
        found[h1, h2] = found.get((h1, h2), 0) + n
        for other in places(h1, h2):
            sums = table.setdefault(other, [0, 0, 0, 0])
            for i, v in enumerate((n, n * h1, n * h2, n * check)):
                sums[i] -= v
            waiting.append(other)
    if any(any(sums) for sums in table.values()):
        return None
    return [(h1, h2, n) for (h1, h2), n in found.items() if n]


def decoded(difference: DataFrame) -> DataFrame:
    """``bucket, h1, h2, net`` read off a difference; a bucket that does not decode has one row without a fingerprint. A task holds
    the cells of one bucket at a time."""

    def read(part: pd.DataFrame) -> pd.DataFrame:
        bucket = int(part[BUCKET].iloc[0])
        found = peel((int(c), *(int(v) for v in sums)) for c, *sums in zip(part[CELL], *(part[s] for s in SUMS)))
        rows = [(bucket, None, None, None)] if found is None else [(bucket, *f) for f in found]
        return pd.DataFrame(rows, columns=[BUCKET, H1, H2, NET]).astype({c: "Int64" for c in (BUCKET, H1, H2, NET)})

    return difference.groupBy(BUCKET).applyInPandas(read, f"{BUCKET} bigint, {H1} bigint, {H2} bigint, {NET} bigint")


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """The same from the fingerprints themselves."""
    one = F.lit(1).cast("bigint")
    both = now.withColumn(NET, one).unionByName(before.withColumn(NET, -one))
    return both.groupBy(BUCKET, H1, H2).agg(F.sum(NET).alias(NET)).where(F.col(NET) != 0)


def with_copies(net: DataFrame, now: DataFrame, count: int, before: str) -> DataFrame:
    """A multiset change list: copies of each changed row now, counted in the source, and before."""
    wanted = bounded_broadcast(net.select(H1, H2), count)
    held = now.select(H1, H2).join(wanted, [H1, H2], "left_semi").groupBy(H1, H2).agg(F.count(F.lit(1)).alias(COPIES))
    copies = F.coalesce(F.col(COPIES), F.lit(0)).cast("bigint")
    return net.join(held, [H1, H2], "left").select(BUCKET, H1, H2, NET, copies.alias(COPIES), (copies - F.col(NET)).alias(before))
