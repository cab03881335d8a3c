"""Stored indexes of a table's state, so that a delta need not read the state itself.

A table with a key is indexed by keys and fingerprints in hash buckets, a table without one by fingerprints with their copies
in ranges. Either index is a base and small runs after it, newest last: what a delta found is the next run. Runs are
merged, four of a level into one of the next, and a base takes its runs in when they have grown to its size, so a delta reads
few parts and rewrites the base rarely.

Current rows and runs are grouped by key in one shuffle; the base is read bucket by bucket and joined without moving.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablevault.functions.fingerprint import FINGERPRINT, H1, H2, lane_sum, with_fingerprint
from tablevault.operators.delta import BEFORE, COPIES, OP, bounded_broadcast
from tablevault.operators.restore import _last_word

#: Runs of a level that are merged.
FAN = 4
#: Bytes of source for each bucket, when that asks for fewer buckets than shuffle partitions.
BUCKET_BYTES = 512 << 10
#: Rows of a range at best, ranges at least and at most, and bits that divide a range further into leaves.
RANGE_ROWS, FEWEST_BITS, MOST_BITS, LEAF_BITS = 250_000, 3, 16, 8


# --- bucketed files -------------------------------------------------------------------------


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions, fewer for a small source."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))


def _name() -> str:
    return f"tablevault_{uuid.uuid4().hex}"


def _columns(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def in_buckets(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The rows of a frame that is grouped by ``keys``, in a partition for each bucket or several."""
    if buckets == int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(buckets, *keys)


def write_buckets(df: DataFrame, keys: list[str], buckets: int, path: str) -> None:
    """Write a frame in sorted hash buckets. The table that Spark wants for this is external and dropped at once; its files stay."""
    name = _name()
    try:
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def read_buckets(spark: SparkSession, schema: T.StructType, keys: list[str], buckets: int, path: str) -> DataFrame:
    """The files of :func:`write_buckets` as a frame whose buckets Spark knows."""
    name = _name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    path = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({_columns(keys)}) SORTED BY ({_columns(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- tables with a key ----------------------------------------------------------------------


def key_prints(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, h1, h2, n`` of each key; ``n`` above 1 means that it is none."""
    return with_fingerprint(df).groupBy(*keys).agg(F.max(H1).alias(H1), F.max(H2).alias(H2), F.count(F.lit(1)).alias("_tv_n"))


def key_totals(keys: list[str]) -> list[Column]:
    """Aggregates over :func:`key_prints`: keys that are repeated or null, and the digest of the rows."""
    bad = reduce(lambda a, k: a | F.col(f"`{k}`").isNull(), keys, F.col("_tv_n") > 1)
    return [F.count(F.when(bad, 1)).alias("faults"), F.count(F.lit(1)).alias("rows"), lane_sum(H1).alias("digest1"), lane_sum(H2).alias("digest2")]


def read_keyed_run(spark: SparkSession, keys: list[T.StructField], path: str) -> DataFrame:
    """A stored change list as a run: ``keys, op, h1, h2``, the fingerprint that each changed key holds afterwards."""
    schema = T.StructType([*keys, T.StructField("op", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("cur_h1", "cur_h2")]])
    named = [F.col("op").alias(OP), F.col("cur_h1").alias(H1), F.col("cur_h2").alias(H2)]
    return spark.read.schema(schema).parquet(path).select(*[f"`{k.name}`" for k in keys], *named)


def merged_keyed_runs(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Several runs as one, in the form of a change list."""
    named = [F.col(OP).alias("op"), F.col(H1).alias("cur_h1"), F.col(H2).alias("cur_h2")]
    return _last_word(runs, keys).select(*[f"`{k}`" for k in keys], *named)


def read_multiset_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{H1} bigint, {H2} bigint, {COPIES} bigint").parquet(path)


def merged_multiset_runs(runs: list[DataFrame]) -> DataFrame:
    return _last_word(runs, FINGERPRINT)


def keyed_changes(cur: DataFrame, base: DataFrame, runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """The same as :func:`delta.keyed_changes`, with the former state given as an index.

    A key holds what the newest run says of it, else what the base says. Each key has one run row at most once the runs are reduced to
    their last word, so plain maxima tell current rows and run rows apart after one grouping."""
    names = [f"`{k}`" for k in keys]
    none, kind = F.lit(None).cast("bigint"), F.when(F.col(OP) == "U", 1).otherwise(2).cast("bigint")
    sides = [with_fingerprint(cur).select(*names, F.col(H1).alias("cur_h1"), F.col(H2).alias("cur_h2"), F.lit(1).cast("bigint").alias("n"), *[none.alias(c) for c in ("run_h1", "run_h2", "kind")])]
    if runs:
        last = _last_word(runs, keys)
        sides.append(last.select(*names, none.alias("cur_h1"), none.alias("cur_h2"), F.lit(0).cast("bigint").alias("n"), F.col(H1).alias("run_h1"), F.col(H2).alias("run_h2"), kind.alias("kind")))
    both = reduce(DataFrame.unionByName, sides).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("cur_h1", "cur_h2", "run_h1", "run_h2", "kind")], F.sum("n").alias("cur_n")
    )
    known = base.select(*names, F.col(H1).alias("base_h1"), F.col(H2).alias("base_h2"))
    joined = both.join(known, keys, "full_outer")
    prev = {f"prev_h{i}": F.when(F.col("kind").isNull(), F.col(f"base_h{i}")).when(F.col("kind") == 1, F.col(f"run_h{i}")) for i in (1, 2)}
    joined = joined.withColumns(prev)
    bad = reduce(lambda a, k: a | F.col(k).isNull(), names, F.col("cur_n") > 1)
    here = F.coalesce(F.col("cur_n"), F.lit(0)) > 0
    differs = (F.col("cur_h1") != F.col("prev_h1")) | (F.col("cur_h2") != F.col("prev_h2"))
    op = F.when(here & bad, "X").when(here & F.col("prev_h1").isNull(), "U").when(~here & F.col("prev_h1").isNotNull(), "D").when(here & differs, "U")
    return joined.withColumn("op", op).where("op is not null").select(*names, "op", "cur_h1", "cur_h2", "prev_h1", "prev_h2")


def keyed_base(base: DataFrame, runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """The base after its runs."""
    last = _last_word(runs, keys)
    kept = base.join(last.select(*keys), keys, "left_anti").select(*base.columns)
    return kept.unionByName(last.where(F.col(OP) == "U").select(*base.columns))


# --- tables without a key: ranges of fingerprints ---------------------------------------------

BAND, LEAF = "_tv_band", "_tv_leaf"
TREE = [LEAF, "row_count", "digest1", "digest2"]


def band_bits(rows: int) -> int:
    bits = FEWEST_BITS
    while bits < MOST_BITS and rows > RANGE_ROWS << bits:
        bits += 1
    return bits


def band(bits: int) -> Column:
    """Range of a fingerprint: the leading bits of its first half."""
    return F.shiftrightunsigned(H1, 64 - bits).cast("int")


def leaf(bits: int) -> Column:
    return F.shiftrightunsigned(H1, 64 - bits - LEAF_BITS).cast("int")


def tree(prints: DataFrame, bits: int, weight: str | None = None) -> DataFrame:
    """Digest of each leaf; rows are combined before anything moves. Digests of upper levels are sums of these."""
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return prints.groupBy(leaf(bits).alias(LEAF)).agg(count.alias("row_count"), lane_sum(H1, weight).alias("digest1"), lane_sum(H2, weight).alias("digest2"))


def differing(before: DataFrame, now: DataFrame) -> tuple[list[int], DataFrame | None]:
    """Ranges and leaves in which two trees differ, found from the root: leaves are compared in differing ranges only.

    The driver holds the numbers of differing ranges, at most 2 ** MOST_BITS. No leaves (``None``) when the roots agree."""
    total = [F.sum("row_count").alias("row_count"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("digest1", "digest2")]]
    sides = [t.groupBy(F.shiftright(LEAF, LEAF_BITS).alias(BAND)).agg(*total) for t in (before, now)]
    bands = sorted(r[BAND] for r in _unlike(*sides, BAND).collect())
    if not bands:
        return [], None
    inside = F.shiftright(LEAF, LEAF_BITS).isin(bands)
    return bands, _unlike(before.where(inside), now.where(inside), LEAF)


def _unlike(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Numbers for which one side has a digest that the other has not."""
    signed = [a.select(by, F.lit(1).alias("s"), "row_count", "digest1", "digest2"), b.select(by, F.lit(-1).alias("s"), "row_count", "digest1", "digest2")]
    net = [F.sum(F.col("s") * F.col("row_count")).alias("n"), *[F.sum(F.when(F.col("s") == 1, F.col(c)).otherwise(-F.col(c))).alias(c) for c in ("digest1", "digest2")]]
    return signed[0].unionByName(signed[1]).groupBy(by).agg(*net).where("n <> 0 or digest1 <> 0 or digest2 <> 0").select(by)


def write_bands(prints: DataFrame, bits: int, path: str) -> None:
    """Fingerprints with copies, a folder for each range; equal fingerprints are combined, in each batch before they move to their range and
    there once more."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            summed = pa.Table.from_batches([batch]).group_by(FINGERPRINT).aggregate([(COPIES, "sum")])
            yield from summed.rename_columns([*FINGERPRINT, COPIES]).to_batches()

    schema = f"{H1} bigint, {H2} bigint, {COPIES} bigint"
    combined = prints.select(*FINGERPRINT, COPIES).mapInArrow(combine, schema).withColumn(BAND, band(bits))
    rows = combined.repartition(BAND).groupBy(BAND, *FINGERPRINT).agg(F.sum(COPIES).alias(COPIES)).select(*FINGERPRINT, COPIES, BAND)
    rows.sortWithinPartitions(BAND, H1).write.partitionBy(BAND).option("compression", "zstd").parquet(path)


def read_bands(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """``h1, h2, copies`` of some ranges; the folders of others are not opened."""
    schema = f"{H1} bigint, {H2} bigint, {COPIES} bigint, {BAND} int"
    rows = spark.read.schema(schema).parquet(path)
    return (rows if bands is None else rows.where(F.col(BAND).isin(bands))).select(*FINGERPRINT, COPIES)


def within(prints: DataFrame, bits: int, leaves: DataFrame | None, count: int) -> DataFrame:
    """Fingerprints in some leaves; all of them without leaves."""
    if leaves is None:
        return prints
    return prints.withColumn(LEAF, leaf(bits)).join(bounded_broadcast(leaves, count), LEAF, "left_semi").drop(LEAF)


def multiset_changes(cur: DataFrame, base: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """The same as :func:`delta.multiset_changes`, with the former state given as an index: ``cur`` has fingerprints, ``base`` fingerprints
    and copies, ``runs`` fingerprints and copies afterwards."""
    one, zero, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    sides = [
        cur.select(*FINGERPRINT, one.alias("now"), zero.alias("base"), none.alias("run")),
        base.select(*FINGERPRINT, zero.alias("now"), F.col(COPIES).alias("base"), none.alias("run")),
    ]
    if runs:
        sides.append(_last_word([r.select(*FINGERPRINT, COPIES) for r in runs], FINGERPRINT).select(*FINGERPRINT, zero.alias("now"), zero.alias("base"), F.col(COPIES).alias("run")))
    total = reduce(DataFrame.unionByName, sides).groupBy(*FINGERPRINT).agg(F.sum("now").alias(COPIES), F.sum("base").alias("base"), F.max("run").alias("run"))
    return total.select(*FINGERPRINT, COPIES, F.coalesce("run", "base").alias(BEFORE)).where(F.col(COPIES) != F.col(BEFORE))


def multiset_base(base: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """The base after its runs; fingerprints without copies are gone."""
    last = _last_word([r.select(*FINGERPRINT, COPIES) for r in runs], FINGERPRINT)
    kept = base.join(last.select(*FINGERPRINT), FINGERPRINT, "left_anti")
    return kept.unionByName(last.where(F.col(COPIES) > 0))


# --- levels -----------------------------------------------------------------------------------


def to_merge(parts: list[dict]) -> tuple[str, int] | None:
    """What the parts of an index (base first, ``rows`` and ``level`` of each) ask for: ``("base", 0)``, ``("runs", first)`` for the runs from
    there on, or nothing."""
    runs = parts[1:]
    if sum(p["rows"] for p in runs) > max(parts[0]["rows"], 1) and len(runs) > 2:
        return "base", 0
    newest = runs[-FAN:]
    if len(newest) == FAN and len({p["level"] for p in newest}) == 1:
        return "runs", len(parts) - FAN
    return None
