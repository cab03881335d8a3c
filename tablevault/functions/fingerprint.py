"""Row fingerprints, and the multiset digest of a table built from them.

The digest of a table is ``(count, sum(h1), sum(h2))`` over two 64-bit hashes of each row. A sum
does not depend on row order or on file layout, counts duplicates (an XOR would cancel them),
needs a constant-size aggregation buffer, and is additive: the digest of a new state is the digest
of the old one plus the rows added minus the rows removed.

Two row hashes are offered.

* :func:`with_fingerprint` chains ``xxhash64`` over the column values, twice with different
  starts, for 128 bits in two BIGINT columns. It works on the values as they are held in memory,
  so it costs nanoseconds per column, stays in generated code, and shuffles in 16 bytes. A plain
  ``xxhash64`` skips nulls, so ``(null, 1)`` and ``(1, null)`` would agree; here every
  value is preceded by its null flag and every array by its size. Zero and minus zero, and all
  NaNs, count as the same value, as they do in Spark's joins and groupings. This hash detects
  change and damage; against tampering there are the SHA-256 of the part files and the keyed digest of
  :mod:`tablevault.functions.sealed`.
* :func:`portable_digest` hashes length-prefixed text with SHA-256, so that another engine can
  recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

H1, H2, LEN = "_tv_h1", "_tv_h2", "_tv_len"
FINGERPRINT = [H1, H2]
# Fixed value: what the second chain hashes first.
SECOND_START = 0x5DEECE66D
# sum(decimal(28,0)) is decimal(38,0), which holds 10^19 rows of 64-bit hashes.
_LANE = T.DecimalType(28, 0)
DIGEST = T.DecimalType(38, 0)

# Bytes of one value of a fixed-width type.
WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16, T.NullType: 0,
}
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


# --- in-memory fingerprint ----------------------------------------------------------------


def _flagged(value: Column, dtype: T.DataType) -> list[Column]:
    """The flag is there for columns that cannot be null too: a source may declare a column not
    null that its stored copy cannot."""
    return [value.isNull(), *_hash_args(value, dtype)]


def _pair(value: Column, dtype: T.DataType) -> Column:
    """A nested value as a struct of hashes that is hashable and can be ordered."""
    args = _flagged(value, dtype)
    return F.struct(F.xxhash64(*args).alias("a"), F.xxhash64(F.lit(SECOND_START), *args).alias("b"))


def _hash_args(value: Column, dtype: T.DataType) -> list[Column]:
    """Hashable columns that together determine a value."""
    if isinstance(dtype, T.NullType):
        return []
    if isinstance(dtype, T.VariantType):
        return [F.to_json(value)]
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, _NESTED):
            return [F.size(value), F.transform(value, lambda x: _pair(x, dtype.elementType))]
        return [F.size(value), value, F.transform(value, lambda x: x.isNull())]
    if isinstance(dtype, T.MapType):
        entry = lambda e: F.struct(
            _pair(e["key"], dtype.keyType).alias("k"), _pair(e["value"], dtype.valueType).alias("v")
        )
        # entry order is not part of a map's value
        return [F.size(value), F.array_sort(F.transform(F.map_entries(value), entry))]
    if isinstance(dtype, T.StructType):
        return [arg for f in dtype.fields for arg in _flagged(value[f.name], f.dataType)]
    return [value]


def _raw_bytes(value: Column, dtype: T.DataType) -> Column | int:
    """Bytes a value takes uncompressed; 0 for null."""
    if type(dtype) in WIDTH:
        return WIDTH[type(dtype)]
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(dtype, T.ArrayType) and type(dtype.elementType) in WIDTH:
        size = F.when(value.isNotNull(), F.size(value) * WIDTH[type(dtype.elementType)])
    elif isinstance(dtype, _NESTED):
        size = F.octet_length(F.to_json(F.struct(value.alias("v"))))
    else:
        size = F.octet_length(value.cast("string"))
    return F.coalesce(size, F.lit(0)).cast("bigint")


def with_fingerprint(df: DataFrame, columns: list[str] | None = None, length: bool = False) -> DataFrame:
    """Append the fingerprint of ``columns`` (all by default) and, when asked, the raw size of
    the row. Narrow: nothing is shuffled."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    named = [(F.col(f"`{f.name}`"), f) for f in fields]
    args = [arg for c, f in named for arg in _flagged(c, f.dataType)]
    added = {H1: F.xxhash64(F.lit(len(fields)), *args), H2: F.xxhash64(F.lit(SECOND_START), *args)}
    if length:
        sizes = [_raw_bytes(c, f.dataType) for c, f in named]
        total = F.lit(sum(s for s in sizes if isinstance(s, int))).cast("bigint")
        for s in sizes:
            total = total if isinstance(s, int) else total + s
        added[LEN] = total
    return df.withColumns(added)


def lane_sum(column: str | Column, weight: str | Column | None = None) -> Column:
    """Sum of one hash column, 0 for no rows; ``weight`` multiplies each row."""
    value = (F.col(column) if isinstance(column, str) else column).cast(_LANE)
    if weight is not None:
        w = F.col(weight) if isinstance(weight, str) else weight
        value = (value * w.cast(T.DecimalType(18, 0))).cast(DIGEST)
    return F.coalesce(F.sum(value), F.lit(0)).cast(DIGEST)


def digest_columns() -> list[Column]:
    """Aggregates over a frame that carries the fingerprint columns."""
    return [
        F.count(F.lit(1)).alias("row_count"),
        lane_sum(H1).alias("digest1"),
        lane_sum(H2).alias("digest2"),
    ]


def table_digest(df: DataFrame) -> DataFrame:
    """One row ``(row_count, digest1, digest2)``; partial sums per task, one tiny final merge."""
    return with_fingerprint(df).agg(*digest_columns())


# --- portable digest ----------------------------------------------------------------------


def _text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast("string")  # an instant, whatever the session zone
    return value.cast("string")


def row_text(df: DataFrame) -> Column:
    """Length-prefixed text of a row: ``('a, b', 'c')`` and ``('a', 'b, c')`` differ, and so do
    null and ``''``. For columns of plain types; nested ones have no common text form."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, _NESTED):
            raise ValueError(f"{f.name}: no portable text for {f.dataType.simpleString()}")
        t = _text(F.col(f"`{f.name}`"), f.dataType)
        parts.append(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-1:")))
    return F.concat(F.lit(""), *parts)


def lane(hex_digest: Column, number: int) -> Column:
    """60-bit lane 1 or 2 of a hex digest."""
    return F.conv(F.substring(hex_digest, 15 * (number - 1) + 1, 15), 16, 10).cast("bigint")


def portable_digest(df: DataFrame) -> DataFrame:
    """One row ``(row_count, digest1, digest2)`` from 60-bit pieces of SHA-256 row hashes."""
    text = df.select(row_text(df).alias("_text"))
    hashed = text.select(F.sha2("_text", 256).alias("_hex"))
    lanes = hashed.select(lane(F.col("_hex"), 1).alias(H1), lane(F.col("_hex"), 2).alias(H2))
    return lanes.agg(*digest_columns())
