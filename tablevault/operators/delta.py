"""What changed between two states of a table.

A delta is found in two passes. The narrow pass shuffles only keys and 16-byte fingerprints and
writes the changes, which cuts the lineage and gives their exact number. The wide pass fetches
the changed rows from the current table by a semi join with those changes. For a small change the
semi join is a broadcast join, so the wide table is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablevault.functions.fingerprint import FINGERPRINT, H1, H2, WIDTH, lane_sum, with_fingerprint

OP, COPIES, BEFORE = "_tv_op", "_tv_n", "_tv_before"
# Rows a single task emits for one repeated row before the work is spread over the cluster.
COPY_CHUNK = 100_000
# A broadcast side is at most this many bytes, from an exact row count and fixed-width columns.
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """True when ``rows`` times the row width provably stays under the limit. A column of variable
    width gives no bound, so the answer is no."""
    widths = [WIDTH.get(type(f.dataType)) for f in df.schema.fields]
    return None not in widths and rows * (sum(widths) + 16) <= BROADCAST_BYTES


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind :func:`fits_broadcast`; otherwise the optimizer chooses."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


# --- sieves: which rows may have a wanted fingerprint -----------------------------------------

# Bits of a sieve for each fingerprint, and its bits at least and at most (as powers of two); it is sent to every task.
SIEVE_SPREAD, SIEVE_LEAST, SIEVE_MOST = 8, 16, 29
# Bits in one row of a sieve.
_ROW_BITS = 15


def sieve_bits(count: int) -> int | None:
    """Power of two of the bits for ``count`` fingerprints; none when the largest sieve would let most rows through."""
    bits = max(SIEVE_LEAST, (SIEVE_SPREAD * max(count, 1) - 1).bit_length())
    return min(bits, SIEVE_MOST) if count <= 1 << SIEVE_MOST - 1 else None


def sifted(rows: DataFrame, wanted: DataFrame, bits: int, held: bool = True) -> DataFrame:
    """Rows whose fingerprint may be among the wanted ones, or those whose fingerprint surely is not. Nothing wide moves: tasks look up one
    bit of the second half of a fingerprint."""
    slot = F.shiftrightunsigned(H2, 64 - bits)
    row, place = F.shiftright(slot, _ROW_BITS).cast("int"), slot.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sieve = wanted.select(row.alias("_tv_row"), place.alias("_tv_place")).groupBy("_tv_row").agg(F.bitmap_construct_agg("_tv_place").alias("_tv_bits"))
    octet = F.substring("_tv_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(octet), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", value, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    columns = [f"`{c}`" for c in rows.columns]
    joined = rows.withColumn("_tv_row", row).join(F.broadcast(sieve), "_tv_row", "inner" if held else "left")
    return joined.where(hit if held else ~hit).select(*columns)


def without_prints(rows: DataFrame, names: DataFrame, count: int | None) -> DataFrame:
    """Rows whose fingerprint is not among ``count`` names (not known: the optimizer chooses how). Beyond a broadcast only rows that a sieve
    cannot tell from the names are moved to meet them."""
    bits = None if count is None or fits_broadcast(names, count) else sieve_bits(count)
    if bits is None:
        return rows.join(names if count is None else bounded_broadcast(names, count), FINGERPRINT, "left_anti")
    near = sifted(rows, names, bits).join(names, FINGERPRINT, "left_anti").select(*rows.columns)
    return sifted(rows, names, bits, held=False).unionByName(near)


# --- tables with a unique key -------------------------------------------------------------


def key_faults(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a null. Reads the key columns only; repeated keys
    are combined before the shuffle."""
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(f"`{k}`").isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | has_null)


def keyed_changes(cur: DataFrame, prev: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, op, cur_h1, cur_h2, prev_h1, prev_h2`` of every key that differs.

    ``U`` inserted or changed, ``D`` deleted, ``X`` not usable as a key (repeated or null). The
    current rows are grouped by key, which finds repeated keys and combines them before the
    shuffle; the join reuses that partitioning. Keys of the previous state were checked when it
    was stored; it may come as keys and fingerprints only."""
    c = with_fingerprint(cur).groupBy(*keys).agg(
        F.max(H1).alias("cur_h1"), F.max(H2).alias("cur_h2"), F.count(F.lit(1)).alias("cur_n")
    )
    known = prev if H1 in prev.columns else with_fingerprint(prev)
    p = known.select(*keys, F.col(H1).alias("prev_h1"), F.col(H2).alias("prev_h2"))
    bad = F.col("cur_n") > 1
    for k in keys:
        bad = bad | F.col(f"`{k}`").isNull()
    differs = (F.col("cur_h1") != F.col("prev_h1")) | (F.col("cur_h2") != F.col("prev_h2"))
    op = (
        F.when(bad, "X")
        .when(F.col("prev_h1").isNull(), "U")
        .when(F.col("cur_n").isNull(), "D")
        .when(differs, "U")
    )
    return (
        c.join(p, keys, "full_outer")
        .withColumn("op", op)
        .where(F.col("op").isNotNull())
        .select(*keys, "op", "cur_h1", "cur_h2", "prev_h1", "prev_h2")
    )


def keyed_change_totals() -> list[Column]:
    """Counts and digest differences of :func:`keyed_changes`."""
    op = F.col("op")
    inserted, deleted = (op == "U") & F.col("prev_h1").isNull(), op == "D"
    n = lambda c: F.count(F.when(c, 1))
    only = lambda c, v: F.when(c, F.col(v))
    return [
        n(op == "X").alias("faults"),
        n(op == "U").alias("upserts"),
        n(deleted).alias("deletes"),
        n(F.col("prev_h1").isNotNull()).alias("touched"),
        (n(inserted) - n(deleted)).alias("rows"),
        lane_sum(only(op == "U", "cur_h1")).alias("up1"),
        lane_sum(only(op == "U", "cur_h2")).alias("up2"),
        lane_sum("prev_h1").alias("out1"),
        lane_sum("prev_h2").alias("out2"),
    ]


def keyed_payload(cur: DataFrame, changes: DataFrame, keys: list[str], upserts: int) -> DataFrame:
    """Current rows of the changed keys, and the bare keys of the deleted ones."""
    wanted = bounded_broadcast(changes.where(F.col("op") == "U").select(*keys), upserts)
    rows = cur.join(wanted, keys, "left_semi").select(*[f"`{c}`" for c in cur.columns]).withColumn(OP, F.lit("U"))
    gone = changes.where(F.col("op") == "D").select(*keys).withColumn(OP, F.lit("D"))
    return rows.unionByName(gone, allowMissingColumns=True)


# --- tables without a key: multisets ------------------------------------------------------


def multiset_changes(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Fingerprint, copies now and copies before, of every distinct row whose number of copies
    differs.

    One grouped sum over both sides: 32 bytes per row are shuffled, equal rows are combined
    before the shuffle, and both directions come out of the same pass. The former state may come
    as fingerprints with copies."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    known = prev if H1 in prev.columns else with_fingerprint(prev).withColumn(COPIES, one)
    sides = [
        with_fingerprint(cur).select(*FINGERPRINT, one.alias(COPIES), none.alias(BEFORE)),
        known.select(*FINGERPRINT, none.alias(COPIES), F.col(COPIES).alias(BEFORE)),
    ]
    total = sides[0].unionByName(sides[1]).groupBy(*FINGERPRINT).agg(
        F.sum(COPIES).alias(COPIES), F.sum(BEFORE).alias(BEFORE)
    )
    return total.where(F.col(COPIES) != F.col(BEFORE))


def multiset_weight() -> Column:
    """How often a payload row counts in its digest; a row that is gone counts once."""
    return F.col(COPIES) + 1


def multiset_change_totals() -> list[Column]:
    n, gain = F.col(COPIES), F.col(COPIES) - F.col(BEFORE)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return [
        F.count(F.when(n > 0, 1)).alias("present"),
        F.count(F.when(n == 0, 1)).alias("gone"),
        F.count(F.when(F.col(BEFORE) > 0, 1)).alias("touched"),
        total(F.when(gain > 0, gain)).alias("upserts"),
        total(F.when(gain < 0, -gain)).alias("deletes"),
        lane_sum(H1, gain).alias("net1"),
        lane_sum(H2, gain).alias("net2"),
        lane_sum(H1, multiset_weight()).alias("digest1"),
        lane_sum(H2, multiset_weight()).alias("digest2"),
    ]


def _one_of_each(side: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
    """One row of ``side`` for every wanted fingerprint, with its numbers of copies.

    Copies of a row are combined before they meet: behind a broadcast join by the partial step
    of the deduplication; in a shuffled join by deduplicating first, which reduces a row that fills a
    third of the table, changed or not, to one copy for each input partition before anything moves.
    Rows that a sieve tells from the wanted ones are neither sorted nor moved there."""
    rows = with_fingerprint(side)
    if fits_broadcast(wanted, count):
        return rows.join(F.broadcast(wanted), FINGERPRINT).dropDuplicates(FINGERPRINT).drop(*FINGERPRINT)
    bits = sieve_bits(count)
    if bits is not None:
        rows = sifted(rows, wanted, bits)
    return rows.dropDuplicates(FINGERPRINT).join(wanted, FINGERPRINT).drop(*FINGERPRINT)


def multiset_payload(cur: DataFrame, prev: DataFrame, changes: DataFrame, present: int, gone: int) -> DataFrame:
    """Each changed row once, with its copies now (0 when it is gone) and before. The former state is read only for rows that are gone; any rows
    among which it is will do for it."""
    now = _one_of_each(cur, changes.where(F.col(COPIES) > 0), present)
    if not gone:
        return now
    return now.unionByName(_one_of_each(prev, changes.where(F.col(COPIES) == 0), gone))


def _holds_map(dtype: T.DataType) -> bool:
    return "map<" in dtype.simpleString() or "variant" in dtype.simpleString()


def repeat_rows(df: DataFrame) -> DataFrame:
    """Each row as often as its copy count says (rows with a count below 1 vanish).

    A row with very many copies is first split into chunks that are spread over the cluster, so
    no task writes more than a chunk of any one row."""
    n = F.col(COPIES)
    few = df.where((n >= 1) & (n <= COPY_CHUNK))
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / F.lit(COPY_CHUNK)) - 1))
    many = df.where(n > COPY_CHUNK).withColumn("_tv_chunk", chunks)
    many = many.withColumn(COPIES, F.least(F.lit(COPY_CHUNK), n - F.col("_tv_chunk") * COPY_CHUNK))
    spread = [F.col(f"`{c}`") for c in df.columns if not _holds_map(df.schema[c].dataType)]
    many = many.repartition(F.xxhash64("_tv_chunk", *spread)).drop("_tv_chunk")
    out = few.unionByName(many)
    return out.withColumn("_tv_i", F.explode(F.sequence(F.lit(1).cast("bigint"), n))).drop("_tv_i", COPIES)


# --- append-only tables with a growing column ---------------------------------------------


def high_water(column: str, dtype: T.DataType) -> Column:
    """The mark of a column as text. An instant is kept in microseconds, because its rendering
    depends on the time zone of the session."""
    mark = F.max(column)
    return (F.unix_micros(mark) if isinstance(dtype, T.TimestampType) else mark).cast("string")


def after_high_water(cur: DataFrame, column: str, mark: str | None) -> DataFrame:
    """Rows past the recorded mark; a plain comparison that the scan can use.

    Exact only for tables that grow at the end of ``column``: late rows, changes and deletes
    leave no trace here and need a keyed or key-less delta."""
    return cur if mark is None else cur.where(F.col(column) > _mark_value(cur, column, mark))


def up_to_high_water(cur: DataFrame, column: str, mark: str) -> DataFrame:
    """The other rows: up to the mark, or without a value."""
    return cur.where((F.col(column) <= _mark_value(cur, column, mark)) | F.col(column).isNull())


def _mark_value(cur: DataFrame, column: str, mark: str) -> Column:
    dtype = cur.schema[column].dataType
    return F.timestamp_micros(F.lit(int(mark))) if isinstance(dtype, T.TimestampType) else F.lit(mark).cast(dtype)
