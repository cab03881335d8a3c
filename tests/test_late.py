import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tablevault import BackupRequest
from tablevault.functions.fingerprint import H1, H2
from tablevault.operators import late

START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def _backup(vault, df, step, kind="incremental", late_rows=True):
    done = vault.backup({"t": df}, BackupRequest(db_name="shop", backup_type=kind, high_water={"t": "at"}, late_rows=late_rows), START + timedelta(minutes=step))
    assert done.success, done.error
    return done.backup_id


def _cells(pairs):
    table = {}
    for h1, h2, n in pairs:
        for cell in late.places(h1, h2):
            sums = table.setdefault(cell, [0, 0, 0, 0])
            for i, v in enumerate((n, n * h1, n * h2, n * late._chained(late.CHECK_START, h1, h2))):
                sums[i] += v
    return [(c, *s) for c, s in table.items()]


def test_peeling_gives_back_what_differs():
    draw = random.Random(3)
    long = lambda: draw.randrange(-(1 << 63), 1 << 63)
    for size in (0, 1, 2, 40, 80):
        pairs = [(long(), long(), draw.choice([-3, -1, 1, 2, 1000])) for _ in range(size)]
        assert sorted(late.peel(_cells(pairs))) == sorted(pairs)
    assert late.peel(_cells([(long(), long(), 1) for _ in range(1000)])) is None


def test_hash_and_cells_as_in_the_engine(spark):
    rows = spark.range(50).select(F.lit(7).cast("bigint").alias(late.BUCKET), F.xxhash64("id").alias(H1), F.xxhash64("id", F.lit(1)).alias(H2))
    got = {r[late.CELL]: (r["n"], int(r["sum1"]), int(r["sum2"]), int(r["checks"])) for r in late.cells(rows).collect()}
    assert got == {c: tuple(s) for c, *s in _cells([(r[H1], r[H2], 1) for r in rows.collect()])}
    whole = late.decoded(late.cells(rows))
    assert sorted((r[H1], r[H2]) for r in whole.collect()) == sorted((r[H1], r[H2]) for r in rows.collect())


KINDS = {
    "timestamp": lambda n: F.timestamp_seconds(n * 5000),
    "timestamp_ntz": lambda n: F.timestamp_seconds(n * 5000).cast("timestamp_ntz"),
    "date": lambda n: F.date_add(F.lit("1970-01-01").cast("date"), n),
    "int": lambda n: n,
    "bigint": lambda n: n.cast("bigint"),
}


@pytest.mark.parametrize("kind", KINDS)
def test_rows_of_buckets(spark, monkeypatch, kind):
    monkeypatch.setattr(late, "BUCKET_ROWS", 20)
    rows = spark.range(200).select(KINDS[kind](F.col("id").cast("int") - 60).alias("at"), "id").unionByName(spark.range(2), allowMissingColumns=True)
    width = late.bucket_width(rows, "at")
    numbered = [(r["id"], r["at"], r[late.BUCKET]) for r in late.with_bucket(rows, "at", width).collect()]
    assert 8 < len({b for _, _, b in numbered}) < 14 and [b for _, at, b in numbered if at is None] == [late.NO_VALUE] * 2
    some = sorted({b for _, at, b in numbered if at is not None})[2:4]
    for wanted in (some, [*some, late.NO_VALUE], [late.NO_VALUE]):
        chosen = spark.createDataFrame([(b,) for b in wanted], f"{late.BUCKET} bigint")
        got = sorted(r["id"] for r in late.in_buckets(rows, "at", width, chosen, len(wanted)).collect())
        assert got == sorted(i for i, _, b in numbered if b in wanted)


def test_late_changed_deleted_and_repeated_rows(spark, vault, same_rows, monkeypatch):
    monkeypatch.setattr(late, "BUCKET_ROWS", 20)
    at = KINDS["timestamp_ntz"](F.col("id").cast("int") - 60)
    rows = spark.range(200).select(F.when(F.col("id") % 50 != 49, at).alias("at"), F.col("id"), F.lit("x").alias("text"), F.array("id").alias("list"))
    old = rows.where("id < 150")
    first = old.where("id <> 20").unionByName(old.where("id in (5, 60)"))  # one late, one repeated row
    second = rows.where("id < 190 and id <> 99 and id <> 30").withColumn("text", F.when(F.col("id").between(100, 120), "y").otherwise("x"))
    third = rows.unionByName(rows.where("id = 149")).where("id <> 199")
    ids = [_backup(vault, df, i, "full" if i == 0 else "incremental") for i, df in enumerate((first, second, third, third))]
    for backup, df in zip(ids, (first, second, third, third)):
        assert same_rows(vault.restore(backup)["t"], df)
        assert vault.verify_content(backup).where("not content_ok").isEmpty()
    modes = [vault.manifest(b).first()["op_mode"] for b in ids]
    assert modes == ["full", "late", "late", "append"]
    assert vault.payload(ids[3], "t").isEmpty()


def test_buckets_that_do_not_decode_are_compared(spark, vault, same_rows, monkeypatch):
    monkeypatch.setattr(late, "CELLS", 1)
    monkeypatch.setattr(late, "BUCKET_ROWS", 50)
    monkeypatch.setattr(late, "MOST_PARTS", 1)
    rows = spark.range(1000).select(F.col("id").alias("at"), F.lit(0).alias("v"))
    hot = spark.range(3000).select(F.lit(500).cast("bigint").alias("at"), F.lit(1).alias("v"))  # one value holds most rows, all alike
    first, second = rows.unionByName(hot), rows.where("at % 3 <> 0").unionByName(hot.limit(2999)).unionByName(hot.withColumn("at", F.lit(2000).cast("bigint")).limit(2))
    ids = [_backup(vault, first, 0, "full"), _backup(vault, second, 1), _backup(vault, first.unionByName(second), 2)]
    for backup, df in zip(ids, (first, second, first.unionByName(second))):
        assert same_rows(vault.restore(backup)["t"], df)


def test_unchanged_state_is_not_read(spark, vault, monkeypatch):
    rows = spark.range(100).select(F.col("id").alias("at"))
    _backup(vault, rows, 0, "full")
    for name in ("compared", "in_buckets", "decoded"):
        monkeypatch.setattr(late, name, None)
    done = _backup(vault, spark.range(130).select(F.col("id").alias("at")), 1)
    assert vault.payload(done, "t").count() == 30


def test_without_a_sketch_or_a_usable_column(spark, vault, same_rows):
    rows = spark.range(10).select(F.col("id").alias("at"))
    _backup(vault, rows, 0, "full", late_rows=False)
    second = _backup(vault, rows.where("at <> 3"), 1)  # no sketch yet: stored full
    assert vault.manifest(second).first()["op_mode"] == "full" and same_rows(vault.restore(second)["t"], rows.where("at <> 3"))
    text = rows.select(F.col("at").cast("string").alias("at"))
    done = vault.backup({"t": text}, BackupRequest(db_name="other", high_water={"t": "at"}, late_rows=True))
    assert not done.success and "no buckets" in done.error
