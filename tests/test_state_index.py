"""Indexes of states: plans of incrementals, levels, ranges that are opened, and the same deltas as without an index."""

import json
import random

import pytest
from compare import SMALL
from pyspark.sql import functions as F

from tablevault import BackupRequest
from tablevault.functions.fingerprint import FINGERPRINT, with_fingerprint
from tablevault.operators import delta, state_index
from tablevault.plans import fixtures as fx

KEYED = dict(db_name="s", keys={"t": ["id"]})
BAG = dict(db_name="s")


def index_of(vault, done, table="t"):
    return json.loads(vault.manifest(done.backup_id).where(F.col("table_name") == table).first()["index_json"])


def run(vault, df, kind, options):
    done = vault.backup({"t": df}, BackupRequest(backup_type=kind, **options))
    assert done.success, done.error
    return done


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_incremental_reads_no_wide_base(spark, vault, monkeypatch):
    """The plan that finds changes scans the source and the index only, and does not shuffle the index."""
    plans = []
    seen = vault._materialize
    monkeypatch.setattr(vault, "_materialize", lambda df, *a, **k: plans.append((plan_of(df), df.inputFiles())) or seen(df, *a, **k))
    now = fx.table(spark, SMALL, "orders")
    options = dict(db_name="s", keys={"orders": ["o_orderkey"]})
    monkeypatch.setattr(state_index, "BUCKET_BYTES", 1024)
    for i, kind in enumerate(["full", "incremental", "incremental"]):
        done = vault.backup({"orders": now.where(f"o_orderkey % 50 <> {i}")}, BackupRequest(backup_type=kind, **options))
        assert done.success, done.error
    assert len(plans) == 2
    for plan, files in plans:
        own = {f.split("/vault/")[1].split("/")[0] for f in files if "/vault/" in f}
        assert own == {"index"} and "Bucketed: true" in plan
    assert plans[0][0].count("Exchange hashpartitioning") == 1


def test_keyed_index_through_many_levels(spark, vault, same_rows):
    """A long chain merges runs and bases; each delta and each restore is right, and few parts are left."""
    rng, kept, most = random.Random(3), {i: "a" for i in range(60)}, 0
    frame = lambda: spark.createDataFrame(list(kept.items()), "id int, v string")
    run(vault, frame(), "full", KEYED)
    levels = set()
    for _ in range(5):
        for k in rng.sample(range(80), 3):
            if k in kept and rng.random() < 0.5:
                del kept[k]
            else:
                kept[k] = rng.choice("abc")
        done = run(vault, frame(), "incremental", KEYED)
        parts = index_of(vault, done)["parts"]
        most = max(most, len(parts))
        levels |= {p["level"] for p in parts}
        base, runs = vault._key_parts(index_of(vault, done), frame(), ["id"])
        state = state_index.keyed_base(base, runs, ["id"]) if runs else base
        assert same_rows(state.select("id", *FINGERPRINT), with_fingerprint(frame()).select("id", *FINGERPRINT))
    assert same_rows(vault.restore(done.backup_id)["t"], frame())
    assert most <= 1 + state_index.FAN + 2 and len(levels) > 1


def test_keyless_index_through_many_levels(spark, vault, same_rows):
    rng, bag = random.Random(4), [(i % 40, "x") for i in range(90)] + [(None, None)] * 5
    frame = lambda: spark.createDataFrame(bag, "a int, b string")
    run(vault, frame(), "full", BAG)
    for _ in range(5):
        bag = [r for r in bag if rng.random() < 0.98] + [(rng.randint(0, 50), rng.choice("xy"))]
        done = run(vault, frame(), "incremental", BAG)
        index = index_of(vault, done)
        base = state_index.read_bands(spark, f"{vault.root}/{index['parts'][0]['path']}")
        runs = [state_index.read_multiset_run(spark, f"{vault.root}/{p['path']}") for p in index["parts"][1:]]
        state = state_index.multiset_base(base, runs) if runs else base
        want = with_fingerprint(frame()).groupBy(*FINGERPRINT).agg(F.count("*").alias(delta.COPIES))
        assert same_rows(state.select(*want.columns), want)
        tree = state_index.tree(want, index["bits"], delta.COPIES)
        assert state_index.differing(vault._tree(index["tree"]), tree) == ([], None)
        assert same_rows(vault.restore(done.backup_id)["t"], frame())


def test_cost_follows_the_change(spark, vault, monkeypatch):
    """One changed row of 60,000: the index rows that are read lie in the ranges of that row's old and new fingerprint."""
    monkeypatch.setattr(state_index, "RANGE_ROWS", 1000)
    df = spark.range(60_000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    run(vault, df, "full", BAG)
    run(vault, df.withColumn("v", F.when(F.col("id") == 5, 99).otherwise(F.col("v"))), "incremental", BAG)
    read = []
    within = state_index.within
    monkeypatch.setattr(state_index, "within", lambda part, *a: read.append(part.count()) or within(part, *a))
    changed = df.withColumn("v", F.when(F.col("id") == 6, 98).when(F.col("id") == 5, 99).otherwise(F.col("v")))
    done = run(vault, changed, "incremental", BAG)
    assert vault.payload(done.backup_id, "t").count() == 2
    assert 0 < read[1] <= 2 * 60_000 / 64 * 1.5  # of the base: two of 64 ranges
    read.clear()
    run(vault, changed, "incremental", BAG)
    assert read == []  # equal roots: nothing is opened


def test_same_changes_as_without_an_index(spark):
    first, before, now = fx.order_states(spark, SMALL)
    prints = state_index.key_prints(first, ["o_orderkey"]).select("o_orderkey", *FINGERPRINT)
    step = delta.keyed_changes(before, first, ["o_orderkey"])
    runs = [step.select("o_orderkey", F.col("op").alias(delta.OP), F.col("cur_h1").alias(FINGERPRINT[0]), F.col("cur_h2").alias(FINGERPRINT[1]))]
    got = state_index.keyed_changes(now, prints, runs, ["o_orderkey"])
    want = delta.keyed_changes(now, before, ["o_orderkey"])
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_bad_keys_are_refused(spark, vault):
    once = spark.range(5)
    for bad in (once.union(once.limit(1)), once.union(spark.sql("select cast(null as bigint)"))):
        done = vault.backup({"t": bad}, BackupRequest(**KEYED))
        assert not done.success and "not a key" in done.error
    run(vault, once, "full", KEYED)
    done = vault.backup({"t": once.union(once.limit(1))}, BackupRequest(backup_type="incremental", **KEYED))
    assert not done.success and "not a key" in done.error


def test_a_failed_run_leaves_no_index(spark, vault, tmp_path):
    import os

    broken = spark.range(3).withColumn("x", F.when(F.rand(1) >= 0, F.raise_error(F.lit("no"))).cast("string"))
    done = vault.backup({"t": spark.range(3), "u": broken}, BackupRequest(db_name="s", keys={"t": ["id"], "u": ["id"]}))
    assert not done.success and not os.path.exists(f"{vault.root}/index/{done.backup_id}")


@pytest.mark.parametrize("rows, bits", [(0, 3), (2_000_000, 3), (2_000_001, 4), (10**15, 16)])
def test_ranges_follow_the_rows(rows, bits):
    assert state_index.band_bits(rows) == bits


def test_damage_is_found_by_range(spark, vault):
    df = spark.range(5000).select("id", (F.col("id") % 9).alias("v"))
    run(vault, df, "full", BAG)
    done = run(vault, df.where("id <> 4"), "incremental", BAG)
    assert vault.differing_ranges(done.backup_id, "t").isEmpty()
    full = vault.chain(done.backup_id)[0]["file_path"]
    df.where("id not in (17, 18)").coalesce(1).write.mode("overwrite").parquet(f"{full}/t")
    found = vault.differing_ranges(done.backup_id, "t").collect()
    assert len(found) in (1, 2) and sum(r["recorded_rows"] - r["found_rows"] for r in found) == 2
    with pytest.raises(ValueError):
        vault.differing_ranges(vault.chain(done.backup_id)[0]["id"], "t")
