"""Chains of deltas, the broadcast and the shuffled path of each, and repeated rows."""

import random

import pytest
from compare import SMALL
from pyspark.sql import functions as F

from tablevault import BackupRequest
from tablevault.functions.fingerprint import FINGERPRINT, with_fingerprint
from tablevault.operators import delta, restore
from tablevault.plans import fixtures as fx


@pytest.fixture(params=["broadcast", "shuffled"])
def path(request, monkeypatch, spark):
    """Both ways of joining with a change list give the same result."""
    if request.param == "shuffled":
        monkeypatch.setattr(delta, "BROADCAST_BYTES", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        yield request.param
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    else:
        yield request.param


OPTIONS = dict(keys={"orders": ["o_orderkey"]}, high_water={"events": "ts"})


def test_chains_of_all_types(spark, vault, same_rows, path):
    """Full, then deltas of both types; each backup restores to its own state."""
    names = ("orders", "lineitem", "events")
    states = list(zip(fx.order_states(spark, SMALL), fx.lineitem_states(spark, SMALL), fx.event_states(spark, SMALL)))
    pairs = [("incremental", "incremental")] + ([("differential", "incremental")] if path == "broadcast" else [])
    for i, types in enumerate(pairs):
        for kind, state in zip(("full", *types), states):
            done = vault.backup(dict(zip(names, state)), BackupRequest(db_name=f"db{i}", backup_type=kind, **OPTIONS))
            assert done.success, done.error
            back = vault.restore(done.backup_id)
            for name, df in zip(names, state):
                assert same_rows(back[name], df), (types, kind, name)
            # writing checks the digest carried along the chain without reading the state
            vault.restore_to(done.backup_id, f"{vault.root}/out/{done.backup_id}")
            assert vault.verify_content(done.backup_id).where("not content_ok").isEmpty()


def test_long_chain_against_plain_sets(spark, vault):
    """Random states of a keyed and a key-less table, compared with what Python kept."""
    rng = random.Random(7)
    keyed, bag, kept = {}, [], []
    kinds = ["full", "incremental", "incremental", "differential", "incremental", "incremental", "full", "differential"]
    for kind in kinds:
        for k in range(12):
            if rng.random() < 0.4:
                keyed[k] = rng.choice(["a", "b", None])
            elif rng.random() < 0.3:
                keyed.pop(k, None)
        bag = [v for v in bag if rng.random() < 0.7] + [rng.choice([(1, None), (None, 1), (2, 2)]) for _ in range(4)]
        tables = {
            "k": spark.createDataFrame(list(keyed.items()), "id int, v string"),
            "b": spark.createDataFrame(bag, "x int, y int"),
        }
        done = vault.backup(tables, BackupRequest(db_name="d", backup_type=kind, keys={"k": ["id"]}))
        assert done.success, done.error
        kept.append((done.backup_id, dict(keyed), list(bag)))
    for backup_id, k, b in kept:
        back = vault.restore(backup_id)
        assert dict(map(tuple, back["k"].collect())) == k
        none_first = lambda r: tuple((v is not None, v or 0) for v in r)
        assert sorted(map(tuple, back["b"].collect()), key=none_first) == sorted(b, key=none_first)


def test_first_delta_without_full_runs_as_full(spark, vault):
    done = vault.backup({"t": spark.range(5)}, BackupRequest(db_name="d", backup_type="incremental"))
    job = vault.jobs().first()
    assert done.success and job["backup_type"] == "full" and job["parent_id"] is None


def test_schema_change_and_new_table_are_stored_full(spark, vault, same_rows):
    request = lambda kind: BackupRequest(db_name="d", backup_type=kind, keys={"t": ["id"]})
    assert vault.backup({"t": spark.range(5)}, request("full")).success
    wider = spark.range(6).withColumn("v", F.col("id") * 2)
    second = vault.backup({"t": wider, "new": spark.range(2)}, request("incremental"))
    third = vault.backup({"t": wider.where("id <> 3"), "new": spark.range(3)}, request("incremental"))
    modes = lambda r: {m["table_name"]: m["op_mode"] for m in vault.manifest(r.backup_id).collect()}
    assert modes(second) == {"t": "full", "new": "full"}
    assert modes(third) == {"t": "keyed", "new": "multiset"}
    assert same_rows(vault.restore(third.backup_id)["t"], wider.where("id <> 3"))
    assert same_rows(vault.restore(second.backup_id)["t"], wider)


def test_change_of_key_is_stored_full(spark, vault):
    """A state stored without a key may hold repeated keys, so a keyed delta cannot build on it."""
    rows = spark.createDataFrame([(1, "a"), (1, "a")], "id int, v string")
    keyless, keyed = BackupRequest(db_name="d"), BackupRequest(db_name="d", backup_type="incremental", keys={"t": ["id"]})
    assert vault.backup({"t": rows}, keyless).success
    done = vault.backup({"t": rows.limit(1)}, keyed)
    assert vault.manifest(done.backup_id).first()["op_mode"] == "full"
    assert vault.restore(done.backup_id)["t"].count() == 1


def test_partial_backups_share_a_chain(spark, vault, same_rows):
    request = lambda kind, *t: BackupRequest(db_name="d", backup_type=kind, tables=list(t), keys={"a": ["id"], "b": ["id"]})
    make = lambda n: {"a": spark.range(n), "b": spark.range(n * 10)}
    vault.backup(make(1), request("full"))
    vault.backup(make(2), request("incremental", "a"))
    vault.backup(make(3), request("incremental", "b"))
    last = vault.backup(make(4), request("incremental"))
    back = vault.restore(last.backup_id)
    assert same_rows(back["a"], spark.range(4)) and same_rows(back["b"], spark.range(40))


@pytest.mark.parametrize("rows", [[(1, "a"), (1, "b")], [(None, "a")]])
@pytest.mark.parametrize("kind", ["full", "incremental"])
def test_bad_keys_are_refused(spark, vault, kind, rows):
    request = lambda k: BackupRequest(db_name="d", backup_type=k, keys={"t": ["id"]})
    if kind != "full":
        assert vault.backup({"t": spark.createDataFrame([(1, "a")], "id int, v string")}, request("full")).success
    done = vault.backup({"t": spark.createDataFrame(rows, "id int, v string")}, request(kind))
    assert not done.success and "not a key" in done.error


def test_changing_source_is_noticed(spark, vault):
    vault.backup({"t": spark.range(5).withColumn("v", F.lit("x"))}, BackupRequest(db_name="d", keys={"t": ["id"]}))
    reread = _Flaky(spark)
    done = vault.backup({"t": reread.frame()}, BackupRequest(db_name="d", backup_type="incremental", keys={"t": ["id"]}))
    assert not done.success and "changed while it was read" in done.error


class _Flaky:
    """A frame whose rows depend on when they are read."""

    def __init__(self, spark):
        self.spark = spark

    def frame(self):
        import time

        import pandas as pd

        @F.pandas_udf("string")
        def now(ids: pd.Series) -> pd.Series:
            return ids.map(lambda _i: str(time.time_ns()))

        return self.spark.range(5).withColumn("v", now("id"))


def test_rows_repeated_very_often(spark, monkeypatch, path):
    """A row that fills most of the table, with chunks forced to be small."""
    monkeypatch.setattr(delta, "COPY_CHUNK", 100)
    hot = spark.range(3000).select(F.lit("hot").alias("v"), F.lit(1).alias("n"))
    rest = spark.range(500).select(F.col("id").cast("string").alias("v"), F.lit(None).cast("int").alias("n"))
    prev, cur = hot.unionByName(rest), hot.limit(1234).unionByName(rest.where("v <> '7'")).unionByName(rest.where("v = '9'"))
    changes = delta.multiset_changes(cur, prev)
    totals = changes.agg(*delta.multiset_change_totals()).first()
    assert (totals["upserts"], totals["deletes"]) == (1, 1766 + 1)
    payload = delta.multiset_payload(cur, prev, changes, totals["present"], totals["gone"])
    back = restore.apply_multiset(prev, [payload], totals["touched"])
    assert {r["v"]: r["count"] for r in back.groupBy("v").count().collect() if r["v"] in ("hot", "7", "9", "8")} == {"hot": 1234, "9": 2, "8": 1}
    back_again = delta.multiset_changes(prev, cur)
    t = back_again.agg(*delta.multiset_change_totals()).first()
    grown = restore.apply_multiset(cur, [delta.multiset_payload(prev, cur, back_again, t["present"], t["gone"])], t["touched"])
    assert grown.exceptAll(prev).isEmpty() and prev.exceptAll(grown).isEmpty()


def test_high_water_filter_reaches_the_scan(spark):
    e = fx.table(spark, SMALL, "events")
    plan = delta.after_high_water(e, "ts", "2024-01-20 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan


def test_high_water_survives_another_time_zone(spark, vault):
    e = fx.table(spark, SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    request = lambda kind: BackupRequest(db_name="d", backup_type=kind, high_water={"events": "ts"})
    middle = F.timestamp_micros(F.lit(1705276800000000))
    assert vault.backup({"events": e.where(F.col("ts") < middle)}, request("full")).success
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        e = e.withColumn("ts", F.timestamp_micros(F.unix_micros("ts")))
        done = vault.backup({"events": e}, request("incremental"))
        assert done.success, done.error
        assert vault.restore(done.backup_id)["events"].count() == vault.manifest(done.backup_id).first()["state_rows"]
        late = e.where(F.col("ts") > e.where(F.col("ts") < middle).agg(F.max("ts")).first()[0]).count()
        assert vault.manifest(done.backup_id).first()["row_count"] == late > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_high_water_of_empty_base(spark, vault):
    e = fx.table(spark, SMALL, "events")
    request = lambda kind: BackupRequest(db_name="d", backup_type=kind, high_water={"events": "ts"})
    assert vault.backup({"events": e.limit(0)}, request("full")).success
    done = vault.backup({"events": e}, request("incremental"))
    again = vault.backup({"events": e}, request("incremental"))
    assert vault.restore(done.backup_id)["events"].count() == e.count()
    assert vault.manifest(again.backup_id).first()["row_count"] == 0
    assert vault.restore(again.backup_id)["events"].count() == e.count()


def test_keyed_change_plan(spark):
    """Two shuffles, of keys and hashes only; the join reuses the partitioning by key."""
    first, before, now = fx.order_states(spark, SMALL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = delta.keyed_changes(now, fx.table(spark, SMALL, "orders"), ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning(o_orderkey") == 2


def test_change_pass_carries_keys_and_fingerprints_only(spark, vault):
    """With broadcasts off, no exchange under the change pass holds a column that is neither key nor fingerprint."""
    import re

    wide = lambda n: spark.range(n).selectExpr("id", "cast(id as string) secret_a", "id * 2 secret_b")
    request = lambda kind, keys: BackupRequest(db_name="s", backup_type=kind, keys=keys)
    for keys in ({"t": ["id"]}, {}):
        vault.root += "x"
        vault.backup({"t": wide(30)}, request("full", keys))
        vault.backup({"t": wide(25)}, request("incremental", keys))
        members = vault.chain(vault.jobs().where("backup_type = 'incremental'").first()["id"])
        steps = vault._steps(members)["t"]
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            prints = vault._prints(steps, keys.get("t"))
            changes = delta.keyed_changes(wide(20), prints, ["id"]) if keys else delta.multiset_changes(wide(20), prints)
            plan = spark._jvm.PythonSQLUtils.explainString(changes._jdf.queryExecution(), "formatted")
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        inputs = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*)\]", plan)
        assert inputs and not any("secret" in i for i in inputs), inputs
        assert changes.count() == 5


def test_copies_are_combined_before_they_move(spark, monkeypatch):
    """In the shuffled form a partial aggregation by fingerprint stands below the only exchange of the rows."""
    monkeypatch.setattr(delta, "BROADCAST_BYTES", -1)
    rows = spark.range(2000).selectExpr("id % 3 as v")
    changes = delta.multiset_changes(rows.limit(900), rows)
    plan = delta._one_of_each(rows, changes, 3)._jdf.queryExecution().executedPlan().toString().split("\n")
    tops = [i for i, line in enumerate(plan) if "Aggregate(key" in line and "[_tv_h1" in line and "functions=[first(" in line]
    ups = [i for i, line in enumerate(plan) if "Aggregate(key" in line and "[_tv_h1" in line and "functions=[partial_first(" in line]
    between = plan[tops[0] : ups[0]]
    assert sum("Exchange" in line for line in between) == 1, plan
    assert delta._one_of_each(rows, changes, 3).count() == 3


@pytest.mark.parametrize("count", [1, 3000])
def test_a_sieve_parts_rows_without_losing_any(spark, count):
    rows = with_fingerprint(spark.range(4000).selectExpr("id", "if(id % 7 = 0, null, id) v").unionByName(spark.range(9).selectExpr("id", "null v")))
    wanted = rows.where(F.col("id") < count).select(*FINGERPRINT)
    bits = delta.sieve_bits(count)
    held, free = delta.sifted(rows, wanted, bits), delta.sifted(rows, wanted, bits, held=False)
    assert held.columns == rows.columns == free.columns
    assert held.unionByName(free).exceptAll(rows).isEmpty() and rows.exceptAll(held.unionByName(free)).isEmpty()
    assert free.where(F.col("id") < count).isEmpty() and held.count() < 4009 * (0.05 if count == 1 else 0.9)
    empty = rows.where("id < 0").select(*FINGERPRINT)
    assert delta.sifted(rows, empty, 16).isEmpty() and delta.sifted(rows, empty, 16, held=False).count() == 4009


def test_only_rows_that_may_have_changed_are_sorted_and_moved(spark, vault, monkeypatch, same_rows):
    """Without broadcasts, the restore and the payload of a long chain shuffle wide rows behind a sieve only; gone, changed and repeated rows come right."""
    monkeypatch.setattr(delta, "BROADCAST_BYTES", -1)
    state = lambda a, b, twice: spark.range(a, b).selectExpr("id", "concat('v', id % 5) v").unionByName(spark.range(a, b).where(f"id % {twice} = 0").selectExpr("id", "concat('v', id % 5) v"))
    states = [state(0, 300, 2), state(20, 330, 3), state(0, 340, 2), state(10, 340, 5)]
    for i, df in enumerate(states):
        done = vault.backup({"t": df}, BackupRequest(db_name="s", backup_type="incremental" if i else "full"))
        assert done.success, done.error
        back = vault.restore(done.backup_id)["t"]
        assert same_rows(back, df)
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line and "strategy=broadcast" not in line]
    assert all("LeftAnti" in line for line in joins) and "Window" not in plan and "bitmap_construct_agg" in plan
