from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablevault.model import BACKUP_LOGS, JOB_EVENTS
from tablevault.operators import catalog, retention
from tablevault.plans import chains


def job(id, kind, day, status="success", db="d"):
    return (id, db, kind, status, datetime(2024, 1, day))


def frame(spark, *jobs):
    return spark.createDataFrame(list(jobs), "id string, db_name string, backup_type string, status string, started_at timestamp")


CHAIN = [
    job("f1", "full", 1), job("i1", "incremental", 2), job("d1", "differential", 3), job("i2", "incremental", 4),
    job("x", "incremental", 5, "failed"), job("i3", "incremental", 6), job("d2", "differential", 7), job("f2", "full", 8),
    job("i4", "incremental", 9), job("other", "full", 9, db="e"),
]
MEMBERS = {
    "f1": ["f1"], "i1": ["f1", "i1"], "d1": ["d1", "f1"], "i2": ["d1", "f1", "i2"], "i3": ["d1", "f1", "i2", "i3"],
    "d2": ["d2", "f1"], "f2": ["f2"], "i4": ["f2", "i4"],
}


def test_chain_members(spark):
    jobs = frame(spark, *CHAIN)
    for target, want in MEMBERS.items():
        found = chains.restore_chain(jobs, chains.target_of(jobs, target))
        assert sorted(r["id"] for r in found.collect()) == want, target
    assert chains.restore_chain(jobs, chains.target_of(jobs, "x")).isEmpty()
    lengths = {r["id"]: r["chain_length"] for r in chains.backup_chains(jobs).collect()}
    assert lengths == {**{k: len(v) for k, v in MEMBERS.items()}, "other": 1}


def test_chains_of_jobs_close_together(spark):
    """Several jobs within a second, within a day, and across days, against a plain loop."""
    start, rows = datetime(2024, 1, 1, 23, 59, 58), []
    for i in range(120):
        kind = ("full", "incremental", "incremental", "differential", "incremental")[(i * i) % 5]
        rows.append((f"b{i:03d}", f"db{i % 2}", kind, "success", start + timedelta(milliseconds=250 * i, days=i // 50)))
    want = {}
    for db in ("db0", "db1"):
        full = head = inc = None
        for id_, name, kind, _, _ in rows:
            if name != db:
                continue
            if kind == "full":
                full, head, inc = id_, "full", 0
            elif kind == "differential":
                head, inc = "differential", 0
            else:
                inc = (inc or 0) + 1
            by_kind = {"full": 1, "differential": 2, "incremental": 1 + (head == "differential") + (inc or 0)}
            want[id_] = by_kind[kind] if full else None
    got = {r["id"]: r["chain_length"] for r in chains.backup_chains(frame(spark, *rows)).collect()}
    assert got == want


def test_chain_without_full(spark):
    jobs = frame(spark, job("i", "incremental", 1), job("d", "differential", 2))
    assert chains.restore_chain(jobs, chains.latest_targets(jobs)).isEmpty()
    assert {r["chain_length"] for r in chains.backup_chains(jobs).collect()} == {None}


def test_base_selection(spark):
    jobs = frame(spark, *CHAIN)
    before = lambda day, kind=None: [
        r["id"] for r in chains.last_backup(jobs, "d", F.lit(datetime(2024, 1, day)), kind).collect()
    ]
    assert before(6) == ["i2"] and before(6, "full") == ["f1"] and before(1) == []


@pytest.mark.parametrize("as_of_day", range(2, 12))
def test_retention_never_breaks_a_kept_chain(spark, as_of_day):
    jobs = frame(spark, *CHAIN)
    as_of = datetime(2024, 2, as_of_day)
    gone = {r["id"] for r in retention.expired_backups(jobs, F.lit(as_of), 30).collect()}
    cutoff = datetime(2024, 1, as_of_day + 1)
    old = {j[0] for j in CHAIN if j[3] == "success" and j[4] < cutoff}
    kept = [j[0] for j in CHAIN if j[3] == "success" and j[0] not in old]
    needed = {m for k in kept for m in MEMBERS.get(k, [k])}
    assert gone == old - needed


def test_two_jobs_at_the_same_time(spark):
    jobs = frame(spark, job("a", "full", 1), job("b", "full", 1))
    assert [r["id"] for r in catalog.newest(jobs, 1).collect()] == ["b"]
    assert catalog.newest(jobs, 0).isEmpty()
    with pytest.raises(ValueError):
        catalog.newest(jobs, -1)


def events(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in JOB_EVENTS.fields) for r in rows], JOB_EVENTS)


def test_last_write_wins_and_untouched_columns_stay(spark):
    at = datetime(2024, 1, 1)
    state = catalog.current_jobs(
        events(
            spark,
            dict(id="a", seq=0, status="running", db_name="d", started_at=at),
            dict(id="a", seq=1, status="success", file_size=5),
            dict(id="b", seq=0, status="running", db_name="d", started_at=at),
            dict(id="c", seq=1, status="failed", error="first insert was lost"),
        )
    )
    got = {r["id"]: (r["status"], r["db_name"], r["file_size"]) for r in state.collect()}
    assert got == {"a": ("success", "d", 5), "b": ("running", "d", None), "c": ("failed", None, None)}


def test_job_with_logs(spark):
    jobs = frame(spark, job("a", "full", 1), job("b", "full", 2))
    at = datetime(2024, 1, 1)
    logs = spark.createDataFrame([(2, "a", at, "error", "m2", None), (1, "a", at, "info", "m1", "{}"), (3, "zz", at, "info", "m", None)], BACKUP_LOGS)
    assert [e["id"] for e in catalog.job_with_logs(jobs, logs, "a").first()["logs"]] == [1, 2]
    assert catalog.job_with_logs(jobs, logs, "b").first()["logs"] == []
    assert catalog.job_with_logs(jobs, logs, "none").isEmpty()
    flat = [(r["id"], r["log_id"]) for r in catalog.jobs_with_log_rows(jobs, logs).collect()]
    assert sorted(flat, key=str) == [("a", 1), ("a", 2), ("b", None)]
    assert [r["backup_job_id"] for r in catalog.orphan_logs(logs, jobs).collect()] == ["zz"]
    assert catalog.count_jobs(jobs).first()["backups"] == 2


def test_list_plan_is_a_top_k(spark):
    plan = catalog.newest(frame(spark, *CHAIN))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_lookups_by_id_read_that_entry_only(spark, vault):
    from tablevault import BackupRequest

    runs = [vault.backup({"t": spark.range(3 + i)}, BackupRequest(db_name="s")) for i in range(3)]
    mine = runs[1].backup_id
    for found in (vault.manifest(mine), vault.files(mine), vault.status(mine)):
        assert found.count() >= 1
        assert all(mine in f for f in found.inputFiles())
    assert vault.manifest("nobody").count() == 0 and vault.status("nobody").count() == 0
