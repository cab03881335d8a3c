"""Snapshots and tails of the catalog: bounded listings, compactors and writers side by side."""

import glob
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tablevault import BackupRequest
from tablevault.catalog_store import CatalogStore
from tablevault.model import BACKUP_LOGS, JOB_EVENTS

AT = datetime(2024, 5, 1, tzinfo=timezone.utc)


def many_runs(spark, vault, runs):
    """Entries as so many runs would leave them: two events and a log each, in folders of their own."""
    for name, schema, key in (("job_events", JOB_EVENTS, "id"), ("backup_logs", BACKUP_LOGS, "backup_job_id")):
        ids = F.concat(F.lit("db_"), F.col("run").cast("string"))
        rows = spark.range(runs).withColumnRenamed("id", "run").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)) if name == "job_events" else F.array(F.lit(1))))
        given = {key: ids, "seq": F.col("n"), "status": F.when(F.col("n") == 0, "running").otherwise("success"), "level": F.lit("info"), "db_name": F.lit("db"), "started_at": F.lit(AT)}
        if name == "backup_logs":
            given["id"] = F.col("run")
        columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        entry = F.concat(ids, F.lit("-"), F.col("n").cast("string"))
        out = rows.select(*columns, F.lit("2024-05").alias("month"), entry.alias("entry"))
        out.repartition(8, "entry").write.partitionBy("month", "entry").parquet(f"{vault.root}/catalog/{name}")
        for folder in glob.glob(f"{vault.root}/catalog/{name}/month=*/entry=*"):
            open(f"{folder}/_SUCCESS", "w").close()


def test_lookups_after_a_thousand_runs(spark, vault):
    many_runs(spark, vault, 1000)
    assert vault.store.tail("job_events") == 2000
    vault.compact()
    vault.compact()
    done = vault.backup({"t": spark.range(3)}, BackupRequest(db_name="db"))
    assert done.success and vault.store.tail("job_events") == 2
    for id_, kind in (("db_77", "success"), (done.backup_id, "success")):
        job = vault.status(id_)
        assert len(job.inputFiles()) <= 6
        assert [r["status"] for r in job.collect()] == [kind]
    assert vault.jobs().count() == 1001 and vault.logs().count() == 1001
    vault.compact()  # the next generation removes what the one before took in
    for name in ("job_events", "backup_logs"):
        assert len(glob.glob(f"{vault.root}/catalog/{name}/month=*/entry=*")) <= 2
        assert len(glob.glob(f"{vault.root}/catalog/{name}/snapshots/*")) <= 2
    assert vault.jobs().count() == 1001 and vault.status("db_77").count() == 1
    assert vault.restore(done.backup_id)["t"].count() == 3


def test_writers_and_compactors_side_by_side(spark, tmp_path):
    """Every entry is seen once at any time, and none is lost."""
    store, schema = CatalogStore(spark, str(tmp_path)), spark.range(0).schema
    seen = []

    def write(k):
        for i in range(6):
            store.append("n", spark.range(100 * k + i + 10, 100 * k + i + 11, 1, 1), "2024-01", f"w{k}")

    def compact(_):
        for _i in range(4):
            store.compact("n", schema, "id")

    def read(_):
        for _i in range(4):
            rows = [r["id"] for r in store.read("n", schema).collect()]
            seen.append(len(rows) == len(set(rows)))

    with ThreadPoolExecutor(6) as pool:
        jobs = [pool.submit(write, k) for k in range(3)] + [pool.submit(compact, k) for k in range(2)] + [pool.submit(read, 0)]
        [j.result() for j in jobs]
    assert all(seen)
    want = {100 * k + i + 10 for k in range(3) for i in range(6)}
    rows = [r["id"] for r in store.read("n", schema).collect()]
    assert len(rows) == len(want) and set(rows) == want
    store.append("n", spark.range(7, 8), "2024-01", "late")
    store.compact("n", schema, "id")
    assert sorted(r["id"] for r in store.read("n", schema).collect()) == sorted(want | {7})


def test_a_slower_compactor_starts_again(spark, tmp_path, monkeypatch):
    from tablevault import catalog_store

    store, schema = CatalogStore(spark, str(tmp_path)), spark.range(0).schema
    store.append("n", spark.range(2), "2024-01", "a")
    create, calls = catalog_store.create_exclusively, []

    def overtaken(session, path, text):
        calls.append(path)
        if len(calls) == 1:
            monkeypatch.setattr(catalog_store, "create_exclusively", create)
            store.append("n", spark.range(5, 6), "2024-01", "b")
            assert CatalogStore(spark, str(tmp_path)).compact("n", schema, "id")
        return create(session, path, text)

    monkeypatch.setattr(catalog_store, "create_exclusively", overtaken)
    assert store.compact("n", schema, "id")
    assert sorted(r["id"] for r in store.read("n", schema).collect()) == [0, 1, 5]


def test_an_unfinished_entry_is_not_read(spark, tmp_path):
    store, schema = CatalogStore(spark, str(tmp_path)), spark.range(0).schema
    spark.range(9).write.parquet(f"{tmp_path}/n/month=2024-01/entry=a-1")
    (tmp_path / "n/month=2024-01/entry=a-1/_SUCCESS").unlink()
    assert store.read("n", schema).count() == 0
    store.append("n", spark.range(2), "2024-02", "b")
    assert store.read("n", schema).count() == 2 and store.read("n", schema, since_month="2024-03").count() == 0


@pytest.mark.parametrize("n", [0, 70])
def test_runs_compact_by_themselves(spark, vault, n):
    for _ in range(1):
        if n:
            many_runs(spark, vault, n)
        assert vault.backup({"t": spark.range(3)}, BackupRequest(db_name="db")).success
        assert vault.store.tail("job_events") == (0 if n else 2)
    assert vault.jobs().count() == n + 1
