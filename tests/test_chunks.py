"""Content-addressed fulls, and the sweep that frees what no kept backup names."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tablevault import BackupRequest
from tablevault.vault import Vault

NOW = datetime.now(timezone.utc)


def request(**more):
    return BackupRequest(db_name="s", dedup=True, **more)


def take(vault, df, at=None, **more):
    done = vault.backup({"t": df}, request(**more), at)
    assert done.success, done.error
    return done


def parts(done, table="t"):
    return [f for _, _, names in os.walk(f"{done.file_path}/{table}") for f in names if f.endswith(".parquet")]


def table(spark, n=2000):
    return spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(None).alias("z"))


def test_an_unchanged_table_is_not_written_again(spark, vault, same_rows):
    df = table(spark)
    first, second = take(vault, df), take(vault, df.repartition(7))
    assert len(parts(first)) == 16 and parts(second) == [] and second.file_size == 0
    assert first.raw_size == second.raw_size
    changed = df.withColumn("v", F.when(F.col("id") == 7, "x").otherwise(F.col("v"))).unionByName(df.where("id = 9"))
    third = take(vault, changed)
    assert 0 < len(parts(third)) <= 3
    for done, want in ((first, df), (second, df), (third, changed)):
        assert same_rows(vault.restore(done.backup_id)["t"], want)
        assert {r["status"] for r in vault.verify_files(done.backup_id).collect()} == {"ok"}
        assert vault.verify_content(done.backup_id).first()["content_ok"]
    assert vault.restore_to(third.backup_id, f"{vault.root}/out") == {"t": 2001}


def test_deltas_on_chunks_and_empty_tables(spark, vault, same_rows):
    df = table(spark, 300)
    done = vault.backup({"t": df, "none": df.limit(0), "k": df}, request(keys={"k": ["id"]}))
    assert done.success, done.error
    later = df.where("id <> 5").unionByName(df.where("id = 6"))
    done = vault.backup({"t": later, "none": df.limit(0), "k": df.where("id <> 5")}, request(backup_type="incremental", keys={"k": ["id"]}))
    assert done.success, done.error
    back = vault.restore(done.backup_id)
    assert same_rows(back["t"], later) and back["none"].isEmpty() and same_rows(back["k"], df.where("id <> 5"))


def test_a_damaged_chunk_shows_in_every_backup_that_names_it(spark, vault):
    df = table(spark)
    first, second = take(vault, df), take(vault, df)
    folder = sorted(p for p, _, names in os.walk(f"{first.file_path}/t") if any(n.endswith(".parquet") for n in names))[0]
    for name in os.listdir(folder):
        os.remove(f"{folder}/{name}")
    for done in (first, second):
        assert {r["status"] for r in vault.verify_files(done.backup_id).collect()} == {"ok", "missing"}
        assert not vault.verify_content(done.backup_id).first()["content_ok"]


def test_sweep_frees_what_no_kept_backup_names(spark, vault, same_rows):
    old, kept = table(spark), table(spark).where("id <> 3")
    first = take(vault, old, NOW - timedelta(days=60))
    second = take(vault, kept, NOW - timedelta(days=1))
    own = {f"chunk={r['name']}" for r in vault._read("chunks").where(F.col("backup_id") == first.backup_id).collect()}
    named = {os.path.basename(p) for p in vault._chunk_paths(second.backup_id, "t")}
    assert vault.expire(F.lit(NOW)) == 1
    assert len(parts(first)) == 16  # chunks of an expired backup wait
    assert vault.sweep() == 0 and len(parts(first)) == 16  # condemned
    assert vault.sweep() == len(own - named) == 1
    assert len(parts(first)) == 15
    assert same_rows(vault.restore(second.backup_id)["t"], kept)
    assert {r["status"] for r in vault.verify_files(second.backup_id).collect()} == {"ok"}
    again = take(vault, old)  # rows of the chunk that went are written anew
    assert len(parts(again)) == 1 and same_rows(vault.restore(again.backup_id)["t"], old)
    assert vault.sweep() == 0


def test_a_run_in_between_keeps_what_it_found(spark, vault, same_rows):
    """A run that is under way when chunks are condemned may name them afterwards."""
    df = table(spark)
    first = take(vault, df, NOW - timedelta(days=60))
    vault._append_row("job_events", NOW, id="s_open", seq=0, db_type="postgresql", db_name="s", status="running", backup_type="full", started_at=NOW - timedelta(minutes=5))
    assert vault.expire(F.lit(NOW)) == 1
    assert vault.sweep() == 0 and vault.sweep() == 0 and len(parts(first)) == 16
    rows = vault._read("chunks").withColumn("backup_id", F.lit("s_open"))
    vault._append("chunks", rows, NOW, "s_open")
    vault._append_row("job_events", NOW, id="s_open", seq=1, status="success", file_path=f"{vault.root}/data/s_open", completed_at=NOW)
    assert vault.sweep() == 0 and len(parts(first)) == 16
    later = take(vault, df)  # condemned chunks are not used by a run that begins later
    assert len(parts(later)) == 16 and same_rows(vault.restore(later.backup_id)["t"], df)


def test_leftovers_of_failed_and_dead_runs(spark, vault):
    good = vault.backup({"t": spark.range(10)}, BackupRequest(db_name="s"))
    bad = vault.backup({"t": spark.range(10), "u": spark.range(3).select(F.raise_error(F.lit("no")).cast("string"))}, BackupRequest(db_name="s"))
    assert good.success and not bad.success
    for job, hours in (("s_dead", 30), ("s_busy", 2)):
        spark.range(3).write.parquet(f"{vault.root}/data/{job}/t")
        vault._append_row("job_events", NOW, id=job, seq=0, db_type="postgresql", db_name="s", status="running", backup_type="full", started_at=NOW - timedelta(hours=hours))
    left = vault.sweep(now=NOW - timedelta(hours=4))
    assert left == 0
    assert vault.sweep() >= 1
    assert not os.path.exists(f"{vault.root}/data/s_dead/t") and os.path.exists(f"{vault.root}/data/s_busy/t")
    assert not os.path.exists(f"{vault.root}/data/{bad.backup_id}/t")
    assert vault.restore(good.backup_id)["t"].count() == 10


def test_a_vault_opened_by_another_spelling_of_its_root(spark, vault):
    done = take(vault, table(spark, 100))
    same = Vault(spark, f"file:{vault.root}")
    assert same.sweep() == 0 and same.sweep() == 0
    assert len(parts(done)) == 16 and vault.restore(done.backup_id)["t"].count() == 100


def test_size_cap_of_a_chunked_run(spark, vault):
    done = vault.backup({"t": table(spark)}, request(max_size="1k"))
    assert not done.success and "more than 1k" in done.error
    assert vault.backup({"t": table(spark)}, request()).success


@pytest.mark.parametrize("size", [0, 1])
def test_units_of_an_empty_vault(spark, vault, size):
    assert vault.units().count() == 0 and vault.sweep() == 0
