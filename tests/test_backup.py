from datetime import date, datetime
from decimal import Decimal

import pytest
from compare import SMALL
from pyspark.sql import functions as F

from tablevault import BackupRequest
from tablevault.plans.fixtures import ALL_TABLES
from tablevault.sources.tables import parquet_tables
from tablevault.vault import DigestMismatch, Vault

EDGE = (
    "s string, i int, b bigint, d double, f float, n decimal(38,0), x binary, t timestamp, u timestamp_ntz, day date, "
    "flag boolean, a array<string>, g array<float>, m map<string,int>, r struct<p:int,q:string>, z void"
)


def edge_rows(spark):
    t = datetime(1900, 1, 1)
    rows = [
        ("", 1, 2**63 - 1, float("nan"), -0.0, Decimal("9" * 38), b"\x00\xff", t, t, date(1900, 1, 1), True, [], [], {}, (None, None), None),
        (None, None, -(2**63), None, None, None, None, None, None, None, None, None, None, None, None, None),
        ("a\nb,\"c\" ", 3, 0, 1.5, 2.5, Decimal(-1), b"", datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2024, 1, 1, 0, 0, 0, 2),
         date(2024, 2, 29), False, ["a", None], [1.0, None], {"k": 1, "j": None}, (1, "é"), None),
        (" é ", 3, 0, 1.5, 2.5, Decimal(-1), b"", datetime(2024, 1, 1, 0, 0, 0, 2), datetime(2024, 1, 1, 0, 0, 0, 2),
         date(2024, 2, 29), False, [None, "a"], [None, 1.0], {"j": None, "k": 1}, None, None),
    ]
    return spark.createDataFrame(rows + rows[:1], EDGE)


@pytest.mark.parametrize("codec", ["gzip", "zstd", "none"])
def test_all_tables_round_trip(spark, vault, same_rows, codec):
    tables = parquet_tables(spark, SMALL, ALL_TABLES)
    done = vault.backup(tables, BackupRequest(db_name="shop", codec=codec))
    assert done.success and done.checksum and len(done.checksum) == 64
    assert (done.compressed_size is None) == (codec == "none")
    back = vault.restore(done.backup_id)
    assert sorted(back) == sorted(ALL_TABLES)
    for name, df in tables.items():
        assert same_rows(back[name], df), name
    written = vault.restore_to(done.backup_id, vault.root + "/out")
    assert written == {n: df.count() for n, df in tables.items()}
    assert vault.verify_files(done.backup_id).where("status <> 'ok'").isEmpty()
    assert vault.verify_content(done.backup_id).where("not content_ok").isEmpty()


def test_edge_values_round_trip(spark, vault):
    df = edge_rows(spark)
    done = vault.backup({"edge": df, "empty": df.limit(0)}, BackupRequest(db_name="x"))
    assert done.success, done.error
    back = vault.restore(done.backup_id)
    assert back["edge"].schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, back["edge"].collect())) == sorted(map(repr, df.collect()))
    assert back["empty"].count() == 0 and back["empty"].columns == df.columns
    assert vault.restore_to(done.backup_id, vault.root + "/out") == {"edge": 5, "empty": 0}


def test_edge_values_through_keyless_delta(spark, vault):
    df = edge_rows(spark)
    later = df.where("b <> 0").unionByName(df).unionByName(df.where("s = ' é '"))
    assert vault.backup({"edge": df}, BackupRequest(db_name="x")).success
    done = vault.backup({"edge": later}, BackupRequest(db_name="x", backup_type="incremental"))
    assert done.success, done.error
    back = vault.restore(done.backup_id)["edge"]
    assert sorted(map(repr, back.collect())) == sorted(map(repr, later.collect()))


def test_selection_and_names(spark, vault):
    tables = parquet_tables(spark, SMALL, ["region", "nation", "orders"])
    done = vault.backup(tables, BackupRequest(db_name="shop", tables=["*ion"], exclude_tables=["region"], name="nightly"))
    assert [r["table_name"] for r in vault.manifest(done.backup_id).collect()] == ["nation"]
    assert vault.jobs().first()["file_name"] == "nightly"
    wrong = vault.backup(tables, BackupRequest(db_name="shop", tables=["nothing"]))
    assert not wrong.success and "no table matches" in wrong.error
    for bad in ("../up", "a/b", ".hidden", "_x", ""):
        assert not vault.backup({bad: tables["region"]}, BackupRequest(db_name="shop")).success
        with pytest.raises(ValueError):
            BackupRequest(name=bad)
    with pytest.raises(ValueError):
        BackupRequest(backup_type="weekly")
    with pytest.raises(ValueError):
        BackupRequest(codec="rar")


def test_failed_run_is_recorded(spark, vault):
    broken = spark.range(3).select(F.raise_error(F.lit("disk on fire")).cast("string").alias("x"))
    done = vault.backup({"t": broken}, BackupRequest(db_name="shop"))
    assert not done.success and "disk on fire" in done.error
    job = vault.status(done.backup_id).first()
    assert (job["status"], job["db_name"], job["backup_type"]) == ("failed", "shop", "full")
    assert [(e["level"], e["message"]) for e in job["logs"]] == [("error", "Backup failed")]
    assert vault.list_backups().isEmpty()
    assert vault.list_backups(status="failed").count() == 1
    with pytest.raises(ValueError):
        vault.restore(done.backup_id)


def test_size_cap(spark, vault):
    done = vault.backup({"t": spark.range(1000)}, BackupRequest(db_name="s", max_size="1k"))
    assert not done.success and "more than 1k" in done.error
    assert vault.backup({"t": spark.range(1000)}, BackupRequest(db_name="s", max_size="50GB")).success


def test_restore_subset_and_existing(spark, vault):
    tables = parquet_tables(spark, SMALL, ["region", "nation"])
    done = vault.backup(tables, BackupRequest(db_name="shop"))
    out = vault.root + "/out"
    assert vault.restore_to(done.backup_id, out, tables=["nation"]) == {"nation": 25}
    with pytest.raises(Exception, match="(?i)already exists"):
        vault.restore_to(done.backup_id, out)
    assert vault.restore_to(done.backup_id, out, drop_existing=True) == {"region": 5, "nation": 25}
    with pytest.raises(ValueError):
        vault.restore("unknown")


def test_output_folder_codec_and_chunks(spark, vault, tmp_path):
    other = str(tmp_path / "elsewhere")
    df = spark.range(0, 1000, 1, 2)
    done = vault.backup({"t": df}, BackupRequest(db_name="s", output=other, compress=False, chunk_rows=100))
    assert done.file_path.startswith(other)
    assert vault.manifest(done.backup_id).first()["files"] == 10
    assert vault.jobs().first()["compression_type"] == "none"
    assert vault.restore(done.backup_id)["t"].count() == 1000


def _parts(path):
    import glob

    return sorted(glob.glob(f"{path}/part-*.parquet"))


def test_corruption_is_found(spark, vault, tmp_path):
    import os
    import shutil

    df = spark.range(0, 5000, 1, 2).withColumn("v", F.sha2(F.col("id").cast("string"), 256))
    names = ["flipped", "flipped_crc", "missing", "extra", "fine"]
    done = vault.backup({n: df for n in names}, BackupRequest(db_name="s"))
    at = {n: _parts(f"{done.file_path}/{n}") for n in names}
    for name in ("flipped", "flipped_crc"):
        path = at[name][0]
        data = bytearray(open(path, "rb").read())
        data[len(data) // 2] ^= 1
        open(path, "wb").write(data)
        if name == "flipped":
            os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    os.remove(at["missing"][1])
    shutil.copy(at["extra"][0], at["extra"][0].replace("part-00000", "part-00009"))
    got = {
        n: sorted(r["status"] for r in vault.verify_files(done.backup_id).where(F.col("table_name") == n).collect()) for n in names
    }
    assert got == {
        "flipped": ["changed", "ok"], "flipped_crc": ["corrupt", "ok"], "missing": ["missing", "ok"],
        "extra": ["extra", "ok", "ok"], "fine": ["ok", "ok"],
    }
    content = {r["table_name"]: r["content_ok"] for r in vault.verify_content(done.backup_id).collect()}
    assert content == {n: n == "fine" for n in names}
    with pytest.raises(DigestMismatch):
        vault.restore_to(done.backup_id, str(tmp_path / "out"), tables=["extra"])


def test_a_flipped_byte_that_alters_no_row(spark, vault):
    """A byte of the footer's free text: rows and length stay, the bytes do not."""
    import os

    done = vault.backup({"t": spark.range(100)}, BackupRequest(db_name="s"))
    part = _parts(f"{done.file_path}/t")[0]
    data = open(part, "rb").read()
    at = data.rindex(b"parquet-mr")
    open(part, "wb").write(data[:at] + b"Parquet-mr" + data[at + 10 :])
    os.remove(os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc"))
    assert "changed" in {r["status"] for r in vault.verify_files(done.backup_id).collect()}
    assert vault.verify_content(done.backup_id).first()["content_ok"]


def test_parts_are_bounded(spark, vault, monkeypatch):
    """A part that is too large to be hashed as one value is written again in pieces; the backup is the same."""
    from tablevault.operators import integrity

    monkeypatch.setattr(integrity, "PART_BYTES", 40_000)
    df = spark.range(0, 5000, 1, 1).withColumn("v", F.sha2(F.col("id").cast("string"), 256))
    done = vault.backup({"t": df, "u": spark.range(3)}, BackupRequest(db_name="s"))
    files = vault.files(done.backup_id).where("table_name = 't'").collect()
    assert len(files) > 5 and max(r["length"] for r in files) <= 40_000 and sum(r["row_count"] for r in files) == 5000
    assert {r["status"] for r in vault.verify_files(done.backup_id).collect()} == {"ok"}
    assert vault.restore_to(done.backup_id, vault.root + "/out") == {"t": 5000, "u": 3}


def test_no_file_is_ok_unread(spark, vault):
    """The bytes of every part file are hashed."""
    done = vault.backup({"t": spark.range(0, 100, 1, 2), "none": spark.range(0)}, BackupRequest(db_name="s"))
    files = vault.files(done.backup_id).collect()
    assert sum(r["row_count"] for r in files) == 100 and done.checksum
    assert {r["status"] for r in vault.verify_files(done.backup_id).collect()} == {"ok"}
    spark.range(0, 100, 1, 2).selectExpr("id + 1 as id").write.mode("overwrite").parquet(f"{done.file_path}/t")
    assert not {r["table_name"]: r["content_ok"] for r in vault.verify_content(done.backup_id).collect()}["t"]


def test_a_backup_folder_that_is_gone(spark, vault):
    import shutil

    done = vault.backup({"t": spark.range(9), "u": spark.range(3)}, BackupRequest(db_name="s"))
    shutil.rmtree(f"{done.file_path}/t")
    assert {r["table_name"]: r["status"] for r in vault.verify_files(done.backup_id).collect()} == {"t": "missing", "u": "ok"}
    shutil.rmtree(done.file_path)
    assert {r["status"] for r in vault.verify_files(done.backup_id).collect()} == {"missing"}
    assert not any(r["content_ok"] for r in vault.verify_content(done.backup_id).collect())


def test_success_is_the_last_event(spark, vault, monkeypatch):
    """A log that cannot be written fails the run before it counts, and leaves one closing event."""
    log, calls = vault._log, []

    def broken(backup_id, at, level, message, details):
        calls.append(level)
        if level == "info":
            raise OSError("disk full at postgres://u:pw@h/db")
        log(backup_id, at, level, message, details)

    monkeypatch.setattr(vault, "_log", broken)
    done = vault.backup({"t": spark.range(3)}, BackupRequest(db_name="s", db_type="postgres"))
    events = vault.job_events().where("seq = 1").collect()
    assert not done.success and [e["status"] for e in events] == ["failed"] and calls == ["info", "error"]
    job = vault.jobs().first()
    assert job["db_type"] == "postgresql" and job["file_path"] and "pw" not in job["error"]


def test_digests_of_many_digits_stay_exact():
    from tablevault.vault import _Parent

    parent = _Parent({"state_rows": 1, "state_digest1": Decimal("123456789012345678901234567890123"), "state_digest2": Decimal(-7)}, None, [])
    got = Vault._moved(parent, 2, Decimal("999999999999999999999999999999"), -1)
    assert got == (3, 123456789012345678901234567890123 + 999999999999999999999999999999, -8)


def test_overlapping_runs_and_expiry(spark, vault):
    """Restores follow recorded parents; expiry keeps every ancestor of what is kept."""
    from datetime import timedelta, timezone

    now = datetime.now(timezone.utc)
    request = lambda t: BackupRequest(db_name="s", backup_type=t, keys={"t": ["id"]})
    state = lambda text: spark.range(4).withColumn("v", F.lit(text))
    full = vault.backup({"t": state("p")}, request("full"), now - timedelta(days=50))
    b = vault.backup({"t": state("p").where("id < 3")}, request("incremental"), now - timedelta(days=40))
    a = vault.backup({"t": state("a")}, request("incremental"), now - timedelta(days=45))
    c = vault.backup({"t": state("p").where("id < 2")}, request("incremental"), now - timedelta(days=1))
    assert {tuple(r) for r in vault.restore(b.backup_id)["t"].collect()} == {(0, "p"), (1, "p"), (2, "p")}
    assert vault.restore_to(c.backup_id, vault.root + "/out") == {"t": 2}
    assert [m["id"] for m in vault.chain(c.backup_id)] == [full.backup_id, b.backup_id, c.backup_id]
    gone = {r["id"] for r in vault.expired(F.lit(now)).collect()}
    assert not gone & {full.backup_id, b.backup_id, c.backup_id} and a.success


def test_session_tables(spark, vault):
    from tablevault.sources.tables import session_tables

    spark.range(4).createOrReplaceTempView("shop_t")
    done = vault.backup(session_tables(spark, ["shop_t"]), BackupRequest(db_name="s"))
    assert vault.restore(done.backup_id)["shop_t"].count() == 4


def test_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    from tablevault.workspace import shared_folder

    def session(master, conf=None, context=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda _k, _d: conf),
            sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: context),
        )

    with pytest.raises(ValueError):
        shared_folder(session("yarn"))
    assert shared_folder(session("yarn", conf="hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(session("yarn", context="hdfs:///c")) == "hdfs:///c"


def test_expire_marks_then_deletes(spark, vault):
    import os
    from datetime import timedelta, timezone

    now = datetime.now(timezone.utc)
    request = lambda t: BackupRequest(db_name="s", backup_type=t, keys={"t": ["id"]})
    runs = [
        vault.backup({"t": spark.range(10 + i)}, request(kind), now - timedelta(days=days))
        for i, (kind, days) in enumerate([("full", 60), ("full", 50), ("incremental", 45), ("incremental", 5)])
    ]
    assert all(r.success for r in runs)
    assert [r["id"] for r in vault.expired(F.lit(now)).collect()] == [runs[0].backup_id]
    assert vault.expire(F.lit(now)) == 1
    assert not os.path.exists(runs[0].file_path)
    assert vault.jobs().where(F.col("id") == runs[0].backup_id).first()["status"] == "expired"
    assert vault.restore(runs[3].backup_id)["t"].count() == 13


def test_plan_of_a_full_backup_has_no_shuffle(spark):
    from tablevault.functions.fingerprint import with_fingerprint

    df = parquet_tables(spark, SMALL, ["lineitem"])["lineitem"]
    plan = with_fingerprint(df, length=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_a_backup_of_no_tables_can_be_verified(spark, vault):
    done = vault.backup({"t": spark.range(3)}, BackupRequest(db_name="s", exclude_tables=["t"]))
    assert done.success
    assert vault.verify_files(done.backup_id).count() == 0 and vault.verify_content(done.backup_id).count() == 0
