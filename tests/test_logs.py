from pyspark.sql import functions as F

from tablevault.operators import loglines
from tablevault.sources.loglines import read_log_lines
from tablevault.sources.tables import data_size, jdbc_options, stored_files
from tablevault.streaming import intake

import pytest

LINES = [
    '{"level":"info","message":"Backup completed","timestamp":"2024-01-02T03:04:05.678Z","module":"backup","duration":1.5,"size":{"mb":[1,2]}}',
    '{"level":"error","message":"Backup failed","timestamp":"2024-01-02T03:04:06.000Z"}',
    "not json",
    "[1,2]",
    '"text"',
]


def test_parse_lines(spark, tmp_path):
    (tmp_path / "combined.log").write_text("\n".join(LINES) + "\n")
    rows = read_log_lines(spark, str(tmp_path)).collect()
    good = rows[0]
    assert (good["level"], good["module"], good["details"]) == ("info", "backup", '{"duration":1.5,"size":{"mb":[1,2]}}')
    assert good["timestamp"].microsecond == 678000 and good["_corrupt_record"] is None
    assert rows[1]["details"] is None and rows[1]["module"] is None
    assert [r["_corrupt_record"] for r in rows[2:]] == LINES[2:]


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LINES))
    intake.start_intake(spark, folder, table, progress).awaitTermination()
    (tmp_path / "in" / "b.log").write_text(LINES[1] + "\n")
    for _ in range(2):
        intake.start_intake(spark, folder, table, progress, max_files=1).awaitTermination()
    assert intake.stored_logs(spark, table).count() == 6
    errors = intake.errors_of(spark, table)
    assert errors.count() == 2
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan
    assert intake.stored_logs(spark, table).where("level = 'unknown' and _corrupt_record is not null").count() == 3


def test_log_operators(spark, tmp_path):
    rows = [("debug", "", None), ("info", "NOTICE: x", None), ("warn", "careful", "m"), ("error", "bad", "m"), ("odd", "?", None)]
    logs = spark.createDataFrame(rows, "level string, message string, module string")
    logs = logs.withColumn("timestamp", F.lit("2024-01-02 03:04:05").cast("timestamp")).withColumn("details", F.lit(None).cast("string"))
    levels = lambda df: sorted(r["level"] for r in df.collect())
    assert levels(loglines.at_least(logs)) == ["error", "info", "odd", "warn"]
    assert levels(loglines.at_least(logs, "debug")) == ["debug", "error", "info", "odd", "warn"]
    assert levels(loglines.at_least(logs, "warn")) == ["error", "warn"]
    assert levels(loglines.warnings_in(logs)) == ["error", "odd", "warn"]
    with pytest.raises(ValueError):
        loglines.at_least(logs, "loud")
    lines = {r["level"]: r["line"] for r in logs.select("level", loglines.rendered().alias("line")).collect()}
    assert lines["error"] == "2024-01-02 03:04:05 error: [m] bad" and lines["info"] == "2024-01-02 03:04:05 info: NOTICE: x"
    loglines.write_errors(logs, str(tmp_path / "error"))
    assert read_log_lines(spark, str(tmp_path / "error")).first()["message"] == "bad"


def test_stored_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"123")
    (tmp_path / "y.bin").write_bytes(b"12345")
    assert tuple(data_size(spark, str(tmp_path)).first()) == (2, 8)
    assert [(r["name"], r["length"]) for r in stored_files(spark, str(tmp_path), "a/").collect()] == [("a/x.bin", 3)]
    assert sorted(r["name"] for r in stored_files(spark, f"file:{tmp_path}/").collect()) == ["a/x.bin", "y.bin"]
    plan = stored_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_jdbc_options():
    got = jdbc_options("postgres", "shop", password="secret", ssl=True)
    assert got["url"] == "jdbc:postgresql://localhost:5432/shop?sslmode=require" and got["user"] == "postgres"
    assert jdbc_options("mariadb", "shop", "db", 3307)["url"] == "jdbc:mysql://db:3307/shop"
    assert jdbc_options("sqlite", "/tmp/x.db")["url"] == "jdbc:sqlite:/tmp/x.db"
    with pytest.raises(ValueError):
        jdbc_options("mongodb", "shop")


def test_jdbc_is_read_in_parallel_or_not_at_all(spark):
    from tablevault.sources.tables import jdbc_table

    assert jdbc_options("mysql", "shop")["user"] == "root"
    with pytest.raises(ValueError, match="in parallel"):
        jdbc_table(spark, jdbc_options("postgres", "shop"), "orders")


def test_foreign_levels_share_one_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("".join(f'{{"level": "l{i}", "message": "m"}}\n' for i in range(5)) + '{"level": "warn"}\n')
    intake.start_intake(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = intake.stored_logs(spark, str(tmp_path / "t"))
    assert {(r["level"], r["given_level"]) for r in got.collect()} == {("unknown", f"l{i}") for i in range(5)} | {("warn", None)}
