from compare import MEDIUM
from pyspark.sql import functions as F

from tablevault import BackupRequest
from tablevault.operators import forecast as forecasts
from tablevault.plans.fixtures import ALL_TABLES
from tablevault.sources.tables import parquet_tables
from tablevault.workspace import path_exists


def test_all_tables_within_the_bound(spark, vault, monkeypatch):
    monkeypatch.setattr(forecasts, "BLOCK_ROWS", 4_000)
    monkeypatch.setattr(forecasts, "SAMPLE_BLOCKS", 8)
    tables = parquet_tables(spark, MEDIUM, ALL_TABLES)
    done = vault.backup(tables, BackupRequest(db_name="shop"))
    assert done.success
    found = [(row, vault.forecast(tables[row["table_name"]])) for row in vault.manifest(done.backup_id).collect()]
    assert len(found) == 14 and all(f.rows == row["row_count"] for row, f in found)
    assert [(row["table_name"], row["bytes"], f) for row, f in found if abs(f.size - row["bytes"]) > f.error] == []
    assert path_exists(spark, f"{vault.root}/data") and not path_exists(spark, f"{vault.root}/work/forecast")


def test_an_oversized_run_writes_no_data(spark, vault):
    rows = spark.range(0, 300_000, 1, 4).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    done = vault.backup({"t": rows}, BackupRequest(db_name="shop", max_size="1mb"))
    assert not done.success and "at least" in done.error
    assert not path_exists(spark, vault.data_path(done.backup_id))
    assert vault.backup({"t": rows}, BackupRequest(db_name="shop", max_size="1gb")).success


def test_empty_and_uneven_tables(spark, vault):
    assert vault.forecast(spark.createDataFrame([], "a int")).size == 0
    uneven = spark.range(0, 10, 1, 4).where("id = 9")
    assert vault.forecast(uneven).rows == 1
