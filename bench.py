"""Headline timings, one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tablevault import BackupRequest, Vault  # noqa: E402
from tablevault.plans import fixtures as fx, registry  # noqa: E402
from tablevault.sources.tables import parquet_tables  # noqa: E402
from tablevault.workspace import fresh_root  # noqa: E402

CATALOG_QUERIES = [
    "list_backups", "current_job_state", "job_status_with_logs", "job_summary", "backup_chains",
    "restore_chain_latest", "retention_expired", "table_digest_orders", "log_render", "log_stream_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablevault-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def run(vault, tables, **options):
        done = vault.backup(tables, BackupRequest(db_name="shop", **options))
        if not done.success:
            raise RuntimeError(done.error)
        return done

    def rows(df):
        df.write.format("noop").mode("overwrite").save()

    tables = parquet_tables(spark, folder, fx.ALL_TABLES)
    run(Vault(spark, fresh_root(spark)), {"region": tables["region"]})  # warm the session
    sizes = {}
    for codec in ("gzip", "zstd", "none"):
        vault = Vault(spark, fresh_root(spark))
        done = timed(f"full_backup_all_{codec}", lambda: run(vault, tables, codec=codec))
        sizes[codec] = done.file_size
        if codec == "gzip":
            timed("verify_files_all", lambda: rows(vault.verify_files(done.backup_id)))
            timed("verify_content_all", lambda: rows(vault.verify_content(done.backup_id)))
            timed("restore_all", lambda: vault.restore_to(done.backup_id, f"{vault.root}/restored"))
    for name, states, options in (
        ("orders_keyed", fx.order_states(spark, folder), {"keys": {"orders": ["o_orderkey"]}}),
        ("lineitem_keyless", fx.lineitem_states(spark, folder), {}),
        ("events_high_water", fx.event_states(spark, folder), {"high_water": {"events": "ts"}}),
    ):
        table = name.split("_")[0]
        vault = Vault(spark, fresh_root(spark))
        run(vault, {table: states[0]}, **options)
        run(vault, {table: states[1]}, backup_type="incremental", **options)
        done = timed(f"delta_{name}", lambda: run(vault, {table: states[2]}, backup_type="incremental", **options))
        timed(f"chain_restore_{name}", lambda: vault.restore_to(done.backup_id, f"{vault.root}/restored"))
    vault, wide = Vault(spark, fresh_root(spark)), {n: tables[n] for n in ("orders", "lineitem")}
    timed("full_backup_chunks_first", lambda: run(vault, wide, dedup=True))
    timed("full_backup_chunks_unchanged", lambda: run(vault, wide, dedup=True))
    catalog = registry.queries()
    for name in CATALOG_QUERIES:
        timed(name, lambda: rows(catalog[name](spark, folder)))
    print(
        json.dumps(
            {
                "metric": "tablevault_headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
                "backup_bytes": sizes,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
