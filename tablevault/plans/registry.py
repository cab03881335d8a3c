"""The registered queries. Each takes a session and a data folder and returns a frame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import reduce

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevault.functions import scalars as X, sealed
from tablevault.functions.fingerprint import portable_digest
from tablevault.model import BackupRequest, BackupResult
from tablevault.operators import catalog, loglines, retention
from tablevault.operators.delta import BEFORE, COPIES, OP
from tablevault.operators.integrity import file_name, file_totals
from tablevault.operators.selection import select_tables
from tablevault.plans import chains, fixtures as fx
from tablevault.sources.tables import data_size, parquet_tables, stored_files
from tablevault.streaming import intake
from tablevault.vault import Vault
from tablevault.workspace import delete_path, fresh_root, list_names, qualified, rename_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _register(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, folder)

    _QUERIES[query.__name__] = run
    return query


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _run(vault: Vault, source: dict[str, DataFrame], at: datetime | None = None, /, **options) -> BackupResult:
    result = vault.backup(source, BackupRequest(db_name="shop", **options), at)
    if not result.success:
        raise RuntimeError(result.error)
    return result


def _vault(spark: SparkSession) -> Vault:
    return Vault(spark, fresh_root(spark))


def _history(vault: Vault, name: str, states: list[DataFrame], types: list[str], **options) -> list[BackupResult]:
    """One backup per state, a minute apart."""
    start = datetime.now(timezone.utc) - timedelta(hours=1)
    return [
        _run(vault, {name: s}, start + timedelta(minutes=i), backup_type=t, **options)
        for i, (s, t) in enumerate(zip(states, types))
    ]


# --- backup, restore, verify --------------------------------------------------------------


def _round_trip(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    vault = _vault(spark)
    done = _run(vault, {name: fx.table(spark, folder, name)}, **options)
    return vault.restore(done.backup_id)[name]


@_register
def full_backup_restore_orders(spark, folder):
    return _round_trip(spark, folder, "orders")


@_register
def full_backup_restore_zstd_events(spark, folder):
    return _round_trip(spark, folder, "events", codec="zstd")


@_register
def full_backup_plain_documents(spark, folder):
    return _round_trip(spark, folder, "documents", compress=False)


@_register
def backup_arrays_embeddings(spark, folder):
    back = _round_trip(spark, folder, "embeddings")
    cells = back.select("vec_id", "label", F.posexplode("embedding").alias("pos", "value"))
    return cells.select("vec_id", "label", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))


@_register
def selected_tables_restore_customer(spark, folder):
    vault = _vault(spark)
    done = _run(vault, parquet_tables(spark, folder, fx.ALL_TABLES))
    vault.restore_to(done.backup_id, f"{vault.root}/restored", tables=["customer"])
    return spark.read.parquet(f"{vault.root}/restored/customer")


@_register
def chunked_backup_elsewhere_events(spark, folder):
    """Parts of bounded length in a folder other than the vault's."""
    return _round_trip(spark, folder, "events", chunk_rows=1000, output=fresh_root(spark))


@_register
def backup_job_and_log(spark, folder):
    """What one run leaves in the catalog: the job with its log, and the rows it covers."""
    vault = _vault(spark)
    done = _run(vault, parquet_tables(spark, folder, fx.ALL_TABLES))
    job = catalog.jobs_with_log_rows(vault.jobs(), vault.logs())
    rows = vault.manifest(done.backup_id).groupBy(F.col("backup_id").alias("id")).agg(
        F.count(F.lit(1)).alias("tables"), F.sum("row_count").alias("total_rows")
    )
    return job.join(rows, "id").select(
        "db_type", "db_name", "backup_type", "status", "compression_type", "backup_version", "retry_count",
        "log_level", "log_message", "tables", "total_rows",
    )


@_register
def dedup_full_restore_orders(spark, folder):
    """Three fulls in chunks, the last of an unchanged table: it writes no data file, and restores."""
    vault, start = _vault(spark), datetime.now(timezone.utc) - timedelta(hours=1)
    _, before, now = fx.order_states(spark, folder)
    first, second, third = [_run(vault, {"orders": s}, start + timedelta(minutes=i), dedup=True) for i, s in enumerate((before, now, now.repartition(5)))]
    unwritten = (F.lit(third.file_size) == 0) & (F.lit(second.file_size) > 0)
    return vault.restore(third.backup_id)["orders"].withColumn("unwritten", unwritten)


@_register
def sweep_after_expiry(spark, folder):
    """What two sweeps leave after the older of two fulls in chunks has expired, while a later one is under way in between."""
    vault, now = _vault(spark), datetime.now(timezone.utc)
    _, earlier, latest = fx.order_states(spark, folder)
    _run(vault, {"orders": earlier}, now - timedelta(days=60), dedup=True)
    kept = _run(vault, {"orders": latest}, now - timedelta(days=1), dedup=True)
    vault.expire(F.lit(now))
    vault.sweep()
    between = _run(vault, {"orders": latest.where(F.col("o_orderpriority") == "1-URGENT")}, dedup=True)
    vault.sweep()
    jobs = vault.jobs().select(F.col("id").alias("backup_id"), "started_at")
    left = vault.units().agg(F.count(F.lit(1)).alias("left")).join(vault.named_units().agg(F.count(F.lit(1)).alias("named")), F.lit(True))  # one row each
    rows = [vault.restore(b.backup_id)["orders"].select(F.lit(b.backup_id).alias("backup_id"), "o_orderkey", "o_totalprice") for b in (kept, between)]
    found = rows[0].unionByName(rows[1]).groupBy("backup_id").agg(F.count(F.lit(1)).alias("restored"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    sizes = found.join(jobs, "backup_id").withColumn("run", F.when(F.col("backup_id") == kept.backup_id, "kept").otherwise("between"))
    return sizes.join(left, F.lit(True)).select("run", "restored", "cents", (F.col("left") == F.col("named")).alias("exact"))


@_register
def manifest_row_counts(spark, folder):
    vault = _vault(spark)
    done = _run(
        vault, parquet_tables(spark, folder, fx.ALL_TABLES),
        tables=["orders", "customer", "lineitem", "events", "documents"], exclude_tables=["doc*"],
    )
    return vault.manifest(done.backup_id).select("table_name", "row_count")


@_register
def manifest_selection(spark, folder):
    """The include and exclude rule on a listing held as a frame."""
    vault = _vault(spark)
    done = _run(vault, parquet_tables(spark, folder, fx.ALL_TABLES))
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "table_name string")
    include = names("part", "supplier", "pages").union(names("labels", "part", "nation"))
    return select_tables(vault.manifest(done.backup_id), include, names("pages", "region")).select("table_name", "row_count")


@_register
def stored_artifacts(spark, folder):
    """Files of one table of a backup, found by the start of their path, against what is recorded of them."""
    vault = _vault(spark)
    done = _run(vault, parquet_tables(spark, folder, fx.ALL_TABLES))
    listed = stored_files(spark, done.file_path, prefix="orders/").select("name", "length")
    known = vault.files(done.backup_id).select(
        F.concat_ws("/", "table_name", file_name("path")).alias("name"), "table_name", "row_count", F.col("length").alias("recorded")
    )
    found = listed.where(F.col("name").endswith(".parquet")).join(known, "name", "left")
    return found.groupBy("table_name").agg(F.sum("row_count").alias("row_total"), F.bool_and(F.col("length") == F.col("recorded")).alias("lengths_ok"))


@_register
def artifact_files(spark, folder):
    """Recorded part files of every table against the rows read back from each."""
    vault = _vault(spark)
    done = _run(vault, parquet_tables(spark, folder, fx.ALL_TABLES))
    checked = vault.verify_files(done.backup_id).groupBy("table_name").agg(F.bool_and(F.col("status") == "ok").alias("all_ok"))
    totals = vault.files(done.backup_id).groupBy("table_name").agg(F.sum("row_count").alias("row_total"))
    sizes = file_totals(vault.files(done.backup_id)).join(vault.manifest(done.backup_id).select("table_name", F.col("bytes").alias("recorded")), "table_name")
    same = sizes.select("table_name", (F.col("bytes") == F.col("recorded")).alias("bytes_ok"))
    return totals.join(checked, "table_name").join(same, "table_name")


@_register
def database_size(spark, folder):
    """Size of each table's files as listed, against the size of the files its rows come from."""
    parts = []
    for name in fx.ALL_TABLES:
        path = f"{folder.rstrip('/')}/{name}.parquet"
        files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        read = files.groupBy("path", "size").agg(F.count(F.lit(1)).alias("rows")).agg(F.sum("size").alias("read_bytes"), F.sum("rows").alias("row_total"))
        listed = data_size(spark, path).crossJoin(read)  # one row by one row
        parts.append(listed.select(F.lit(name).alias("table_name"), "row_total", (F.col("bytes") == F.col("read_bytes")).alias("bytes_ok")))
    return reduce(DataFrame.unionByName, parts)


@_register
def failed_job_and_log(spark, folder):
    """A run that fails with a secret in its message, beside one that succeeds."""
    vault = _vault(spark)
    tables = parquet_tables(spark, folder, fx.ALL_TABLES)
    said = F.raise_error(F.lit("cannot read jdbc:postgresql://shop:s3cret@db/shop?password=s3cret")).cast("string")
    status = F.when(F.col("o_orderstatus") == "P", said).otherwise(F.col("o_orderstatus"))  # in the middle of a large write
    vault.backup({**tables, "orders": tables["orders"].withColumn("o_orderstatus", status)}, BackupRequest(db_name="shop"))
    _run(vault, tables)
    rows = vault.manifest().groupBy(F.col("backup_id").alias("id")).agg(F.sum("row_count").alias("total_rows"))
    found = catalog.jobs_with_log_rows(vault.jobs(), vault.logs()).join(rows, "id", "left")
    hidden = ~F.col("error").contains("s3cret") & ~F.col("log_details").contains("s3cret") & F.col("error").contains("password=***")
    return found.select("db_name", "status", "log_level", "log_message", "total_rows", hidden.alias("secret_hidden"))


@_register
def status_with_logs(spark, folder):
    """Point lookup of one of several runs, its logs from the array to rows."""
    vault = _vault(spark)
    done = _history(vault, "orders", fx.order_states(spark, folder), ["full", "incremental", "differential"], **_ORDER_KEY)
    job = vault.status(done[1].backup_id).select("id", "status", "backup_type", F.posexplode("logs").alias("pos", "log"))
    state = vault.manifest(done[1].backup_id).select(F.col("backup_id").alias("id"), "state_rows")
    return job.join(state, "id").select("status", "backup_type", "pos", F.col("log.level").alias("level"), F.col("log.message").alias("message"), "state_rows")


@_register
def table_digest_orders(spark, folder):
    o = fx.table(spark, folder, "orders").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    found = portable_digest(o.withColumn("o_orderdate", micros))
    return found.select("row_count", F.col("digest1").cast("string").alias("digest1"), F.col("digest2").cast("string").alias("digest2"))


@_register
def sealed_digest_orders(spark, folder):
    """The keyed digest of a table from that of an earlier state, the rows that came since and those that went."""
    o = fx.table(spark, folder, "orders").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    o = o.withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    late, gone = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P"
    moved = o.where(gone).withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    earlier = sealed.lanes(o.where(~late).unionByName(moved), "a key")
    return sealed.sealed_digest(sealed.combined((1, earlier), (1, sealed.lanes(o.where(late), "a key")), (-1, sealed.lanes(moved, "a key"))))


def _replace_part(spark: SparkSession, altered: DataFrame, folder: str, aside: str) -> None:
    """Put the rows of a frame into the only part file of a folder, under the name it had."""
    altered.coalesce(1).write.parquet(aside)
    names = [stored_files(spark, f).where(F.col("name").endswith(".parquet")).first()["name"] for f in (folder, aside)]
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(f"{f}/{n}") for f, n in zip((folder, aside), names))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, False)
    fs.rename(new, old)


def _flip_footer(spark: SparkSession, folder: str) -> None:
    """Change one byte in the free text of the footer of a stored part: no row and no length changes."""
    name = stored_files(spark, folder).where(F.col("name").endswith(".parquet")).orderBy("length").first()["name"]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    source = fs.open(path)
    data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    source.close()
    at = data.rindex(b"parquet-mr")
    target = fs.create(path, True)
    target.write(bytearray(data[:at] + b"Parquet-mr" + data[at + 10 :]))
    target.close()


@_register
def verify_after_changes(spark, folder):
    """A part added to one stored table, another table rewritten, one part replaced under its name, a byte flipped in a footer and
    one folder removed behind the vault's back."""
    vault = _vault(spark)
    tables = parquet_tables(spark, folder, ["orders", "supplier", "customer", "region", "nation", "part"])
    done = _run(vault, tables)
    tables["supplier"].write.mode("append").parquet(f"{done.file_path}/supplier")
    altered = tables["customer"].withColumn("c_acctbal", F.col("c_acctbal") + 1)
    altered.write.mode("overwrite").parquet(f"{done.file_path}/customer")
    _replace_part(spark, tables["region"].withColumn("r_name", F.reverse("r_name")), f"{done.file_path}/region", f"{vault.root}/aside")
    _flip_footer(spark, f"{done.file_path}/part")
    delete_path(spark, f"{done.file_path}/nation")
    # five possible states bound the set
    states = vault.verify_files(done.backup_id).groupBy("table_name").agg(
        F.array_join(F.array_sort(F.collect_set("status")), ",").alias("file_states")
    )
    return vault.verify_content(done.backup_id).join(states, "table_name")


# --- catalog ------------------------------------------------------------------------------


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.current_jobs(fx.job_events(spark, folder))


@_register
def current_job_state(spark, folder):
    return _jobs(spark, folder)


@_register
def list_backups(spark, folder):
    return catalog.list_view(_jobs(spark, folder))


@_register
def list_failed_full(spark, folder):
    return catalog.list_view(_jobs(spark, folder), status="failed", db_name="db1", backup_type="full")


@_register
def list_recent_50(spark, folder):
    page = catalog.recent_backups(_jobs(spark, folder), "db1")
    return page.select("id", "db_type", "db_name", "backup_type", "status", "file_size", "started_at")


@_register
def count_by_status(spark, folder):
    return _jobs(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("backups"))


@_register
def job_status_with_logs(spark, folder):
    found = catalog.jobs_with_log_rows(_jobs(spark, folder), fx.job_logs(spark, folder))
    return found.select("id", "status", "backup_type", "log_id", "log_timestamp", "log_level", "log_message")


@_register
def orphan_logs(spark, folder):
    known = _jobs(spark, folder).where(F.col("status") != "failed")
    return catalog.orphan_logs(fx.job_logs(spark, folder), known).select("id", "backup_job_id", "level", "message")


@_register
def stale_jobs(spark, folder):
    return catalog.stale_jobs(_jobs(spark, folder), fx.stamp("2024-01-30"), 24).select("id", "db_name", "started_at")


@_register
def job_summary(spark, folder):
    return catalog.job_summary(chains.successful(_jobs(spark, folder)))


# --- scalar expressions -------------------------------------------------------------------


@_register
def artifact_names(spark, folder):
    e = fx.table(spark, folder, "events").withColumn("db", F.concat(F.lit("db"), (F.col("user_id") % 5).cast("string")))
    given = F.when(F.col("event_type") == "view", "nightly").when(F.col("event_type") == "error", "")
    port = F.when(F.col("event_type") != "click", F.col("user_id"))
    e = e.withColumn("file_name", F.concat(X.artifact_name(given, "db", "ts"), F.lit("."), X.artifact_extension(F.col("value") > 50)))
    return e.select(
        "event_id",
        X.iso_stamp("ts").alias("stamp"),
        X.job_id("db", "ts").alias("job_id"),
        "file_name",
        X.join_path(F.lit("/backups"), "file_name").alias("file_path"),
        X.default_number(port, 5432).alias("port"),
    )


@_register
def elapsed_seconds(spark, folder):
    done = fx.job_rows(spark, folder).where(F.col("status") != "running")
    return done.select("id", X.elapsed_seconds("started_at", "completed_at").alias("seconds"))


@_register
def log_metadata_json(spark, folder):
    logs = fx.job_logs(spark, folder)
    field = lambda name: F.get_json_object("details", f"$.{name}")
    absent = lambda name: ~F.col("details").contains(f'"{name}":')
    return logs.select(
        F.col("id").alias("log_id"),
        field("duration").cast("double").alias("duration"),
        field("fileSize").cast("bigint").alias("file_size"),
        field("error").alias("error"),
        absent("fileSize").alias("size_absent"),
        absent("error").alias("error_absent"),
    )


@_register
def parse_sizes(spark, folder):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("k", "MB", " gb", "", " parsecs")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), unit)
    return fx.table(spark, folder, "part").select("p_partkey", X.parse_size(text).alias("size_bytes"))


@_register
def parse_ints(spark, folder):
    number, event = F.col("user_id").cast("string"), F.col("event_type")
    text = (
        F.when(event == "view", F.concat(number, F.lit("m")))
        .when(event == "click", F.concat(F.lit("-"), number))
        .when(event == "error", F.concat(F.lit("  "), number, F.lit(" files")))
        .otherwise(F.concat(F.lit("n"), number))
    )
    return fx.table(spark, folder, "events").select("event_id", X.leading_int(text).alias("parsed"))


@_register
def db_type_alias(spark, folder):
    event = F.col("event_type")
    name = (
        F.when(event == "view", "postgres").when(event == "click", "mariadb").when(event == "error", "postgresql")
        .when(event == "signup", "sqlite").otherwise("oracle")
    )
    return fx.table(spark, folder, "events").select("event_id", X.canonical_db_type(name).alias("canonical"))


@_register
def split_names(spark, folder):
    text = F.concat(F.col("c_name"), F.lit(",  "), F.col("c_mktsegment"), F.lit(" ,"))
    return fx.table(spark, folder, "customer").select(
        "c_custkey", F.array_join(X.split_names(text), "|").alias("names"), X.first_part(text).alias("first_part")
    )


@_register
def drop_absent_settings(spark, folder):
    settings = F.create_map(
        F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"),
        F.lit("size"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")),
    )
    kept = F.array_join(F.array_sort(F.map_keys(X.drop_absent(settings))), ",")
    return fx.table(spark, folder, "part").select("p_partkey", kept.alias("kept"))


# --- logs ---------------------------------------------------------------------------------


@_register
def log_threshold(spark, folder):
    kept = loglines.at_least(fx.log_rows(spark, folder))
    return loglines.tag_module(kept, "catalog").select("event_id", "level", "message", "module")


@_register
def log_errors(spark, folder):
    return loglines.errors_only(fx.log_rows(spark, folder)).select("event_id", "level", "message", "module")


@_register
def log_warnings(spark, folder):
    return loglines.warnings_in(fx.log_rows(spark, folder)).select("event_id", "message")


@_register
def log_render(spark, folder):
    return fx.log_rows(spark, folder).select("event_id", loglines.rendered().alias("line"))


@_register
def log_redact(spark, folder):
    return loglines.redact_details(fx.log_rows(spark, folder)).select("event_id", "details")


def _ingested(spark: SparkSession, folder: str) -> str:
    """Log lines written as JSON files and taken in by the stream; returns the table path."""
    root = fresh_root(spark)
    lines = fx.log_rows(spark, folder).join(fx.table(spark, folder, "events").select("event_id", "props"), "event_id")
    time = F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = F.to_json(F.struct("level", "message", time.alias("timestamp"), "module", "event_id", "props"))
    lines.select(text.alias("value")).write.text(f"{root}/lines")
    intake.start_intake(spark, f"{root}/lines", f"{root}/logs", f"{root}/progress").awaitTermination()
    return f"{root}/logs"


def _extra(name: str):
    return F.get_json_object("details", f"$.{name}")


@_register
def log_stream_ingest(spark, folder):
    logs = intake.stored_logs(spark, _ingested(spark, folder))
    return logs.select(
        _extra("event_id").cast("bigint").alias("event_id"), "level", "message", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "module",
        _extra("props").alias("props"),
    )


@_register
def log_stream_errors(spark, folder):
    logs = intake.errors_of(spark, _ingested(spark, folder))
    return logs.select(
        _extra("event_id").cast("bigint").alias("event_id"), "level", "message", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
    )


def _grow(lines: DataFrame, folder: str, until: int) -> None:
    """Write the log files as far as they had grown at a moment (``step`` up to ``until``), and half of the line after that. A longer file
    with the same beginning is what appending leaves."""
    full = "file:///" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder

    def write(batches):
        store, place = arrow_fs.FileSystem.from_uri(full)
        store.create_dir(place, recursive=True)
        out, at = None, None
        for batch in batches:
            for file, step, value in zip(*(batch.column(c).to_pylist() for c in ("file", "step", "value"))):
                if file != at:
                    if out is not None:
                        out.close()
                    out, at, done = store.open_output_stream(f"{place}/{file}"), file, False
                if step <= until:
                    out.write(f"{value}\n".encode())
                elif not done:
                    out.write(value[: len(value) // 2].encode())
                    done = True
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([0], pa.int64())})

    dealt = lines.repartition("file").sortWithinPartitions("file", "step", "event_id")
    dealt.select("file", "step", "value").mapInArrow(write, "n long").count()


@_register
def log_growing_file_ingest(spark, folder):
    """Log files that grow between runs, end in half a line, and are rotated and begun anew before the last run."""
    root = qualified(spark, fresh_root(spark))
    rows = fx.log_rows(spark, folder)
    time = F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    step = F.when(F.col("timestamp") < fx.stamp("2024-01-10"), 1).when(F.col("timestamp") < fx.stamp("2024-01-20"), 2).otherwise(3)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.concat(F.lit("app-"), F.pmod(F.xxhash64("event_id"), F.lit(files)).cast("string"), F.lit(".log"))
    text = F.to_json(F.struct("level", "message", time.alias("timestamp"), "module", "event_id"))
    lines = rows.select("event_id", step.alias("step"), name.alias("file"), text.alias("value"))
    logs, table, progress = (f"{root}/{n}" for n in ("lines", "logs", "progress"))
    take_in = lambda: intake.start_growing_intake(spark, logs, table, progress).awaitTermination()
    _grow(lines.where("step < 3"), logs, 1)
    take_in()
    _grow(lines.where("step < 3"), logs, 2)
    for old in list_names(spark, logs):
        if old.endswith(".log"):
            rename_path(spark, f"{logs}/{old}", f"{logs}/{old}.1")
    _grow(lines.where("step = 3"), logs, 3)
    take_in()
    found = intake.stored_logs(spark, table)
    return found.select(_extra("event_id").cast("bigint").alias("event_id"), "level", "message", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "module")


# --- deltas, chains, retention ------------------------------------------------------------

_ORDER_KEY = {"keys": {"orders": ["o_orderkey"]}}
_EVENT_MARK = {"high_water": {"events": "ts"}}


def _delta_of(spark: SparkSession, name: str, states: list[DataFrame], types: list[str], **options) -> DataFrame:
    vault = _vault(spark)
    return vault.payload(_history(vault, name, states, types, **options)[-1].backup_id, name)


def _restored(spark: SparkSession, name: str, states: list[DataFrame], types: list[str], which: int = -1, **options) -> DataFrame:
    vault = _vault(spark)
    return vault.restore(_history(vault, name, states, types, **options)[which].backup_id)[name]


@_register
def incremental_delta_orders(spark, folder):
    _, before, now = fx.order_states(spark, folder)
    return _delta_of(spark, "orders", [before, now], ["full", "incremental"], **_ORDER_KEY).withColumnRenamed(OP, "op")


@_register
def differential_delta_orders(spark, folder):
    states = fx.order_states(spark, folder)
    return _delta_of(spark, "orders", states, ["full", "incremental", "differential"], **_ORDER_KEY).withColumnRenamed(OP, "op")


@_register
def chain_restore_incremental(spark, folder):
    return _restored(spark, "orders", fx.order_states(spark, folder), ["full", "incremental", "incremental"], **_ORDER_KEY)


@_register
def chain_restore_differential(spark, folder):
    return _restored(spark, "orders", fx.order_states(spark, folder), ["full", "differential", "differential"], **_ORDER_KEY)


@_register
def chain_restore_mixed(spark, folder):
    return _restored(spark, "orders", fx.order_states(spark, folder), ["full", "differential", "incremental"], **_ORDER_KEY)


@_register
def chain_restore_earlier_state(spark, folder):
    return _restored(spark, "orders", fx.order_states(spark, folder), ["full", "incremental", "incremental"], 1, **_ORDER_KEY)


@_register
def keyless_delta_lineitem(spark, folder):
    _, before, now = fx.lineitem_states(spark, folder)
    found = _delta_of(spark, "lineitem", [before, now], ["full", "incremental"])
    return found.withColumn("copies", F.col(COPIES) - F.col(BEFORE)).drop(COPIES, BEFORE)


@_register
def small_change_delta_lineitem(spark, folder):
    """The second delta of a table without a key, with few rows changed: returned items of large quantity and discount were
    missing, unreturned ones of the kind came twice."""
    now = fx.table(spark, folder, "lineitem")
    large = (F.col("l_quantity") >= 49) & (F.col("l_discount") >= 0.09)
    before = now.where(~(large & (F.col("l_returnflag") == "R"))).unionByName(now.where(large & (F.col("l_returnflag") == "N")))
    found = _delta_of(spark, "lineitem", [before.where(~large), before, now], ["full", "incremental", "incremental"])
    return found.withColumn("copies", F.col(COPIES) - F.col(BEFORE)).drop(COPIES, BEFORE)


@_register
def keyless_chain_restore_lineitem(spark, folder):
    return _restored(spark, "lineitem", fx.lineitem_states(spark, folder), ["full", "incremental", "incremental"])


@_register
def highwater_delta_events(spark, folder):
    _, before, now = fx.event_states(spark, folder)
    return _delta_of(spark, "events", [before, now], ["full", "incremental"], **_EVENT_MARK)


@_register
def highwater_chain_restore_events(spark, folder):
    return _restored(spark, "events", fx.event_states(spark, folder), ["full", "incremental", "incremental"], **_EVENT_MARK)


_LATE = {**_EVENT_MARK, "late_rows": True}


@_register
def highwater_late_restore_events(spark, folder):
    """Late, changed and deleted rows behind the mark, few of a bucket in one run and most of some buckets in the other."""
    return _restored(spark, "events", fx.late_event_states(spark, folder), ["full", "incremental", "incremental"], **_LATE)


@_register
def highwater_late_delta_events(spark, folder):
    """What the last run stores: the rows past the mark, and those behind it that differ with their copies now and before."""
    found = _delta_of(spark, "events", fx.late_event_states(spark, folder)[1:], ["full", "incremental"], **_LATE)
    new = F.col(BEFORE) < 0
    return found.select("event_id", "value", new.alias("past_mark"), F.col(COPIES).alias("copies"), F.when(~new, F.col(BEFORE)).alias("copies_before"))


@_register
def highwater_null_marks(spark, folder):
    """Rows without a mark, before and after: a comparison with the mark finds none of them."""
    marked = [df.withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts"))) for df in fx.event_states(spark, folder)]
    return _restored(spark, "events", marked, ["full", "incremental", "incremental"], **_EVENT_MARK)


@_register
def chain_restore_overlapping_runs(spark, folder):
    """Two incrementals on one full; the one that started later ended first and knows nothing of the other."""
    vault, start = _vault(spark), datetime.now(timezone.utc) - timedelta(hours=1)
    first, before, now = fx.order_states(spark, folder)
    _run(vault, {"orders": first}, start, **_ORDER_KEY)
    later = _run(vault, {"orders": now}, start + timedelta(minutes=2), backup_type="incremental", **_ORDER_KEY)
    _run(vault, {"orders": before}, start + timedelta(minutes=1), backup_type="incremental", **_ORDER_KEY)
    return vault.restore(later.backup_id)["orders"]


@_register
def delta_totals_orders(spark, folder):
    """Counts the manifest carries along a chain: changes of each backup, rows of each state."""
    vault = _vault(spark)
    _history(vault, "orders", fx.order_states(spark, folder), ["full", "incremental", "differential"], **_ORDER_KEY)
    jobs = vault.jobs().select(F.col("id").alias("backup_id"), "backup_type")
    return vault.manifest().join(jobs, "backup_id").select("backup_type", "upserts", "deletes", "state_rows")


@_register
def base_selection(spark, folder):
    base = chains.last_backup(_jobs(spark, folder), "db2", fx.stamp("2024-01-20"), "full")
    return base.select("id", "db_name", "backup_type", "started_at")


@_register
def backup_chains(spark, folder):
    return chains.backup_chains(_jobs(spark, folder))


@_register
def restore_chain_latest(spark, folder):
    jobs = _jobs(spark, folder)
    return chains.restore_chain(jobs, chains.latest_targets(jobs))


@_register
def retention_expired(spark, folder):
    gone = retention.expired_backups(_jobs(spark, folder), fx.stamp("2024-01-31"), 10)
    return gone.select("id", "db_name", "backup_type", "started_at")


@_register
def size_cap_violations(spark, folder):
    return retention.size_violations(_jobs(spark, folder), "100MB").select("id", "db_name", "file_size")
