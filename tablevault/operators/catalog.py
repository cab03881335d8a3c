"""Queries over the job and log catalog. Every function maps frames to a lazy frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevault.functions import scalars as X
from tablevault.model import DEFAULT_LIST_LIMIT, DEFAULT_RECENT_LIMIT


def current_jobs(events: DataFrame) -> DataFrame:
    """Current state of every job from its append-only events.

    The last write per id wins column by column: an event that leaves a column null keeps the
    earlier value. ``max_by`` skips rows whose ordering is null, so one grouped aggregation does
    it, with partial aggregation before the only shuffle.
    """
    columns = [c for c in events.columns if c not in ("id", "seq")]
    return events.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns]
    )


def filter_jobs(
    jobs: DataFrame, status: str | None = "success", db_name: str | None = None, backup_type: str | None = None
) -> DataFrame:
    """Conjunctive list filter; an option left out adds no condition."""
    for column, value in (("status", status), ("db_name", db_name), ("backup_type", backup_type)):
        if value:
            jobs = jobs.where(F.col(column) == value)
    return jobs


def newest(jobs: DataFrame, n: int = DEFAULT_LIST_LIMIT) -> DataFrame:
    """First ``n`` by start time, newest first; the id breaks ties. A top-k, not a full sort."""
    if n < 0:
        raise ValueError("limit must not be negative")
    return jobs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n)


def recent_backups(jobs: DataFrame, db_name: str, db_type: str = "postgresql", n: int = DEFAULT_RECENT_LIMIT) -> DataFrame:
    """Newest successful backups of one database."""
    return newest(filter_jobs(jobs, "success", db_name).where(F.col("db_type") == db_type), n)


def numbered(page: DataFrame) -> DataFrame:
    """1-based position in a page that was already cut by :func:`newest`; the window sees only
    that page, so its single partition is bounded by the limit."""
    w = Window.orderBy(F.col("started_at").desc(), F.col("id").desc())
    return page.withColumn("position", F.row_number().over(w).cast("bigint"))


def list_view(
    jobs: DataFrame,
    status: str | None = "success",
    db_name: str | None = None,
    backup_type: str | None = None,
    limit: int = DEFAULT_LIST_LIMIT,
) -> DataFrame:
    """The backup listing as columns: filter, newest first, position and display texts."""
    page = numbered(newest(filter_jobs(jobs, status, db_name, backup_type), limit))
    return page.select(
        "position",
        X.prefix("id", 16).alias("short_id"),
        X.local_time("started_at").alias("date"),
        "backup_type",
        "status",
        X.join_path("db_type", "db_name").alias("database"),
        X.size_mb_or_na("file_size").alias("size_mb"),
        X.seconds_text(X.duration_millis("duration")).alias("duration_s"),
        F.nullif("file_path", F.lit("")).alias("path"),
        X.prefix(F.nullif("error", F.lit("")), 100).alias("error"),
    )


def count_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("backups"))


def find_job(jobs: DataFrame, job_id: str | Column) -> DataFrame:
    """Lookup by id; an unknown id gives an empty frame."""
    return jobs.where(F.col("id") == job_id)


def _log_columns(logs: DataFrame) -> list[Column]:
    return [
        F.col("backup_job_id"),
        F.col("id").alias("log_id"),
        F.col("timestamp").alias("log_timestamp"),
        F.col("level").alias("log_level"),
        F.col("message").alias("log_message"),
        F.col("details").alias("log_details"),
    ]


def jobs_with_log_rows(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Each job with each of its logs as one row; a job without logs keeps one row of nulls.

    Written as inner join plus the jobs without any log: an inner join lets adaptive execution
    split a job that owns very many logs, which a left join with the logs on the right cannot.
    The ids for the second part are reduced to one per job before they are shuffled.
    """
    entries = logs.select(*_log_columns(logs))
    matched = jobs.join(entries, jobs["id"] == entries["backup_job_id"])
    ids = logs.groupBy(F.col("backup_job_id").alias("id")).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    silent = jobs.join(ids, "id", "left_anti")
    return matched.drop("backup_job_id").unionByName(silent, allowMissingColumns=True)


def job_with_logs(jobs: DataFrame, logs: DataFrame, job_id: str) -> DataFrame:
    """One job with its logs as a sorted array, empty when it has none.

    Restricted to one id on both sides before the array is built, because the array is the
    requested result for that job; use :func:`jobs_with_log_rows` for many jobs.
    """
    job = find_job(jobs, job_id)
    mine = logs.where(F.col("backup_job_id") == job_id)
    entry = F.struct("id", "timestamp", "level", "message", "details")
    grouped = mine.groupBy(F.col("backup_job_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("logs"))
    empty = F.array().cast(grouped.schema["logs"].dataType)
    return job.join(grouped, "id", "left").withColumn("logs", F.coalesce("logs", empty))


def orphan_logs(logs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Logs that name no existing job; must be empty in a sound catalog."""
    ids = jobs.select(F.col("id").alias("backup_job_id"))
    return logs.join(ids, "backup_job_id", "left_anti")


def stale_jobs(jobs: DataFrame, as_of: Column, max_hours: int) -> DataFrame:
    """Jobs still ``running`` after the bound. Reported only; nothing is rewritten."""
    bound = F.make_interval(hours=F.lit(max_hours))
    return jobs.where((F.col("status") == "running") & (F.col("started_at") < as_of - bound))


def job_summary(jobs: DataFrame) -> DataFrame:
    """The report printed after a run, as columns."""
    return jobs.select(
        "id",
        X.join_path("db_type", "db_name").alias("database"),
        "backup_type",
        X.yes_no(F.col("compression_type") != "none").alias("compressed"),
        X.base_name("file_path").alias("file"),
        X.dir_name("file_path").alias("location"),
        F.when(F.col("file_size") > 0, X.size_mb("file_size")).alias("size_mb"),
        X.ratio_percent("compressed_size", "raw_size").alias("ratio_percent"),
        X.seconds_text(X.duration_millis("duration")).alias("duration_s"),
        X.prefix("checksum", 16).alias("checksum16"),
    )
