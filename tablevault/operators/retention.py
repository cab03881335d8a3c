"""Expiry and size limits over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablevault.functions import scalars as X
from tablevault.model import DEFAULT_RETENTION_DAYS, DEFAULT_SIZE_CAP
from tablevault.plans.chains import position, successful

#: A condemned unit is one for runs that begin this much later; a sweep takes less time to say so.
MARGIN_HOURS = 1


def expired_backups(jobs: DataFrame, as_of: Column, days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    """Successful backups older than ``days`` that no kept backup needs for its restore.

    Old backups precede all kept ones, so only the chain that crosses the cutoff matters, and
    per database it is described by four positions found with grouped maxima and minima:
    the last full up to the first kept backup, and the last full or differential up to the first
    kept incremental. No ordering of a database's jobs in one task is needed. A job still
    ``running`` or ``failed`` is not a backup and is left to :func:`unreferenced`.

    Jobs that recorded the full and the head of their chain are kept by those names instead: a kept
    backup needs its full, and a kept incremental its head and what follows that head.
    """
    if "head_id" in jobs.columns:
        named = jobs.where(F.col("head_id").isNotNull())
        by_order = expired_backups(jobs.where(F.col("head_id").isNull()).drop("full_id", "head_id"), as_of, days)
        return _expired_by_name(named, as_of, days).unionByName(by_order, allowMissingColumns=True)
    cutoff = as_of - F.make_interval(days=F.lit(days))
    kind = F.col("backup_type")
    rows = successful(jobs).withColumn("pos", position()).withColumn("kept", F.col("started_at") >= cutoff)
    narrow = rows.select("db_name", "backup_type", "pos", "kept")
    first = narrow.where("kept").groupBy("db_name").agg(
        F.min("pos").alias("first_kept"),
        F.min(F.when(kind == "incremental", F.col("pos"))).alias("first_kept_inc"),
    )
    needed = (
        narrow.join(first, "db_name")
        .groupBy("db_name")
        .agg(
            F.max(F.when((kind == "full") & (F.col("pos") <= F.col("first_kept")), F.col("pos"))).alias("full_pos"),
            F.max(F.when((kind != "incremental") & (F.col("pos") <= F.col("first_kept_inc")), F.col("pos"))).alias("head_pos"),
        )
    )
    pos = F.col("pos")
    keeps = F.coalesce(pos == F.col("full_pos"), F.lit(False)) | F.coalesce(pos >= F.col("head_pos"), F.lit(False))
    return rows.where(~F.col("kept")).join(needed, "db_name", "left").where(~keeps).drop(
        "pos", "kept", "full_pos", "head_pos"
    )


def _expired_by_name(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    rows = successful(jobs)
    old = F.col("started_at") < as_of - F.make_interval(days=F.lit(days))
    kept = rows.where(~old)
    fulls = kept.select(F.col("full_id").alias("needed")).distinct()
    heads = kept.where(F.col("backup_type") == "incremental").select(F.col("head_id").alias("needed")).distinct()
    left = rows.where(old).join(fulls, F.col("id") == F.col("needed"), "left_anti")
    return left.join(heads, F.col("head_id") == F.col("needed"), "left_anti")


def size_violations(jobs: DataFrame, cap: str | Column = DEFAULT_SIZE_CAP) -> DataFrame:
    """Backups larger than the cap; a cap that cannot be read selects nothing."""
    limit = X.parse_size(F.lit(cap) if isinstance(cap, str) else cap)
    return successful(jobs).where(F.col("file_size") > limit)


def unreferenced(stored: DataFrame, named: DataFrame) -> DataFrame:
    """Stored units (``path``, ...) that nothing names: what failed and expired runs leave, and chunks of which the last backup went."""
    return stored.join(named.select("path").distinct(), "path", "left_anti")


def may_go(loose: DataFrame, marked: DataFrame, oldest: Column | None) -> DataFrame:
    """Loose units that an earlier sweep condemned (``at``) before the oldest run under way began, with a margin for the time that
    condemning takes. Such a run may have found the unit in the catalog; a run that began later does not use it."""
    since = marked.groupBy("path").agg(F.min("at").alias("at"))
    ready = loose.join(since, "path")
    return ready if oldest is None else ready.where(F.col("at") + F.make_interval(hours=F.lit(MARGIN_HOURS)) < oldest)
