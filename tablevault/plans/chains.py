"""Which backups belong together.

Per database, over successful backups in ``(started_at, id)`` order: a differential holds the
change since the last full, an incremental the change since the last successful backup. The
restore chain of a backup is the last full up to it and, for a differential, that backup; for an
incremental, the last differential after the full (if any) and every incremental from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def position() -> Column:
    """Place of a backup in the order of its database."""
    return F.struct("started_at", "id")


def successful(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == "success")


def last_backup(jobs: DataFrame, db_name: str, before: Column | None = None, backup_type: str | None = None) -> DataFrame:
    """The base of a new backup: newest successful one (of a type) before a time; 0 or 1 rows."""
    found = successful(jobs).where(F.col("db_name") == db_name)
    if before is not None:
        found = found.where(F.col("started_at") < before)
    if backup_type is not None:
        found = found.where(F.col("backup_type") == backup_type)
    return found.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(1)


def latest_targets(jobs: DataFrame) -> DataFrame:
    """The newest successful backup of every database; one row per database."""
    newest = successful(jobs).groupBy("db_name").agg(
        F.max(F.struct("started_at", "id", "backup_type")).alias("t")
    )
    return newest.select("db_name", F.struct("t.started_at", "t.id").alias("t_pos"), F.col("t.backup_type").alias("t_type"))


def target_of(jobs: DataFrame, backup_id: str) -> DataFrame:
    return successful(jobs).where(F.col("id") == backup_id).select(
        "db_name", position().alias("t_pos"), F.col("backup_type").alias("t_type")
    )


def restore_chain(jobs: DataFrame, targets: DataFrame) -> DataFrame:
    """Members of the restore chain of each target (at most one target per database).

    Only grouped maxima and equi-joins on the database: a database with a third of all jobs is
    pre-aggregated before its shuffle, and never sorted in one task. The output is linear in the
    chain, not in pairs of backups.
    """
    upto = (
        successful(jobs)
        .select("id", "db_name", "backup_type", "started_at")
        .join(targets, "db_name")
        .withColumn("pos", position())
        .where(F.col("pos") <= F.col("t_pos"))
    )
    heads = upto.groupBy("db_name").agg(*_heads())
    return (
        upto.join(heads.where(F.col("full_pos").isNotNull()), "db_name")
        .where(_is_member(F.col("t_type"), F.col("t_pos")))
        .select("db_name", F.col("t_pos.id").alias("target_id"), "id", "backup_type", "started_at")
    )


def _heads() -> list[Column]:
    """Positions of the last full, and of the last full or differential."""
    kind = F.col("backup_type")
    return [
        F.max(F.when(kind == "full", F.col("pos"))).alias("full_pos"),
        F.max(F.when(kind != "incremental", F.col("pos"))).alias("head_pos"),
    ]


def _is_member(t_type: Column, t_pos: Column) -> Column:
    """Whether a backup at or before the target belongs to the target's chain."""
    kind, pos, head = F.col("backup_type"), F.col("pos"), F.col("head_pos")
    return (
        (pos == F.col("full_pos"))
        | ((t_type == "differential") & (pos == t_pos))
        | ((t_type == "incremental") & ((pos == head) | ((kind == "incremental") & (pos > head))))
    )


def literal_position(micros: int, backup_id: str) -> Column:
    """A position as a constant. Times travel as microseconds, which no time zone can bend."""
    return F.struct(F.timestamp_micros(F.lit(micros)).alias("started_at"), F.lit(backup_id).alias("id"))


def chain_members(jobs: DataFrame, end: Column, target_type: str) -> DataFrame:
    """The chain of one target among the jobs of its database, ``end`` being its position.

    The heads are one row; they are fetched and put into the filter, which leaves two small scans
    instead of a join."""
    upto = successful(jobs).withColumn("pos", position()).where(F.col("pos") <= end)
    found = upto.agg(*_heads())
    heads = found.select(
        *[c for n in ("full_pos", "head_pos") for c in (F.unix_micros(f"{n}.started_at").alias(f"{n}_us"), F.col(f"{n}.id").alias(f"{n}_id"))]
    ).first()
    if heads["full_pos_us"] is None:
        return upto.where(F.lit(False))
    fixed = {n: literal_position(heads[f"{n}_us"], heads[f"{n}_id"]) for n in ("full_pos", "head_pos")}
    return upto.withColumns(fixed).where(_is_member(F.lit(target_type), end))


def ancestry(jobs: dict, target: str) -> list:
    """From the full to the target along ``parent_id``; empty if a parent is not there."""
    found = []
    at = target
    while at is not None:
        if at not in jobs:
            return []
        found.append(jobs[at])
        at = jobs[at]["parent_id"]
    return found[::-1]


# Running measures of a database: fulls, heads (fulls and differentials) and incrementals so far, incrementals up to the last
# head, and heads up to the last full.
_SUMS = ("grp", "seg", "inc")
_MARKS = {"inc_at_head": "inc", "seg_at_full": "seg"}


def _carry(totals: DataFrame, by: list[str], unit: str) -> DataFrame:
    """Each unit's totals with what all earlier units of the same ``by`` add up to (``c_``). A mark counts from the start of
    its own unit, so the sum carried into that unit is added before marks are compared; marks only grow."""
    earlier = Window.partitionBy(*by).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    out = totals.withColumns({f"c_{n}": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in _SUMS})
    return out.withColumns({f"c_{m}": F.max(F.col(m) + F.col(f"c_{n}")).over(earlier) for m, n in _MARKS.items()})


def _total(carried: DataFrame, by: list[str]) -> DataFrame:
    """Totals of a larger unit from the carried totals of its smaller ones."""
    marks = [F.max(F.col(m) + F.col(f"c_{n}")).alias(m) for m, n in _MARKS.items()]
    return carried.groupBy(*by).agg(*[F.sum(n).alias(n) for n in _SUMS], *marks)


def _onto(inner: dict[str, str], outer: dict[str, str]) -> dict[str, Column]:
    """Measures counted from the start of a unit, on top of what was carried into the unit. Both map names to columns."""
    sums = {n: F.col(inner[n]) + F.col(outer[n]) for n in _SUMS}
    return sums | {m: F.greatest(F.col(inner[m]) + F.col(outer[n]), F.col(outer[m])) for m, n in _MARKS.items()}


def backup_chains(jobs: DataFrame) -> DataFrame:
    """Every successful backup with its group (running count of fulls), its segment (running
    count of fulls and differentials) and the number of members of its restore chain. Backups
    without an earlier full have chain length null.

    One pass per level carries all measures. Rows are ordered only inside one second of their database, the totals of
    seconds only inside one day, and the totals of days per database: the calendar bounds what any
    task orders, however many jobs a database has. Totals stay where their rows are; only they are
    shuffled from level to level.
    """
    kind = F.col("backup_type")
    names = [*_SUMS, *_MARKS]
    rows = successful(jobs).select("id", "db_name", "backup_type", "started_at")
    rows = rows.withColumn("_second", F.date_trunc("second", F.col("started_at").cast("timestamp")))
    here = Window.partitionBy("db_name", "_second").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.count(F.when(c, 1)).over(here)
    rows = rows.withColumns({"grp": count(kind == "full"), "seg": count(kind != "incremental"), "inc": count(kind == "incremental")})
    rows = rows.withColumns({
        "inc_at_head": F.max(F.when(kind != "incremental", F.col("inc"))).over(here),
        "seg_at_full": F.max(F.when(kind == "full", F.col("seg"))).over(here),
    })
    seconds = rows.groupBy("db_name", "_second").agg(*[F.max(n).alias(n) for n in names])
    seconds = _carry(seconds.withColumn("_day", F.date_trunc("day", "_second")), ["db_name", "_day"], "_second")
    days = _carry(_total(seconds, ["db_name", "_day"]), ["db_name"], "_day")
    days = days.select("db_name", "_day", *[F.col(f"c_{n}").alias(f"d_{n}") for n in names])
    before = seconds.join(days, ["db_name", "_day"]).select(
        "db_name", "_second", *[c.alias(f"b_{n}") for n, c in _onto({n: f"c_{n}" for n in names}, {n: f"d_{n}" for n in names}).items()]
    )
    out = rows.join(before, ["db_name", "_second"]).select(
        "id", "db_name", "backup_type", "started_at", *[c.alias(n) for n, c in _onto({n: n for n in names}, {n: f"b_{n}" for n in names}).items()]
    )
    after_differential = F.when(F.col("seg") > F.col("seg_at_full"), 1).otherwise(0)
    length = (
        F.when(F.col("grp") == 0, F.lit(None))
        .when(kind == "full", 1)
        .when(kind == "differential", 2)
        .otherwise(1 + after_differential + F.col("inc") - F.col("inc_at_head"))
    )
    return out.select("id", "db_name", "backup_type", "started_at", "grp", "seg", length.cast("bigint").alias("chain_length"))
