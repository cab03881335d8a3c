"""Operators over log entries (``level, message, timestamp, module, details``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablevault.functions import scalars as X


def at_least(logs: DataFrame, threshold: str = "info") -> DataFrame:
    """Entries at or above a severity; entries of an unknown level, or of none, count as ``info``."""
    if threshold not in X.LEVELS:
        raise ValueError(f"level must be one of {list(X.LEVELS)}")
    return logs.where(F.coalesce(X.level_rank("level"), F.lit(X.LEVELS["info"])) <= X.LEVELS[threshold])


def errors_only(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("level") == "error")


def write_errors(logs: DataFrame, path: str) -> None:
    """The error file beside the combined one, as JSON lines."""
    errors_only(logs).write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def warnings_in(logs: DataFrame, column: str = "message") -> DataFrame:
    """Tool output that is a warning: not empty and not a mere ``NOTICE``."""
    return logs.where((F.length(column) > 0) & ~X.contains(column, "NOTICE"))


def rendered(timestamp: str | Column = "timestamp", details: str = "details") -> Column:
    """Console form ``time level: [module] message``, the details on a line of their own."""
    module = F.when(F.length("module") > 0, F.concat(F.lit("["), F.col("module"), F.lit("] "))).otherwise("")
    extra = F.when(F.length(details) > 0, F.concat(F.lit("\n"), F.col(details))).otherwise("")
    return F.concat(
        X.local_time(timestamp), F.lit(" "), F.col("level"), F.lit(": "), module, F.coalesce("message", F.lit("")), extra
    )


def tag_module(logs: DataFrame, name: str) -> DataFrame:
    return logs.withColumn("module", F.lit(name))


def redact_details(logs: DataFrame, column: str = "details") -> DataFrame:
    return logs.withColumn(column, X.redact(column))
