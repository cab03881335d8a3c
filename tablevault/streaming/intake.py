"""Continuous intake of JSON log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tablevault.functions.scalars import LEVELS
from tablevault.sources.growing import growing_lines
from tablevault.sources.loglines import parse_lines


def log_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Parsed lines of the files that appear in a folder. Files must arrive complete."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_lines(reader.load(folder))


def start_intake(spark: SparkSession, folder: str, table: str, checkpoint: str, max_files: int | None = None) -> StreamingQuery:
    """Append the lines to a Parquet table, once each, and stop when no file is left.

    Stateless, so no watermark is needed. The table is partitioned by level: the error split is
    a partition of it, read with :func:`errors_of`, and not a second pass over the input.
    Lines that could not be parsed, and levels that are none of ours, are kept under ``unknown`` with the level they
    gave in ``given_level``: foreign logs must not decide how many folders there are.
    """
    return _append(log_stream(spark, folder, max_files), table, checkpoint)


def growing_log_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Parsed lines of log files that are still written to and rotated; half lines wait for their end."""
    return parse_lines(growing_lines(spark, folder, pattern))


def start_growing_intake(spark: SparkSession, folder: str, table: str, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """As :func:`start_intake`, for files that grow: each run appends the lines that were completed since the last."""
    return _append(growing_log_stream(spark, folder, pattern), table, checkpoint)


def _append(lines: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return (
        lines.withColumn("given_level", F.when(~F.col("level").isin(*LEVELS), F.col("level")))
        .withColumn("level", F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise("unknown"))
        .writeStream.format("parquet")
        .partitionBy("level")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )


def stored_logs(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table)


def errors_of(spark: SparkSession, table: str) -> DataFrame:
    """The error split; only its partition is read."""
    return stored_logs(spark, table).where(F.col("level") == "error")
