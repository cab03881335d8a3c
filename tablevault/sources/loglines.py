"""JSON log lines, batch: level, message, timestamp and module, anything else kept as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The members every log line has; others are extra details.
KNOWN = ["level", "message", "timestamp", "module"]


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``level, message, timestamp, module, details, _corrupt_record`` from one JSON text per row.

    Extra members keep their JSON types in ``details``. A line that is not a JSON object goes
    whole to ``_corrupt_record``."""
    raw = F.col(column)
    parsed = lines.select(raw.alias("_line"), F.try_parse_json(raw).alias("_v"))
    # an array or a bare scalar is valid JSON but no log line
    is_object = F.coalesce(F.ltrim("_line").startswith("{") & F.col("_v").isNotNull(), F.lit(False))
    members = F.when(is_object, F.col("_v").cast("map<string,variant>"))
    opened = parsed.select("_line", members.alias("_m"))
    text = lambda k: F.col("_m")[k].cast("string")
    extra = F.map_filter("_m", lambda k, _v: ~k.isin(KNOWN))
    return opened.select(
        text("level").alias("level"),
        text("message").alias("message"),
        text("timestamp").try_cast("timestamp").alias("timestamp"),
        text("module").alias("module"),
        F.when(F.size(extra) > 0, F.to_json(extra)).alias("details"),
        F.when(F.col("_m").isNull(), F.col("_line")).alias("_corrupt_record"),
    )


def read_log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_lines(spark.read.text(list(paths)))
