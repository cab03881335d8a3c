"""Chat formatting from every participant's perspective: that speaker is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Turns whose lengths are summed in one window; a longer conversation is summed range by range.
RANGE = 1024
#: Fixed marks of the rendering.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame) -> DataFrame:
    """A row for each turn of each rendering: conv_id, perspective, turn, role, piece, start, length, mask_start, mask_end.

    Every role but ``system`` that speaks in a conversation is a participant and gets a rendering: its turns are written as
    ``assistant``, others' as ``user name=<role>``, system turns as ``system``; pieces in turn order give the dialogue, and
    ``start`` is the piece's place in it in code points. The mask covers what the assistant says and its closing mark,
    mask_start and mask_end are null elsewhere. A null role speaks as ``unknown``, a null text is empty, null turns come first;
    turns that repeat are ordered by role and text, equal rows stay; a conversation of system turns only has no rendering;
    null conv_id counts as one conversation. Other columns are dropped.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))
    people = said.where("role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    each = said.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("role") == F.col("perspective")
    name = F.when(own, "assistant").when(F.col("role") == "system", "system").otherwise(F.concat(F.lit("user name="), F.col("role")))
    each = each.withColumn("_head", F.concat(F.lit(OPEN), name, F.lit("\n"))).withColumn("piece", F.concat("_head", "text", F.lit(CLOSE)))
    each = each.withColumn("length", F.length("piece").cast("long")).withColumn("_range", F.floor(F.col("turn") / RANGE))
    of = ["conv_id", "perspective"]
    ranges = each.groupBy(*of, "_range").agg(F.sum("length").alias("_sum"))
    earlier = Window.partitionBy(*of).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(c).alias(f"_{c}") for c in of], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("perspective") == F.col("_perspective")) & F.col("_range").eqNullSafe(F.col("_r"))
    inside = Window.partitionBy(*of, "_range").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_in", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(ranges, same)
    start = (F.col("_before") + F.col("_in")).alias("start")
    spoken = (F.col("_before") + F.col("_in") + F.length("_head")).cast("long")
    return each.select(
        "conv_id", "perspective", "turn", "role", "piece", start, "length",
        F.when(own, spoken).alias("mask_start"), F.when(own, F.col("_before") + F.col("_in") + F.col("length")).alias("mask_end"),
    )
