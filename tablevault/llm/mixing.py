"""Mixing sources to target weights: a splitting tree deals exact quotas of blocks to output shards.

A source's rows fall into blocks by a seeded hash, and its blocks are permuted. The mix takes whole passes over a source and
a last partial one up to the target. The root of the tree holds how many blocks each source gives; every node splits its
counts between its two halves by a multivariate hypergeometric draw whose seed is the node, so any task can walk down to its
own shards. A shard then owns a range of each source's permuted blocks, and its rows are ordered by a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tablevault.llm.common import WORD, settle, without

ADDED = ["size", "source_size", "target", "copies"]
#: Coarse ranges of a source's permuted blocks, for running totals.
COARSE_BITS = 10
#: Rows of a table that is sent to every task at most; a row of source settings takes under 200 bytes.
SENT_ROWS = 100_000
MOST_SOURCES = 1_000_000


def targets(sizes: np.ndarray, weights: np.ndarray, share: float, most: float) -> np.ndarray:
    """``share`` of all sizes by weight; what a source would get beyond ``most`` times its size goes to the others by weight."""
    caps, out = most * sizes, np.zeros(len(sizes))
    open_, left = sizes > 0, share * sizes.sum()
    while open_.any():
        offered = left * weights / weights[open_].sum()
        over = open_ & (offered > caps)
        if not over.any():
            out[open_] = offered[open_]
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return out


def split_quotas(counts: np.ndarray, shards: int, wanted: range, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first block, blocks) for each source, for the shards of ``wanted``, by walking the tree from its root."""
    total = int(counts.sum())

    def walk(lo: int, hi: int, counts: np.ndarray, before: np.ndarray):
        if hi <= wanted.start or lo >= wanted.stop:
            return
        if hi - lo == 1:
            yield lo, before, counts
            return
        mid = (lo + hi) // 2
        room = total * mid // shards - total * lo // shards
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, room, method="marginals")
        yield from walk(lo, mid, draw, before)
        yield from walk(mid, hi, counts - draw, before + draw)

    yield from walk(0, shards, counts, np.zeros(len(counts), np.int64))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block_rows: int = 64,
    shard_words: int = 1 << 20, seed: int = 17, carry: list[str] | None = None,
) -> DataFrame:
    """Add to each row its size, source_size, target (its source's) and ``copies``: array of (shard, epoch, position).

    Size is the number of words of ``text`` (null: 0). Sources in order of code points, null last, have ``weights`` in turn.
    A row appears in the mix once for each entry of ``copies``, in that shard at that position. Each source's words come
    within half a row of its target, none appears more often than ``most`` rounded up, and the result depends on the
    rows and the seed alone. Rows equal in doc_id and text share one hash and are taken together, so they bound the precision
    where a source has many. Sources without words give none. Columns named like an added one are replaced.
    """
    carry = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in ADDED]
    hash_ = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.col("source").cast("string").alias("_source"),
        F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long"), F.lit(0)).alias("_n"), hash_.alias("_u"),
    )
    rows = rows.withColumn("_size", F.greatest("_n", F.lit(0))).drop("_n")
    if "text" not in carry:
        rows = settle(rows, "sized")
    sized = rows.select("_source", "_u", "_size") if "text" not in carry else settle(rows.select("_source", "_u", "_size"), "sized")

    found = sized.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: the weights are for sources, not for rows")
    found.sort(key=lambda r: (r["_source"] is None, (r["_source"] or "").encode()))
    sizes = np.array([r["size"] for r in found], float)
    wanted = targets(sizes, np.array([weights[i % len(weights)] for i in range(len(found))], float), share, most)
    plan = pd.DataFrame({"_source": [r["_source"] for r in found], "_rank": range(len(found)), "source_size": sizes.astype(np.int64), "target": wanted})
    plan["_bits"] = [max(0, math.ceil(math.log2(max(1, r["rows"] / block_rows)))) for r in found]
    plan["_passes"] = [int(t // s) if s else 0 for t, s in zip(wanted, sizes, strict=True)]
    plan["_rest"] = [t - p * s for t, p, s in zip(wanted, plan["_passes"], sizes, strict=True)]

    sources = _frame(docs, plan)
    slotted = _slots(sized, sources)
    cuts = _cuts(slotted, sources)
    plan["_cut"] = [cuts.get(i, (-1, 0))[0] for i in range(len(found))]
    plan["_cut_u"] = [cuts.get(i, (-1, 0))[1] for i in range(len(found))]
    blocks = (2 ** plan["_bits"] * plan["_passes"] + plan["_cut"] + 1).to_numpy(np.int64) if len(plan) else np.zeros(0, np.int64)
    shards = max(1, round(wanted.sum() / shard_words))
    owners = _owners(docs, blocks, plan["_bits"].tolist(), shards, seed)

    few = owners.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    out = _slots(rows, _frame(docs, plan)).join(F.broadcast(owners) if few else owners, ["_rank", "_slot"], "left")
    inside = lambda c: (c["epoch"] < F.col("_passes")) | (F.col("_slot") < F.col("_cut")) | (F.col("_u") <= F.col("_cut_u"))
    place = lambda c: F.struct(c["shard"].alias("shard"), c["epoch"].alias("epoch"), F.xxhash64(F.lit(seed), F.col("_u"), c["epoch"]).alias("position"))
    copies = F.transform(F.filter(F.coalesce("_owned", F.expr("cast(array() as array<struct<epoch:int,shard:long>>)")), inside), place)
    return out.select(
        *[F.col("_row")[c].alias(c) for c in carry], F.col("_size").alias("size"), "source_size", "target", F.when(F.col("_size") > 0, copies).otherwise(F.slice(copies, 1, 0)).alias("copies")
    )


def mixed_rows(planned: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy, with shard, epoch and position."""
    rows = without(planned, ["shard", "epoch", "position"])
    return rows.withColumn("_copy", F.explode("copies")).select(*[c for c in rows.columns if c not in ADDED], "_copy.*")


def shuffled(planned: DataFrame) -> DataFrame:
    """The mix with the rows of a shard together and in their shuffled order."""
    return mixed_rows(planned).repartition("shard").sortWithinPartitions("shard", "position")


def _frame(docs: DataFrame, plan: pd.DataFrame) -> DataFrame:
    kinds = {"_source": "string", "_rank": "int", "source_size": "long", "target": "double", "_bits": "int", "_passes": "int", "_rest": "double", "_cut": "long", "_cut_u": "long"}
    rows = [tuple(None if v is None else v for v in r) for r in plan.astype(object).itertuples(index=False)]
    return docs.sparkSession.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in plan.columns))


def _slots(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's settings and the place of their block in the source's permutation."""
    few = sources.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    sources = sources.withColumnRenamed("_source", "_of")
    out = rows.join(F.broadcast(sources) if few else sources, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of", "_source")
    mask = F.expr("shiftleft(1L, _bits) - 1")
    out = out.withColumn("_b", F.col("_u").bitwiseAND(mask))
    # Each step maps the numbers below 2^bits onto themselves: odd factors, and a shift by half the bits.
    out = out.withColumn("_b", (F.col("_b") * 668265263 + F.col("_rank").cast("long") * 374761393).bitwiseAND(mask))
    out = out.withColumn("_b", F.expr("_b ^ shiftright(_b, greatest(1, cast((_bits + 1) / 2 as int)))"))
    return out.withColumn("_slot", (F.col("_b") * 461845907 + 1013904223).bitwiseAND(mask)).drop("_b")


def _cuts(slotted: DataFrame, sources: DataFrame) -> dict[int, tuple[int, int]]:
    """For each source with a partial pass: the block at which it ends, and the last row hash that it takes there."""
    blocks = slotted.where("_rest > 0").groupBy("_rank", "_slot").agg(F.sum("_size").alias("n"), F.first("_rest").alias("rest"), F.first("_bits").alias("bits"))
    blocks = settle(blocks.withColumn("coarse", F.expr(f"shiftright(_slot, greatest(0, bits - {COARSE_BITS}))")), "blocks")

    def reached(frame: DataFrame, by: list[str], order: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return frame.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))

    coarse = reached(blocks.groupBy("_rank", "coarse").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")), ["_rank"], "coarse")
    coarse = coarse.select("_rank", "coarse", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"))
    fine = reached(blocks.drop("rest").join(coarse, ["_rank", "coarse"]), ["_rank"], "_slot")
    fine = settle(fine.select("_rank", "_slot", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest")), "cut-blocks")
    rows = slotted.select("_rank", "_slot", "_u", "_size").join(fine, ["_rank", "_slot"]).groupBy("_rank", "_slot", "rest", "_u").agg(F.sum("_size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_rank").orderBy("_u").rowsBetween(Window.unboundedPreceding, 0))
    near = rows.withColumn("upto", upto).withColumn("off", F.abs(F.col("upto") - F.col("rest"))).where(F.col("off") < F.col("rest"))
    best = near.groupBy("_rank").agg(F.min_by("_u", F.struct("off", "upto")).alias("u"))
    lowest = -(1 << 63)
    return {r["_rank"]: (r["_slot"], lowest if r["u"] is None else r["u"]) for r in fine.join(best, "_rank", "left").collect()}


def _owners(docs: DataFrame, blocks: np.ndarray, bits: list[int], shards: int, seed: int) -> DataFrame:
    """(_rank, _slot) and the (epoch, shard) pairs that own the block."""
    spark = docs.sparkSession

    def quotas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                for shard, first, count in split_quotas(blocks, shards, range(int(batch.id.min()), int(batch.id.max()) + 1), seed):
                    used = np.flatnonzero(count)
                    yield pd.DataFrame({"_rank": used, "shard": shard, "first": first[used], "count": count[used], "bits": [bits[i] for i in used]})

    table = spark.range(shards).mapInPandas(quotas, "_rank int, shard long, first long, count long, bits int")
    each = table.select("_rank", "shard", "bits", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("e"))
    each = each.select("_rank", F.expr("e & (shiftleft(1L, bits) - 1)").alias("_slot"), F.expr("cast(shiftright(e, bits) as int)").alias("epoch"), "shard")
    return each.groupBy("_rank", "_slot").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("_owned"))  # one for each pass
