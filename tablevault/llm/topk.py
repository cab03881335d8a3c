"""Exact top-k by inner product: branch and bound over blocks of dimensions in vertical layout.

Vectors become integers and are packed, block by block of rows, as a matrix with a row for each dimension. Within a pair of
blocks, products are summed dimension block by dimension block. After each, what the rest can still add lies within the
product of the two remaining norms (Cauchy-Schwarz), so candidates that cannot reach the k-th best lower bound of a query
are compacted away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevault.llm.common import settle

#: Rows of a packed block, dimensions summed at a time, and queries bounded together.
BLOCK, DIMENSIONS, TOGETHER = 1 << 14, 16, 64
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53


def to_integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): floor(256 * x) of each component as double. Null, partly null and non-finite vectors and null ids are left out."""
    v = F.col(f"`{vector}`")
    ok = v.isNotNull() & F.col(f"`{key}`").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(ok).select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def _packed(rows: DataFrame, block: Column) -> DataFrame:
    """One row for each block: ids, and the components dimension by dimension (shorter vectors end in zeros)."""

    def pack(table: pa.Table) -> pa.Table:
        ids, lists = table.column("id").combine_chunks(), table.column("v").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(sizes.max()) if len(sizes) else 0
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        matrix = np.zeros((len(sizes), width), np.int64)
        matrix[np.arange(width) < sizes[:, None]] = flat
        order = np.argsort(ids.to_numpy(), kind="stable")
        names = ["block", "n", "ids", "cells"]
        cells = [table.column("block")[0].as_py(), len(sizes), ids.to_numpy()[order].tobytes(), np.ascontiguousarray(matrix[order].T).tobytes()]
        return pa.table([pa.array([c]) for c in cells], names)

    return rows.withColumn("block", block).groupBy("block").applyInArrow(pack, "block long, n long, ids binary, cells binary")


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, cells: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best candidates of a block (ids, scores). Matrices have a row for each dimension."""
    width = max(len(queries), len(cells))
    queries, cells = (np.pad(m, ((0, width - len(m)), (0, 0))) for m in (queries, cells))
    most = lambda m: int(np.abs(m).max()) if m.size else 0
    if width * most(queries) * most(cells) < EXACT:
        work = np.float64
    elif width * most(queries) * most(cells) < 1 << 63:
        work = np.int64
    else:
        raise OverflowError("scores of these vectors do not fit into 64 bits")
    queries, cells = queries.astype(work), cells.astype(work)
    steps = [*range(0, width, DIMENSIONS), width]
    rest = lambda m: np.sqrt(np.stack([(m[s:].astype(float) ** 2).sum(0) for s in steps[1:]] or [np.zeros(m.shape[1])]))
    query_rest, cell_rest = rest(queries), rest(cells)
    for at in range(0, queries.shape[1], TOGETHER):
        part = queries[:, at : at + TOGETHER]
        sums = part[: DIMENSIONS].T @ cells[: DIMENSIONS]
        own = ids[None, :] == query_ids[at : at + TOGETHER, None]
        for q in range(part.shape[1]):
            alive, total = np.flatnonzero(~own[q]), sums[q][~own[q]]
            for step in range(1, len(steps)):
                slack = query_rest[step - 1, at + q] * cell_rest[step - 1, alive] * (1 + 1e-9) + 1e-6
                if len(alive) > k and step < len(steps) - 1:
                    low = total - slack
                    stay = total + slack >= np.partition(low, len(low) - k)[len(low) - k]
                    alive, total = alive[stay], total[stay]
                if step < len(steps) - 1:
                    lo, hi = steps[step], steps[step + 1]
                    total = total + part[lo:hi, q] @ cells[lo:hi, alive]
            order = np.lexsort((ids[alive], -total))[:k]
            yield int(query_ids[at + q]), ids[alive[order]], total[order].astype(np.int64)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query, ties to the smaller id.

    Both frames are (id, v) as ``to_integers`` gives them; candidates with the query's own id are left out, ids that
    occur several times count as several candidates, and as queries each of their rows is searched and the k best of all are
    given. Shorter vectors count as ending in zeros. Fewer than k candidates
    give fewer rows, none give no rows.
    """
    n, q = candidates.count(), queries.count()
    # Rows that repeat one id are dealt by their components too, so no block outgrows the others.
    block = lambda rows: F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-rows // BLOCK))))
    cells = settle(_packed(candidates, block(n)), "cells")
    asked = settle(_packed(queries, block(q)), "queries")
    every_cell, every_asked = (F.sequence(F.lit(0).cast("long"), F.lit(max(0, -(-m // BLOCK) - 1)).cast("long")) for m in (n, q))
    left = cells.select("block", F.explode(every_asked).alias("of"), "ids", "cells", F.lit(True).alias("cell"))
    right = asked.select(F.explode(every_cell).alias("block"), F.col("block").alias("of"), "ids", "cells", F.lit(False).alias("cell"))

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if mine.num_rows and theirs.num_rows:
            (ids, cells), (query_ids, asked) = ((np.frombuffer(t.column("ids")[0].as_py(), np.int64), np.frombuffer(t.column("cells")[0].as_py(), np.int64)) for t in (mine, theirs))
            for query, found, scores in best_of_block(asked.reshape(-1, len(query_ids)), query_ids, cells.reshape(-1, len(ids)), ids, k):
                out["query_id"].append(np.full(len(found), query))
                out["vec_id"].append(found)
                out["score"].append(scores)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in out.items()})

    pairs = left.groupBy("block", "of").cogroup(right.groupBy("block", "of")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
