"""Best-fit packing of token sequences: best fit within a partition, then a tree that merges underfull bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablevault.llm.common import settle, small_batches, unused, without
from tablevault.llm.encoding import encoder

#: Items that one best-fit pass of a task holds at a time.
CHUNK = 1 << 20
#: Partitions whose underfull bins meet in one task of the tree.
FAN_IN = 16
#: Underfull bins, the emptiest first, that a pass hands up the tree. Best fit leaves at most one bin that is no more than
#: half full, so few of them can ever be merged; all others are final where they are.
HANDED_UP = 256


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, ids: bool = False) -> DataFrame:
    """Encode ``text`` (null: empty), close each document with ``end_id`` and cut it into pieces of at most ``capacity``.

    All pieces of a document but its first are full. Adds piece, start, length, ids_crc32 and, if asked for, the ids
    themselves; ``text`` goes, other columns stay (those with a name of a new one are replaced).
    """
    added = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    names = ["piece", "start", "length", "ids_crc32", "ids"]
    docs = without(docs, names)
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"] + [added])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer).encode
        for batch in small_batches(batches, "text"):
            flat, sizes = encode_texts(batch.column("text").to_pylist(), end_id)
            raw, ends = flat.astype("<u4").tobytes(), np.cumsum(sizes)
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = sizes - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[owner], capacity)
            at = (ends - sizes)[owner] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(c).take(pa.array(owner)) for c in kept]
            columns += [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if ids:
                bounds = np.concatenate((at, [len(flat)])).astype(np.int32)  # pieces lie one after another
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [*kept, *names[: 5 if ids else 4]])

    return docs.mapInArrow(encode, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, larger items first: each item's bin and place, and the fill of each bin. Larger items get a bin alone."""
    order = np.argsort(-sizes, kind="stable")
    bins, places, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            target = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, target = max(capacity, size), len(fills)
            fills.append(0)
        bins[item], places[item] = target, fills[target]
        fills[target] += size
        if left := room - size:
            by_room[left].append(target)
            rooms |= 1 << left
    return bins, places, np.array(fills, np.int64)


def pack(pieces: DataFrame, capacity: int = 1024, slack: int | None = None) -> DataFrame:
    """Add sequence_id and offset: pieces of one sequence lie from 0 without gaps and come to at most ``capacity``.

    ``pieces`` needs ``length`` (null counts as 0). Partitions pack by best fit and emit bins with at most ``slack`` room
    (1/64 of the capacity by default); the emptiest of the rest climb a tree and are merged, as items, by best fit again.
    Rows are neither lost nor repeated, equal rows are packed apart, an item above the capacity has a sequence of its own,
    an empty table gives an empty one.
    """
    slack = capacity // 64 if slack is None else slack
    pieces = settle(without(pieces, ["sequence_id", "offset"]), "pieces")
    free, of, into, shift = unused(pieces, "_room", "_bin", "_into", "_shift")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    schema = ", ".join([*fields, "sequence_id long", "offset long", f"{free} long"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        chunk, held, rows = 0, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table.column("length").fill_null(0).to_numpy().astype(np.int64)
            bins, places, fills = best_fit(sizes, capacity)
            base = (task.partitionId() << 36) + (chunk << 20)
            room = np.full(len(bins), -1, np.int64)  # told once for each bin
            room[np.unique(bins, return_index=True)[1]] = capacity - fills
            for name, values in (("sequence_id", base + bins), ("offset", places), (free, room)):
                table = table.append_column(name, pa.array(values, pa.int64()))
            yield from table.to_batches(max_chunksize=50_000)

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                if rows + part.num_rows > CHUNK:
                    yield from packed()
                    chunk, held, rows = chunk + 1, [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from packed()

    placed = settle(pieces.mapInArrow(local, schema), "bins")
    heads = placed.where((F.col(free) > slack) & (F.col(free) < capacity)).select(
        F.col("sequence_id").alias("bin"), F.col(free).alias("room"),
        F.shiftright("sequence_id", 36).alias("node"), F.shiftright("sequence_id", 20).alias("chunk"),
    )
    moves = _tree(heads, capacity, slack)
    if moves is None:
        return placed.drop(free)
    moves = moves.select(F.col("bin").alias(of), F.col("into").alias(into), F.col("shift").alias(shift))
    joined = placed.join(moves, F.col("sequence_id") == F.col(of), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        F.coalesce(into, "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce(shift, F.lit(0))).alias("offset"),
    )


def _emptiest(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["room", "bin"], ascending=[False, True]).head(HANDED_UP)


def _tree(heads: DataFrame, capacity: int, slack: int) -> DataFrame | None:
    """Moves (bin, into, shift) found on the way up; None if there was nothing to merge."""

    def emptiest(frame: pd.DataFrame) -> pd.DataFrame:
        return _emptiest(frame)[["bin", "room", "node"]]

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["room", "bin"]).reset_index(drop=True)
        bins, places, fills = best_fit((capacity - frame.room).to_numpy(), capacity)
        root = pd.Series(frame.bin.to_numpy()[places == 0], index=bins[places == 0])
        merged = pd.DataFrame({"bin": frame.bin, "into": root.loc[bins].to_numpy(), "shift": places, "room": -1, "node": frame.node // FAN_IN})
        own = merged.into == merged.bin
        merged.loc[own, "room"] = capacity - fills[bins[own]]
        up = _emptiest(merged[merged.room > slack])
        return merged.assign(up=merged.bin.isin(up.bin))

    level = settle(heads.groupBy("chunk").applyInPandas(emptiest, "bin long, room long, node long"), "underfull")
    nodes = level.agg(F.countDistinct("node"), F.max("node")).first()
    if not nodes[0]:
        return None
    moves, top = None, nodes[1]
    while True:
        keyed = level.withColumn("key", F.floor(F.col("node") / FAN_IN))
        merged = keyed.groupBy("key").applyInPandas(
            lambda frame: merge(frame.drop(columns="key")), "bin long, into long, shift long, room long, node long, up boolean"
        )
        merged = settle(merged, "merged")
        step = merged.where("bin <> into").select("bin", "into", "shift")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("b2"), F.col("into").alias("i2"), F.col("shift").alias("s2"))
            moved = moves.join(later, F.col("into") == F.col("b2"), "left").select(
                "bin", F.coalesce("i2", "into").alias("into"), (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift")
            )
            moves = moved.unionByName(step)
        if top < FAN_IN:
            return moves
        level, top = merged.where("up").select("bin", "room", "node"), top // FAN_IN
