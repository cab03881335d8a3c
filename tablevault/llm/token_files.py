"""Token ids in files compressed by a Re-Pair grammar for each segment, with random access by document and by position.

One row of the written table is a segment: documents one after another in ascending id, the rules of its own grammar (each
a pair of symbols), the expansion length of each rule, and the symbols that remain. Symbols below ``first_rule`` are token
ids, the others rules in order. No rule spans two documents, so a document is a slice of symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevault.llm.common import small_batches
from tablevault.llm.encoding import encoder, gather

SEGMENT_SCHEMA = (
    "shard int, start long, n_tokens long, doc_ids array<bigint>, first_rule int, token_counts binary, symbol_counts binary, "
    "rules binary, expansions binary, symbols binary"
)


#: Stored bytes of a rule (its pair and its expansion length), and slots in which pairs are counted roughly before exactly.
RULE_BYTES, SLOTS = 12, 1 << 20


def symbol_kind(symbols: int) -> str:
    """How symbols are stored when there are so many different ones."""
    return "<u2" if symbols <= 1 << 16 else "<u4"


def replace_pairs(symbols: np.ndarray, last: np.ndarray, first_rule: int, rounds: int | None = None, each: int | None = None, least: int | None = None):
    """Re-Pair in rounds, frequent pairs first, until none occurs ``least`` times; by default as often as pays for its rule.

    A round takes the pairs down to a bound (``each`` of them at most), the next one goes on to a quarter of it. Where chosen
    pairs overlap the more frequent one wins, and a pair that is left with too few places waits for a later round. ``last`` marks
    the final symbol of each document, which starts no pair. Returns symbols, marks and rules.
    """
    rules, done, bound = np.zeros((0, 2), np.uint32), 0, len(symbols)
    while len(symbols) > 1 and (rounds is None or done < rounds):
        enough = least or RULE_BYTES // np.dtype(symbol_kind(first_rule + len(rules))).itemsize + 1
        left, right = symbols[:-1], symbols[1:]
        slot = (left * np.uint32(2654435761) ^ right * np.uint32(2246822519)) >> np.uint32(12)
        slot[last[:-1]] = SLOTS
        counts = np.bincount(slot, minlength=SLOTS + 1)
        counts[SLOTS] = 0
        bound = max(enough, min(bound // 4, int(counts.max()) // 2))
        at = np.flatnonzero((counts >= bound)[slot])
        twin = np.flatnonzero(left[at] == right[at])  # a pair that overlaps itself: every second place, from the left
        run = np.cumsum(np.diff(at[twin], prepend=-2) != 1)
        at = np.delete(at, twin[(np.arange(len(twin)) - np.searchsorted(run, run, "left")) % 2 == 1])
        pair = left[at].astype(np.uint64) << np.uint64(32) | right[at]
        kinds, index, times = np.unique(pair, return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(times >= bound)
        if not len(chosen):
            if bound == enough:
                break
            continue
        chosen = chosen[np.argsort(-times[chosen], kind="stable")[:each]]
        rank = np.full(len(kinds), len(chosen))
        rank[chosen] = np.arange(len(chosen))
        mine = rank[index]
        at, mine = at[mine < len(chosen)], mine[mine < len(chosen)]
        near, wins = np.diff(at) == 1, np.ones(len(at), bool)
        wins[:-1] &= ~near | (mine[:-1] < mine[1:])
        wins[1:] &= ~near | (mine[1:] < mine[:-1])
        at, mine = at[wins], mine[wins]
        pays = np.bincount(mine, minlength=len(chosen)) >= enough  # the most frequent pair keeps all its places
        at, mine, chosen = at[pays[mine]], mine[pays[mine]], chosen[pays]
        symbols, last = symbols.copy(), last.copy()
        symbols[at] = first_rule + len(rules) + (np.cumsum(pays) - 1)[mine]
        last[at] = last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last, done = symbols[stay], last[stay], done + 1
        rules = np.concatenate((rules, np.stack((kinds[chosen] >> np.uint64(32), kinds[chosen] & np.uint64(0xFFFFFFFF)), 1).astype(np.uint32)))
    return symbols, last, rules


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for. A rule uses earlier rules only."""
    out = np.ones(len(rules), np.int64)
    for i, pair in enumerate(rules.tolist()):
        out[i] = sum(out[s - first_rule] if s >= first_rule else 1 for s in pair)
    return out


class Segment:
    """A segment row, decoded as far as asked."""

    def __init__(self, row: dict):
        view = lambda name, kind: np.frombuffer(row[name], kind)
        self.doc_ids, self.first_rule = row["doc_ids"], row["first_rule"]
        self.token_counts, self.symbol_counts = view("token_counts", "<u4").astype(np.int64), view("symbol_counts", "<u4").astype(np.int64)
        rules, self.expansions = view("rules", "<u4").reshape(-1, 2), view("expansions", "<u4").astype(np.int64)
        wide = len(row["symbols"]) == 4 * int(self.symbol_counts.sum())
        self.symbols = view("symbols", "<u4" if wide else "<u2")
        starts = np.cumsum(self.expansions) - self.expansions
        self.flat = np.zeros(int(self.expansions.sum()), np.uint32)
        self.starts = starts
        for i, pair in enumerate(rules.tolist()):
            at = starts[i]
            for s in pair:
                part = self.flat[starts[s - self.first_rule] :][: self.expansions[s - self.first_rule]] if s >= self.first_rule else [s]
                self.flat[at : at + len(part)] = part
                at += len(part)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        rule = symbols >= self.first_rule
        which = symbols[rule].astype(np.int64) - self.first_rule
        sizes = np.ones(len(symbols), np.int64)
        sizes[rule] = self.expansions[which]
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        out[(ends - sizes)[~rule]] = symbols[~rule]
        inside = np.ones(len(out), bool)
        inside[(ends - sizes)[~rule]] = False
        out[inside] = gather(self.flat, self.starts[which], self.expansions[which])
        return out

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from its own symbols only."""
        ends = np.cumsum(self.symbol_counts)
        return self.expand(self.symbols[ends[i] - self.symbol_counts[i] : ends[i]])

    def between(self, start: int, stop: int) -> np.ndarray:
        """Ids from one position of the segment up to another; only symbols that touch the range are expanded."""
        symbols = self.symbols.astype(np.int64)
        sizes = np.ones(len(symbols), np.int64)
        sizes[symbols >= self.first_rule] = self.expansions[symbols[symbols >= self.first_rule] - self.first_rule]
        ends = np.cumsum(sizes)
        first, past = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[first - 1]) if first else 0
        return self.expand(self.symbols[first:past])[start - skipped : stop - skipped]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment: int = 1 << 20, rounds: int | None = None, each: int | None = None, least: int | None = None,
) -> None:
    """Encode ``text`` (null: empty) of (doc_id, text), close each document with ``end_id`` and write the files to ``path``.

    Rows are dealt by ranges of doc_id (null first; equal ids by their texts), one shard for each range; a segment has about
    ``segment`` ids, and a document is never divided. By default pairs are replaced until none pays for its rule. Other columns are ignored; an empty table gives an empty one.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, shard, done = encoder(tokenizer), TaskContext.get().partitionId(), 0
        first_rule = kept.tokenizer.get_vocab_size()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            doc_ids = [d for ids, _, _ in held for d in ids]
            sizes, flat = np.concatenate([h[2] for h in held]), np.concatenate([h[1] for h in held])
            last = np.zeros(len(flat), bool)
            last[np.cumsum(sizes) - 1] = True
            symbols, last, rules = replace_pairs(flat, last, first_rule, rounds, each, least)
            ends = np.flatnonzero(last) + 1
            kind = symbol_kind(first_rule + len(rules))
            row = {
                "shard": shard, "start": done, "n_tokens": len(flat), "doc_ids": doc_ids, "first_rule": first_rule,
                "token_counts": sizes.astype("<u4").tobytes(), "symbol_counts": np.diff(ends, prepend=0).astype("<u4").tobytes(),
                "rules": rules.astype("<u4").tobytes(), "expansions": rule_lengths(rules, first_rule).astype("<u4").tobytes(),
                "symbols": symbols.astype(kind).tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], _arrow_schema())

        for batch in small_batches(batches, "text", 2 << 20):
            flat, sizes = kept.encode(batch.column("text").to_pylist(), end_id)
            held.append((batch.column("doc_id").to_pylist(), flat, sizes))
            if (n := sum(len(h[1]) for h in held)) >= segment:
                yield packed()
                done, held = done + n, []
        if held:
            yield packed()

    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    dealt = dealt.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "text").mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in SEGMENT_SCHEMA.split(", "))])


def read_segments(spark, path: str) -> DataFrame:
    """The written table, with ``before``: the ids of all shards that come before the segment's own."""
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    shards = table.groupBy("shard").agg(F.sum("n_tokens").alias("total"))  # a row for each shard, whatever its size
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("shard", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("before"))
    return table.join(before, "shard")


def decode_documents(spark, path: str, ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                part = Segment(row)
                flat, sizes = part.expand(part.symbols), part.token_counts
                raw, ends = flat.astype("<u4").tobytes(), np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(part.doc_ids, pa.int64()), pa.array(row["before"] + row["start"] + starts), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    bounds = np.concatenate(([0], ends)).astype(np.int32)
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    needed: list[Column | str] = ["start", "doc_ids", "first_rule", "token_counts", "symbol_counts", "rules", "expansions", "symbols", "before"]
    return read_segments(spark, path).select(*needed).mapInArrow(decode, schema)
