"""Language-model scores from a log-frequency Bloom filter of word and bigram counts.

A count c is quantised to level 1 + floor(log_b c) and stored as one filter entry for each level up to its own, so a reader probes
level after level until one is missing. The filter holds every word and bigram of the training texts, from count 1 on, and grows with
their number: it is dealt in segments by hash, as many as the tokens need, and each has the bits that its own entries need.

Nothing of it is sent to the workers: texts are read once into blocks of word numbers; every block asks for its distinct words and
bigrams, bucket by bucket of their hashes. A bucket sums the counts, builds its segments of the filter one after another, and answers
each block with the levels found there, and for words with the exact counts too, which the base score needs. A level is at most its
count, so a segment has about ``SEGMENT_GRAMS`` entries at most, at any size of the input. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablevault.llm.common import WordHash, settle, small_batches, words_of

#: Text of a block, in bytes, and n-grams of a bucket, about.
BLOCK_BYTES, BUCKET_GRAMS = 6 << 20, 2_000_000
#: The filter: n-grams of a segment, about; segments of a filter in one piece; bits and probes for each entry, base of the levels.
SEGMENT_GRAMS, SEGMENTS, BITS_EACH, PROBES, BASE = 1 << 17, 1024, 12, 6, 1.5
#: Weight of the bigram estimate where its context is known.
LAMBDA = 0.4
#: Hashes of the end and of what stands before the first word; a blank is part of no word.
END, START = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
LEVELS = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + mixed(right))


def level_of(counts: np.ndarray) -> np.ndarray:
    """Level of a count of at least 1."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """What a count of that level is expected to be; 0 for level 0."""
    return np.where(levels > 0, (BASE ** (levels - 1.0) + BASE**levels - 1) / 2, 0.0)


class BloomCounts:
    """Bytes of all segments of a filter, or of one, and the lowest level stored."""

    def __init__(self, bits: np.ndarray, lowest: int = 1, segments: int = SEGMENTS):
        self.bits, self.lowest, self.whole = bits, lowest, segments > 1
        self.segment_bits = len(bits) * 8 // segments

    @classmethod
    def segment(cls, grams: np.ndarray, levels: np.ndarray) -> BloomCounts:
        """The segment that holds these n-grams at these levels (1 or more), with ``BITS_EACH`` bits for each entry."""
        bits = np.zeros(max(1024, -(-int(levels.sum()) * BITS_EACH // 8) * 8), bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            grams, levels = grams[levels >= level], levels[levels >= level]
            for i in range(PROBES):
                bits[probe_place(grams, level, i, len(bits), False)] = True
        return cls(np.packbits(bits, bitorder="little"), segments=1)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each n-gram: probes go on until one fails; 0 if the lowest is missing."""
        found, alive, level = np.zeros(len(grams), np.int64), np.arange(len(grams)), self.lowest
        while len(alive) and level < LEVELS:
            for i in range(PROBES):
                at = probe_place(grams[alive], level, i, self.segment_bits, self.whole)
                alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            found[alive] = level
            level += 1
        return found


def probe_place(grams: np.ndarray, level: int, i: int, segment_bits: int, whole: bool) -> np.ndarray:
    """Bit of the i-th probe, within its segment or in the whole filter. The segment is the top of the hash."""
    h = mixed(grams + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    at = ((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * ((h >> np.uint64(32)) | np.uint64(1))) % np.uint64(segment_bits)
    if whole:
        at = at + (grams >> np.uint64(54)) * np.uint64(segment_bits)
    return at.astype(np.int64)


def read_blocks(docs: DataFrame) -> DataFrame:
    """Texts as blocks of numbers: ids, held_out flags, tokens of each text, and each token's place among the block's words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, number = WordHash(), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            tokens = np.concatenate([h[2] for h in held])
            words, place = np.unique(tokens, return_inverse=True)
            row = {
                "block": (part << 32) + number, "doc_ids": [d for h in held for d in h[0]], "held_out": [d for h in held for d in h[1]],
                "sizes": np.concatenate([h[3] for h in held]).astype("<u4").tobytes(), "places": place.astype("<u4").tobytes(), "words": words.astype("<u8").tobytes(),
            }
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_pylist([row], pa.schema(list(zip(row, kinds, strict=True))))

        for batch in small_batches(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            parts, sizes = [], np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                words = words_of(text)
                sizes[i] = len(words) + 1
                parts += [np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), np.array([END], np.uint64)]
                size += len(text or "")
            held.append((batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), np.concatenate(parts), sizes))
            if size >= BLOCK_BYTES:
                yield block()
                held, size, number = [], 0, number + 1
        if held:
            yield block()

    return docs.select("doc_id", "text", "held_out").mapInArrow(read, "block long, doc_ids array<bigint>, held_out array<boolean>, sizes binary, places binary, words binary")


class Block:
    """A block row as arrays."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["block"], row["doc_ids"]
        self.held_out = np.array(row["held_out"], bool)
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.places, self.words = np.frombuffer(row["places"], "<u4"), np.frombuffer(row["words"], "<u8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.trains = np.repeat(~self.held_out, self.sizes)

    def pairs(self) -> np.ndarray:
        """Hash of each token and what stands before it."""
        tokens = self.words[self.places]
        before = np.concatenate(([START], tokens[:-1])).astype(np.uint64)
        before[self.starts] = START
        return pair_hash(before, tokens)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _dealt(bits: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that sorted hashes fall into, by their top bits, and the bounds between them."""
    bucket = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    used, first = np.unique(bucket, return_index=True)
    return used, np.append(first, len(grams))


def ask_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """For every bucket of a block's words: their hashes and how often the block's training texts have them."""
    for row in _rows(batches):
        b = Block(row)
        counts = np.bincount(b.places[b.trains], minlength=len(b.words))
        used, at = _dealt(bits, b.words)
        cells = [(b.words[x:y].tobytes(), counts[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([b.number] * len(used), pa.int64()), *(pa.array([c[i] for c in cells], pa.binary()) for i in (0, 1))], ["bucket", "block", "grams", "counts"])


def ask_pairs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """For every bucket of a block's bigrams: their hashes and how often the block's training texts have them."""
    for row in _rows(batches):
        b = Block(row)
        grams, place = np.unique(b.pairs(), return_inverse=True)
        counts = np.bincount(place[b.trains], minlength=len(grams))
        used, at = _dealt(bits, grams)
        cells = [(grams[x:y].tobytes(), counts[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([b.number] * len(used), pa.int64()), *(pa.array([c[i] for c in cells], pa.binary()) for i in (0, 1))], ["bucket", "block", "grams", "counts"])


COUNTED = "kind int, block long, bucket long, counts binary, levels binary, total long, distinct long"
#: Kinds of rows of a counted bucket: sums, and what a block asked about words and bigrams.
SUMMARY, WORDS, PAIRS = range(3)


def filter_levels(grams: np.ndarray, sums: np.ndarray, deal: int) -> np.ndarray:
    """Level of each n-gram of a sorted bucket as the filter has it. Its 2**deal segments are built and probed one after another."""
    out = np.zeros(len(grams), "u1")
    _, at = _dealt(deal, grams)
    for x, y in zip(at[:-1], at[1:], strict=True):
        mine, known = grams[x:y], sums[x:y] > 0
        out[x:y] = BloomCounts.segment(mine[known], level_of(sums[x:y][known])).levels(mine)
    return out


def count_bucket(table: pa.Table, kind: int, deal: int) -> pa.Table:
    """Sum a bucket and answer: a summary row, and a row of this kind for each block with the levels, and for words the counts."""
    parts = [np.frombuffer(g.as_py(), "<u8") for g in table.column("grams")]
    counts = [np.frombuffer(c.as_py(), "<u4") for c in table.column("counts")]
    flat = np.concatenate(parts)
    order = np.argsort(flat, kind="stable")
    flat, each = flat[order], np.concatenate(counts)[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    grams, sums = flat[first], np.add.reduceat(each, first)
    del flat, each, order
    bucket, levels = table.column("bucket")[0].as_py(), filter_levels(grams, sums, deal)
    rows = [(SUMMARY, -1, bucket, None, None, int(sums.sum()), int((sums > 0).sum()))]
    for block, part in zip(table.column("block").to_pylist(), parts, strict=True):
        at = np.searchsorted(grams, part)
        rows.append((kind, block, bucket, sums[at].astype("<i8").tobytes() if kind == WORDS else None, levels[at].tobytes(), 0, 0))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = ["kind", "block", "bucket", "counts", "levels", "total", "distinct"]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def score(docs: DataFrame) -> DataFrame:
    """Scores of (doc_id, text, held_out): n_tokens, n_known, train_tokens, base_score and score (log10, of the whole text).

    Texts with ``held_out`` true are not learnt from. Words are as in ``WORD``, A-Z lower-cased; one end follows each text, so a
    null or empty text has one token. A null flag counts as false; repeated rows are texts of their own; with nothing
    to learn from, all tokens are unknown; an empty table gives an empty one. Other columns are dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    blocks = settle(read_blocks(docs), "blocks")
    tokens = blocks.agg(F.coalesce(F.sum(F.length("places")), F.lit(0))).first()[0] // 4
    # A bucket is one segment of the filter or several, so what the filter answers does not depend on the size of buckets.
    deal = max(4, int(tokens // SEGMENT_GRAMS).bit_length())
    bits = min(deal, max(4, int(tokens // BUCKET_GRAMS).bit_length()))
    asked = "bucket long, block long, grams binary, counts binary"

    def counted(ask: Callable, kind: int) -> DataFrame:
        return blocks.mapInArrow(partial(ask, bits=bits), asked).groupBy("bucket").applyInArrow(lambda t: count_bucket(t, kind, deal), COUNTED)

    words, pairs = settle(counted(ask_words, WORDS), "words"), settle(counted(ask_pairs, PAIRS), "pairs")
    total, distinct = (v or 0 for v in words.where(F.col("kind") == SUMMARY).agg(F.sum("total"), F.sum("distinct")).first())
    texts = blocks.agg(F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()[0] or 0
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def grade(mine: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(mine.slice(0, 1).to_pylist()[0])
        kinds, order = answers.column("kind").to_numpy(), np.argsort(answers.column("bucket").to_numpy())

        def given(kind: int, column: str, of: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(answers.column(column)[int(i)].as_py(), of) for i in order if kinds[i] == kind])

        exact = given(WORDS, "counts", "<i8")
        base = np.log10((exact + 1) / (total + distinct + 1))
        word = count_of(given(WORDS, "levels", "u1"))
        _, place = np.unique(b.pairs(), return_inverse=True)
        context = np.concatenate((word[b.places], [0]))[np.arange(len(place)) - 1]
        context[b.starts] = texts
        single = (word + 1) / (total + distinct + 1)
        both = count_of(given(PAIRS, "levels", "u1"))[place]
        weight = np.where(context > 0, LAMBDA, 0.0)
        chance = weight * both / np.maximum(np.maximum(context, both), 1) + (1 - weight) * single[b.places]
        per = lambda values: np.add.reduceat(values, b.starts)
        columns = [pa.array(b.doc_ids, pa.int64()), pa.array(b.held_out), pa.array(b.sizes), pa.array(per((exact > 0)[b.places].astype(np.int64)))]
        columns += [pa.array(np.full(len(b.sizes), total)), pa.array(per(base[b.places])), pa.array(per(np.log10(chance)))]
        return pa.table(columns, names)

    answers = words.unionByName(pairs).where(F.col("kind") != SUMMARY).select("kind", "block", "bucket", "counts", "levels")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(grade, schema)
