"""Phrases that occur together more often than their parts, counted in HAT-tries.

A task keeps, for each language, a shallow trie over the word ids of a phrase whose leaves are hash containers; a container that grows
too large bursts into a node, 64 ways by the next bits of the next word's id. When a task holds too many phrases, its
largest subtrees go out whole as sorted runs. Runs meet in prefix partitions (a first word, and one of 64 parts of what follows it, so
that a very common word is many partitions), are merged there in order, and phrases below the least count end there.

Words are counted first, then pairs, then triples. A phrase can be frequent only if both phrases that lack its last or its first word
are, so each round looks up these in a Bloom filter of the round before. The filter has a fixed largest size: a filter that is too
small lets more phrases through, which costs time, and changes no count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevault.llm.common import settle, slots, small_batches

#: On UTF-8 bytes: A-Z lower-cased, and a byte that UTF-8 never has for each end of a piece.
AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Phrases of a container, of a task, and words of a task at most; tokens that are looked at together.
BURST, MOST_PHRASES, MOST_WORDS, TOGETHER = 1 << 15, 1_000_000, 600_000, 1 << 18
#: Bits of a word id that a node branches on.
FAN_BITS = 6
#: Parts of a first word's prefix partition.
PREFIX_PARTS = 64
#: Bits for each entry of a filter, probes of an entry, and bits of a filter at most (32 MiB).
FILTER_BITS, PROBES, MOST_FILTER_BITS = 12, 4, 1 << 28
#: Parts of a language when its best phrases are chosen.
RANK_PARTS = 32


class Subtree:
    """A hash container while it is small, a node with children after it has burst."""

    __slots__ = ("shifts", "counts", "children", "burst")

    def __init__(self, shifts: list[int], burst: int = BURST):
        self.shifts, self.counts, self.children, self.burst = shifts, Counter(), None, burst

    def add(self, keys: np.ndarray) -> int:
        """Count keys; returns how many of them are new."""
        if self.children is None:
            before = len(self.counts)
            self.counts.update(keys.tolist())
            grown = len(self.counts) - before
            if len(self.counts) > self.burst and self.shifts:
                self._burst()
            return grown
        return sum(child.add(some) for child, some in self._dealt(keys, keys))

    def _dealt(self, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[Subtree, np.ndarray]]:
        slot = ((keys >> self.shifts[0]) & ((1 << FAN_BITS) - 1)).astype(np.uint8)
        values = values[np.argsort(slot, kind="stable")]
        ends = np.cumsum(np.bincount(slot, minlength=1 << FAN_BITS))
        for i, (child, hi) in enumerate(zip(self.children, ends.tolist(), strict=True)):
            lo = int(ends[i - 1]) if i else 0
            if hi > lo:
                yield child, values[lo:hi]

    def _burst(self) -> None:
        keys, counts = self.drain()
        self.children = [Subtree(self.shifts[1:], self.burst) for _ in range(1 << FAN_BITS)]
        both = np.stack([keys, counts], axis=1)
        for child, some in self._dealt(keys, both):
            child.counts.update(dict(some.tolist()))

    def __len__(self) -> int:
        return len(self.counts) if self.children is None else sum(map(len, self.children))

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts below, which are forgotten."""
        if self.children is None:
            n = len(self.counts)
            out = np.fromiter(self.counts.keys(), np.int64, n), np.fromiter(self.counts.values(), np.int64, n)
            self.counts = Counter()
            return out
        found = [c.drain() for c in self.children]
        return np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])


class _Words(dict):
    """Ids of words from 1 in order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b"\xff": 0})
        self.names = [b""]
        self._hashes = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number

    def hashes(self) -> np.ndarray:
        new = [xxhash.xxh64_intdigest(w, 42) for w in self.names[len(self._hashes) :]]
        self._hashes = np.concatenate([self._hashes, np.array(new, np.uint64)])
        return self._hashes


# The primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of eight bytes, which is Spark's ``xxhash64`` of a long, for arrays."""
    with np.errstate(over="ignore"):
        h = seed + P5 + np.uint64(8)
        h = _rotated(h ^ (_rotated(value * P2, 31) * P1), 27) * P1 + P4
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def _then(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return hash_long(word, hash_long(key, np.uint64(42)))


def phrase_key(lang: Column, phrase: Column) -> Column:
    """64-bit key of a phrase of a language, the same as the tasks reckon from hashes of words."""
    words = F.transform(F.split(phrase, " ", -1), lambda w: F.xxhash64(w))
    return F.aggregate(words, F.xxhash64(lang), lambda key, w: F.xxhash64(key, w))


class Filter:
    """A Bloom filter of phrases: false never means that a phrase is in."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, level: DataFrame) -> Filter:
        entries = level.count()
        size = 1 << 15
        while size < min(entries * FILTER_BITS, MOST_FILTER_BITS):
            size *= 2
        key = phrase_key(F.col("lang"), F.col("phrase"))
        low, step = F.col("key").bitwiseAND((1 << 31) - 1), F.shiftrightunsigned("key", 33).bitwiseOR(F.lit(1))
        places = [((low + step * i).bitwiseAND(F.lit(size - 1)) + 1) for i in range(PROBES)]
        rows = level.select(key.alias("key")).select(F.explode(F.array(*places)).alias("at"))
        marked = rows.groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        bits = np.zeros(size // 8, np.uint8)
        for r in marked.collect():  # at most MOST_FILTER_BITS / 32768 rows of 4 KiB
            bits[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits)

    def has(self, key: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.bits) * 8 - 1)
        low, step = key & np.uint64((1 << 31) - 1), (key >> np.uint64(33)) | np.uint64(1)
        out = np.ones(len(key), bool)
        for i in range(PROBES):
            at = (low + step * np.uint64(i)) & size
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


RUN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64())])


class _Counting:
    """Phrases of ``length`` words of one task."""

    def __init__(self, length: int, shorter: Filter | None, most: int, burst: int):
        self.length, self.shorter, self.most, self.burst = length, shorter, most, burst
        self.bits = 63 // length
        self.shifts = [self.bits * (length - 1 - i) + j for i in range(length) for j in range(0, self.bits, FAN_BITS)]
        self.words, self.tries, self.held, self.totals = _Words(), {}, 0, Counter()

    def take(self, lang: str, buffer: bytes) -> Iterator[pa.RecordBatch]:
        """Count the phrases of texts that are parted by ends of pieces."""
        words = buffer.translate(AS_WORDS).replace(b"\xff", b" \xff ").split()
        over = self.length - 1
        for lo in range(0, max(len(words) - over, 0), TOGETHER):
            some = words[lo : lo + TOGETHER + over]
            if len(self.words) + len(some) > min(MOST_WORDS, 1 << self.bits) + TOGETHER:
                yield from self.spill(0)
            ids = np.fromiter(map(self.words.__getitem__, some), np.int64, len(some))
            if self.length == 1:
                self.totals[lang] += int(np.count_nonzero(ids))
            keys = ids[: len(ids) - over]
            for i in range(1, self.length):
                keys = (keys << self.bits) | ids[i : len(ids) - over + i]
            keys = keys[self._allowed(lang, ids)]
            trie = self.tries.get(lang)
            if trie is None:
                trie = self.tries[lang] = Subtree(self.shifts, self.burst)
            self.held += trie.add(keys)
            if self.held > self.most:
                yield from self.spill(self.most // 2)

    def _allowed(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """Where a phrase starts whose first and last parts may be frequent."""
        if self.shorter is None:
            return ids > 0
        n, hashes = self.length - 1, self.words.hashes()[ids]
        inside = ids > 0
        key = np.full(len(ids) - n + 1, xxhash.xxh64_intdigest(lang.encode(), 42), np.uint64)
        good = np.ones(len(key), bool)
        for i in range(n):
            key = _then(key, hashes[i : len(ids) - n + 1 + i])
            good &= inside[i : len(ids) - n + 1 + i]
        good[good] = self.shorter.has(key[good])
        return good[:-1] & good[1:]

    def spill(self, down_to: int) -> Iterator[pa.RecordBatch]:
        """Send out the largest subtrees as sorted runs until ``down_to`` phrases are left; 0 forgets the words too."""
        trees = [(lang, t) for lang, root in self.tries.items() for t in (root.children or [root])]
        trees.sort(key=lambda x: len(x[1]), reverse=True)
        names = pa.array(self.words.names, pa.binary())
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        mask = (1 << self.bits) - 1
        for lang, tree in trees:
            if self.held <= down_to:
                break
            keys, counts = tree.drain()
            if tree.children is not None:
                tree.children = None
            self.held -= len(keys)
            if not len(keys):
                continue
            parts = [(keys >> (self.bits * (self.length - 1 - i))) & mask for i in range(self.length)]
            order = np.lexsort([rank[p] for p in parts[::-1]])
            phrase = names.take(pa.array(parts[0][order]))
            for p in parts[1:]:
                phrase = pc.binary_join_element_wise(phrase, names.take(pa.array(p[order])), b" ")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(order), pa.string()), phrase.cast(pa.string()), pa.array(counts[order])], schema=RUN)
        if not down_to:
            self.words, self.tries, self.held = _Words(), {}, 0
            if self.totals:
                yield pa.RecordBatch.from_pydict({"lang": list(self.totals), "phrase": [""] * len(self.totals), "a": list(self.totals.values())}, RUN)
                self.totals = Counter()


def runs(docs: DataFrame, length: int, shorter: Filter | None, most: int = MOST_PHRASES, burst: int = BURST) -> DataFrame:
    """(lang, phrase, a): counts of phrases of ``length`` words, several rows for a phrase, in sorted runs. With words, the empty phrase counts all words."""
    sent = None if shorter is None else docs.sparkSession.sparkContext.broadcast(shorter)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _Counting(length, sent and sent.value, most, burst)
        for batch in small_batches(batches, "text"):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                yield from counting.take(lang, b"\xff".join(texts))
        yield from counting.spill(0)

    return docs.select("lang", "text").mapInArrow(count, "lang string, phrase string, a long")


def merged(rows: DataFrame, least: int) -> DataFrame:
    """Runs merged in prefix partitions, with the phrases that occur ``least`` times or more (and the empty one)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the last phrase seen, which may go on
        for batch in batches:
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            if not n:
                continue
            differs = [pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in ("lang", "phrase")]
            starts = np.flatnonzero(np.r_[True, differs[0] | differs[1]])
            sums = np.add.reduceat(batch.column("a").to_numpy(), starts)
            firsts = batch.take(pa.array(starts)).set_column(2, "a", pa.array(sums))
            left = firsts.slice(len(starts) - 1)
            yield kept(firsts.slice(0, len(starts) - 1))
        if left is not None:
            yield kept(left)

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pc.or_(pc.greater_equal(batch.column("a"), least), pc.equal(batch.column("phrase"), "")))

    part = [F.col("lang"), F.substring_index("phrase", " ", 1), F.pmod(F.xxhash64("phrase"), F.lit(PREFIX_PARTS))]
    ordered = rows.repartition(slots(rows.sparkSession), *part).sortWithinPartitions("phrase", "lang")
    return ordered.mapInArrow(merge, "lang string, phrase string, a long")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, best: int = 2000, overlap: int = 50, most: int = MOST_PHRASES, burst: int = BURST
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language its ``best`` phrases of 2 to ``longest`` (2 or 3) words.

    Words and pieces are those of a text with A-Z lower-cased, split at ``[.,;:!?\\x0A-\\x0D]`` and at blanks and tabs; a null or empty text has none.
    A null lang is ``und``. A phrase that occurs a >= ``least`` times within pieces, overlaps included, is cut in two where
    10^6 a^2 div (l r) is lowest, then leftmost; l and r count its parts, n all words of the language. Phrases inside a longer one with 100 times
    its count >= ``overlap`` times theirs go. Order: score and a descending, phrase ascending by bytes. Every row counts, also where texts
    repeat; an empty table gives no rows; other columns are not looked at. ``most`` and ``burst`` bound a task's memory and change no result.
    """
    if longest not in (2, 3):
        raise ValueError("phrases of up to 2 or 3 words")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    levels: dict[int, DataFrame] = {}
    shorter = None
    for n in range(1, longest + 1):
        levels[n] = settle(merged(runs(docs, n, shorter, most, burst), least), f"phrases-{n}")
        if n < longest:
            shorter = Filter.of(levels[n].where("phrase <> ''"))
    totals = levels[1].where("phrase = ''").select("lang", F.col("a").alias("n"))
    found = None
    for n in range(2, longest + 1):
        rows = _scored(levels, n)
        for m in range(n + 1, longest + 1):
            words = F.split("phrase", " ", -1)
            inside = F.transform(F.sequence(F.lit(1), F.lit(m - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
            longer = levels[m].select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
            rows = rows.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < overlap * F.col("a"), F.lit(True))).drop("longer")
        found = rows if found is None else found.unionByName(rows)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= best)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(levels: dict[int, DataFrame], n: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of n words at the cut that scores lowest."""
    rows, words, cuts = levels[n], F.split("phrase", " ", -1), []
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    for k in range(1, n):
        for name, size, part in ((f"_l{k}", k, F.slice(words, 1, k)), (f"_r{k}", n - k, F.slice(words, k + 1, n - k))):
            parts = levels[size].select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("a").alias(name))
            rows = rows.join(parts, (F.col("lang") == F.col("_lang")) & (F.array_join(part, " ") == F.col("_part"))).drop("_lang", "_part")
        # a <= l and a <= r, so the quotient is at most a million; products of up to 38 digits are exact
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a"), whole(f"_l{k}") * whole(f"_r{k}"))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")))
    cut = F.array_min(F.array(*cuts))
    return rows.withColumn("_cut", cut).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
