"""Ranked lexical search of many items at once, sharing what items have in common.

A document's score for an item is a sum over the item's terms, so a set of terms that several items share is summed once for a
document and used by all of them. Within a block of items, such sets are mined as a graph: a node is a term or the sum of two nodes, an
item is a short list of nodes. The documents are read once for their term counts; then every batch of documents fills the
accumulators of a block's terms, adds up its nodes in order, each once, and combines them into the scores of all items.

Items travel in waves whose graphs have a bounded size; more items mean more waves, never larger ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablevault.llm.common import settle, small_batches
from tablevault.llm.sharding import numbered

#: A term: letters and digits of ASCII and whatever lies beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on UTF-8 bytes: A-Z lower-cased, what separates terms blank.
AS_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Items of a block, and bytes of the terms and graphs that travel in one wave (a block alone may be larger).
BLOCK_ITEMS, WAVE_BYTES = 256, 32 << 20
#: Accumulators held at a time, and candidates that are gathered before the best of each item are kept.
CELLS, GATHERED = 2_000_000, 500_000
#: Orders in which nodes are compared with their neighbours.
ROUNDS = 32

GRAPH = "block long, classes array<long>, terms array<string>, first array<int>, second array<int>, sizes array<int>, nodes array<int>, bytes long"


def share(sets: list[list[int]], terms: int, rounds: int = ROUNDS) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Sums shared by several sets: (pairs of nodes to add, in order; the nodes of each set).

    Nodes below ``terms`` are the terms, the others the pairs. In each round nodes are ordered by the sets they are part of, under
    a new order of the sets, and neighbours that two sets or more have in common are added up.
    """
    within: list[set[int]] = [set() for _ in range(terms)]
    for i, s in enumerate(sets):
        for t in s:
            within[t].add(i)
    pairs: list[tuple[int, int]] = []
    rng, idle = np.random.default_rng(terms), 0
    for _ in range(rounds):
        order = rng.permutation(len(sets)).tolist()
        live = sorted((sorted(order[i] for i in w), node) for node, w in enumerate(within) if len(w) > 1)
        found, at = len(pairs), 0
        while at + 1 < len(live):
            a, b = live[at][1], live[at + 1][1]
            both = within[a] & within[b]
            if len(both) > 1:
                within[a] -= both
                within[b] -= both
                within.append(both)
                pairs.append((a, b))
                at += 1
            at += 1
        idle = 0 if len(pairs) > found else idle + 1
        if idle == 3:
            break
    parts: list[list[int]] = [[] for _ in sets]
    for node, w in enumerate(within):
        for i in w:
            parts[i].append(node)
    return pairs, parts


def _mined(table: pa.Table) -> pa.Table:
    """The graph of a block of term sets, as one row."""
    sets, classes = table.column("terms").to_pylist(), table.column("class").to_pylist()
    names: dict[str, int] = {}
    numbers = [[names.setdefault(t, len(names)) for t in s] for s in sets]
    pairs, parts = share(numbers, len(names))
    row = {
        "block": table.column("block")[0].as_py(), "classes": classes, "terms": list(names), "first": [a for a, _ in pairs],
        "second": [b for _, b in pairs], "sizes": [len(p) for p in parts], "nodes": [n for p in parts for n in p],
        "bytes": sum(len(t) + 40 for t in names) + 8 * len(pairs) + 4 * sum(map(len, parts)) + 12 * len(sets),
    }
    kinds = {"block": pa.int64(), "classes": pa.list_(pa.int64()), "terms": pa.list_(pa.string()), "bytes": pa.int64()}
    return pa.Table.from_pylist([row], pa.schema([(c, kinds.get(c, pa.list_(pa.int32()))) for c in row]))


def term_sets(items: DataFrame) -> DataFrame:
    """(item_id, terms, key): the distinct terms of each item in order, and a SHA-256 of them. Rows that share an item_id (or have none) are one item; an
    item without terms is left out."""
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    sets = each.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return sets.withColumn("key", F.sha2(F.array_join("terms", " "), 256))


def graphs(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal term sets are one class: (key, class), and a row for each block of classes, similar ones side by side."""
    alike = F.array_min(F.transform("terms", lambda t: F.xxhash64(t)))
    classes, _ = numbered(sets.groupBy("key").agg(F.first("terms").alias("terms")), [alike, F.col("key")])
    classes = settle(classes.withColumnRenamed("row_number", "class"), "classes")
    blocks = classes.select("class", "terms", F.call_function("div", "class", F.lit(BLOCK_ITEMS).cast("long")).alias("block"))
    return classes.select("key", "class"), settle(blocks.groupBy("block").applyInArrow(_mined, GRAPH), "graphs")


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, ids, tfs): all terms of each document counted, and those among ``terms`` with their numbers and counts."""
    numbers = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in small_batches(batches, "text"):
            lengths, sizes, ids, tfs = [], [0], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.translate(AS_TERMS).split() if text else []
                found = Counter(known[w] for w in words if w in known)
                lengths.append(len(words))
                ids.extend(found.keys())
                tfs.extend(found.values())
                sizes.append(len(ids))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((ids, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, ids array<int>, tfs array<long>")


def document_frequencies(counted: DataFrame) -> DataFrame:
    """(id, df) of the terms that occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(batch.column("ids").flatten().to_numpy(zero_copy_only=False))
            total = np.pad(total, (0, max(0, len(found) - len(total))))
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "df"])

    return counted.select("ids").mapInArrow(count, "id int, df long").groupBy("id").agg(F.sum("df").alias("df"))


class _Best:
    """The best rows of each item so far, ties to smaller and then to null ids."""

    def __init__(self, items: int, most: int):
        self.most, self.least = most, np.ones(items, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 4
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, without: np.ndarray) -> None:
        item, row = np.nonzero(scores >= self.least[:, None])
        self.new.append((item, scores[item, row], without[row], ids[row]))
        self.waiting += len(item)
        if self.waiting > GATHERED:
            self.compact()

    def compact(self) -> None:
        item, score, without, ids = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((ids, without, -score, item))
        item, score, without, ids = item[order], score[order], without[order], ids[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]][: len(item)])
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        last = place == self.most - 1
        self.least[item[last]] = score[last]
        self.kept = [x[place < self.most] for x in (item, score, without, ids)]
        self.new, self.waiting = [], 0


def _lengths(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """The m of each document: 50 + 50 n N div L."""
    if int(n.max(initial=0)) * 50 * documents < 1 << 62:
        return 50 + 50 * n * documents // words
    return np.array([50 + 50 * int(x) * documents // words for x in n], np.int64)


def _scores(counted: DataFrame, wave: list[dict], terms: list[str], weights: np.ndarray, documents: int, words: int, most: int) -> DataFrame:
    """(class, doc_id, score): the best ``most`` documents of each class of the wave in each partition."""
    number = {t: i for i, t in enumerate(terms)}
    blocks = []
    for row in wave:
        own = np.array([number[t] for t in row["terms"]], np.int64)
        order = np.argsort(own)
        parts = np.split(np.array(row["nodes"], np.int64), np.cumsum(row["sizes"])[:-1])
        blocks.append((np.array(row["classes"], np.int64), own[order], order, list(zip(row["first"], row["second"])), parts))
    sent = counted.sparkSession.sparkContext.broadcast((weights, blocks))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, blocks = sent.value
        best = [_Best(len(classes), most) for classes, *_ in blocks]
        for batch in batches:
            ids, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
            sizes = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.r_[0, np.cumsum(sizes)]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            without = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            m = _lengths(batch.column("n").to_numpy(zero_copy_only=False), documents, words)
            gains = weights[ids] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[doc]))
            for (classes, own, local, pairs, parts), top in zip(blocks, best, strict=True):
                together = max(1, CELLS // (len(own) + len(pairs)))
                for lo in range(0, len(sizes), together):
                    hi = min(lo + together, len(sizes))
                    some = slice(ends[lo], ends[hi])
                    at = np.minimum(np.searchsorted(own, ids[some]), len(own) - 1)
                    here = own[at] == ids[some]
                    if not here.any():
                        continue
                    sums = np.zeros((len(own) + len(pairs), hi - lo), np.int64)
                    sums[local[at[here]], doc[some][here] - lo] = gains[some][here]
                    for k, (a, b) in enumerate(pairs, len(own)):
                        np.add(sums[a], sums[b], out=sums[k])
                    top.add(np.stack([sums[p].sum(axis=0) for p in parts]), keys[lo:hi], without[lo:hi])
        for (classes, *_), top in zip(blocks, best, strict=True):
            top.compact()
            item, points, without, ids = top.kept
            columns = [pa.array(classes[item]), pa.array(ids, mask=without.astype(bool)), pa.array(points)]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "doc_id", "score"])

    return counted.where(F.size("ids") > 0).mapInArrow(score, "class long, doc_id long, score long")


def _waves(blocks: DataFrame) -> Iterator[list[int]]:
    """Numbers of blocks that travel together; the driver holds a number and a size for each block."""
    wave, size = [], 0
    for row in blocks.select("block", "bytes").orderBy("block").collect():
        if wave and size + row["bytes"] > WAVE_BYTES:
            yield wave
            wave, size = [], 0
        wave.append(row["block"])
        size += row["bytes"]
    if wave:
        yield wave


def ranked(docs: DataFrame, items: DataFrame, most: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` documents of highest positive score for each item, equal scores by ascending doc_id (long; null last).

    Terms are those of ``TERM`` with A-Z lower-cased; a null or empty text has none. With N documents that have a term, L terms in all, n in a
    document, df documents that hold a term and tf its occurrences in one, a document's score is the sum over the item's distinct terms of
    w * (10^9 tf div (1000 tf + 20 m)), where m = 50 + 50 n N div L and w = floor(1000 ln((2 N + 2) / (2 df + 1))). Every row of ``docs`` is a
    document of its own, also where ids or texts repeat. Items that share an id, or have none, are one item with the terms of all; items without
    terms have no result, nor has anything when there are no documents or items. Other columns are not looked at.
    """
    sets = settle(term_sets(items), "items")
    classes, blocks = graphs(sets)
    found = None
    for wave in _waves(blocks):
        rows = [r.asDict() for r in blocks.where(F.col("block").isin(wave)).collect()]
        terms = sorted({t for r in rows for t in r["terms"]})
        counted = settle(term_counts(docs, terms), "term-counts")
        total = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        weight = F.floor(1000 * F.log((2 * F.lit(float(total["docs"])) + 2) / (2 * F.col("df") + 1)))
        weights = np.zeros(len(terms), np.int64)
        for r in document_frequencies(counted).select("id", weight.alias("w")).collect():
            weights[r["id"]] = r["w"]
        scored = _scores(counted, rows, terms, weights, total["docs"], total["words"], most)
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "class long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("class", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= most)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(*order))).where(F.col("rank") <= most)
    return sets.select("item_id", "key").join(classes, "key").join(found, "class").select("item_id", "rank", "doc_id", "score")
