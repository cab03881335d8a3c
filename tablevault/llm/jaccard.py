"""N-gram Jaccard join by token-combination prefixes, down to the components of linked documents.

Texts with the same set of shingles form a class. Classes that are similar share a signature from their prefixes:

* Shingles are ordered by grade, then by hash. The grade grows with the number of classes that have a shingle; those that look alike
  (their smallest hashes are the same), as near copies do, count for less than those that share a passage or meet by chance.
  Beyond a bound of unlike classes a shingle is frequent.
* A class may miss ``n - ceil(threshold * n)`` of its n shingles, so a similar class has one of the first that many and one more.
  The smallest hashes of a class show these if enough of them are of grade 0; otherwise the class lists all its shingles.
* If they include frequent shingles, and two classes share none before those, their sets of frequent ones differ by no more shingles than the
  whole sets may. Hashes deal these sets into more parts than that, so that one part at least is the same in both: such parts are
  signatures too, as many as grow with the size of a class.

Candidate pairs are verified on whole texts. Rounds over a few signatures of each class merge most components first; the last round
takes every pair of classes that share a signature and lie in different components, so no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tablevault.llm.common import WordHash, settle, small_batches, words_of
from tablevault.llm.scoring import mixed

#: A shingle is frequent above so many unlike classes, if these are more than half of all that have it; and its grade then.
FREQUENT, FREQUENT_GRADE = 6, 99
#: So many classes that look alike count as one in a grade; the grade is a logarithm.
ALIKE = 4
#: Shingles of a bucket, about.
BUCKET_SHINGLES = 1_000_000
#: Rounds before the last one, and signatures of a class in each.
ROUNDS, TRIED = 1, 4
#: Classes that meet around one centre; shingles of the pairs that one cell verifies, about.
AROUND, CELL_SHINGLES = 64, 1_200_000
#: First signatures of a class by which most pairs are found once instead of once for each that they share.
TOP = 4
#: In place of the rank of a signature that is a part of frequent shingles.
UNRANKED = 1 << 40
#: Edges of a component search that one task reduces to a forest, about.
FOREST_EDGES = 250_000
QUARTERS = np.arange(4, dtype=np.uint64) << np.uint64(62)
#: Rows of a table that is sent to every task at most.
SENT_ROWS = 1_000_000


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` word hashes; fewer words count as one run."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    take = min(n, width)
    h = np.full(n - take + 1, take, np.uint64)
    for i in range(take):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - take + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(mixed(h))


def spare(n: int, percent: int) -> int:
    """How many of n shingles a similar set may lack."""
    return n - -(-percent * n // 100)


def head_size(n, percent: int):
    """How many of the smallest hashes of n shingles are listed first: some more than a prefix."""
    return 5 * (n - -(-percent * n // 100) + 1) // 4 + 16


def bands(most: int, percent: int) -> list[int]:
    """Least sizes of bands of set sizes up to one past that of ``most``: similar sets lie in one band or in neighbours."""
    starts = [1]
    while starts[-1] <= most or len(starts) < 3:
        starts.append(100 * starts[-1] // percent + 1)
    return [*starts, 100 * starts[-1] // percent + 1]


def part_signatures(shingles: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Signatures of a set of n, by its frequent shingles: two such sets that are similar and share no other shingle share one.

    Sets of a band meet those of the same band and, in a second dealing, those of the next one. Sets of a dealing differ by
    ``most`` shingles at most, so of ``most + 1 + empty`` parts ``empty + 1`` are the same. Only a set with more empty parts than that must
    show its empty ones too.
    """
    starts, out = bands(n, percent), []
    own = int(np.searchsorted(starts, n, "right")) - 1
    for band in (own, own + 1):
        most = 2 * (100 - percent) * (starts[band + 1] - 1) // (100 + percent)
        empty = most // 4 + 2
        parts = most + 1 + empty
        values = mixed(shingles + np.uint64(band + 1))
        part = (values % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        shown, first = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(values[order], first) if len(first) else np.zeros(0, np.uint64)
        if parts - len(shown) > empty:
            full = np.zeros(parts, np.uint64)
            full[shown] = sums
            shown, sums = np.arange(parts), full
        out.append(mixed(mixed(sums) + shown.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1)))
    return np.concatenate(out)


def _sets(texts: list[str | None], width: int, hashes: WordHash) -> Iterator[np.ndarray]:
    for text in texts:
        words = words_of(text)
        yield shingle_set(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), width)


def _class_of(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def _look(shingles: np.ndarray) -> int:
    least = np.append(shingles, np.uint64(0))[np.searchsorted(shingles, QUARTERS)]
    return int(least.astype("<u2").view("<i8")[0])


def _marks(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, h (hash of the text), c (class), n, look (16 bits of the smallest hash of each quarter of the range), head (the smallest hashes, some more than a prefix), whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in small_batches(batches, "text"):
            rows = []
            for s in _sets(batch.column("text").to_pylist(), width, hashes):
                need = head_size(len(s), percent)
                rows.append((_class_of(s), len(s), _look(s), s[:need].tobytes(), need >= len(s)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            columns = [batch.column("doc_id"), batch.column("h"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "c", "n", "look", "head", "whole"])

    return docs.mapInArrow(read, "doc_id long, h long, c long, n long, look long, head binary, whole boolean")


def _shared(lists: DataFrame, bits: int, percent: int) -> DataFrame:
    """(sig, c, n, held, pos, grade) for every listed shingle of (c, n, look, head) that two classes or more have; held is the length of
    the list, pos the place in it.

    Grades below the frequent one are told by the heads of classes where any has the shingle, so that they stay when more lists are whole."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, first = np.unique(batch.column("c").to_numpy(), return_index=True)  # copies send one list
            parts = [np.frombuffer(batch.column("head")[int(i)].as_py(), "<u8") for i in first]
            if parts:
                sizes = np.array([len(x) for x in parts])
                flat = np.concatenate(parts)
                bucket = (flat & np.uint64((1 << bits) - 1)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype("<u4")
                used, at = np.unique(bucket[order], return_index=True)
                bounds = list(zip(at, np.append(at[1:], len(flat)), strict=True))
                side = [batch.column(k).to_numpy()[first] for k in ("n", "look")]
                cells = [flat[order], *(np.repeat(v, sizes)[order] for v in (classes, side[0].astype("<i4"), sizes.astype("<i4"), side[1])), place[order]]
                columns = [pa.array(used)] + [pa.array([v[x:y].tobytes() for x, y in bounds], pa.binary()) for v in cells]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "tokens", "c", "n", "held", "look", "pos"])

    def meet(table: pa.Table) -> pa.Table:
        kinds = (("tokens", "<u8"), ("c", "<i8"), ("n", "<i4"), ("held", "<i4"), ("look", "<i8"), ("pos", "<u4"))
        token, c, n, held, look, pos = (np.concatenate([np.frombuffer(x.as_py(), k) for x in table.column(name)]) for name, k in kinds)
        order = np.argsort(token, kind="stable")
        token = token[order]
        again = np.zeros(len(token), bool)
        again[1:] = token[1:] == token[:-1]
        again[:-1] |= again[1:]
        token, order = token[again], order[again]
        order = order[np.lexsort((c[order], token))]
        token = np.sort(token)
        c, n, held, look, pos = c[order], n[order], held[order], look[order], pos[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
        token, c, n, held, look, pos = (v[new] for v in (token, c, n, held, look, pos))
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        members = np.diff(edge) if len(token) else np.zeros(0, np.int64)
        group, front = np.repeat(np.arange(len(members)), members), pos < head_size(n.astype(np.int64), percent)

        def unlike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Least and most different quarters of the looks of each group's rows."""
            found = [np.bincount(np.unique(group[rows] << 16 | (look[rows] >> (16 * q) & 0xFFFF)) >> 16, minlength=len(members)) for q in range(4)]
            return np.minimum.reduce(found), np.maximum.reduce(found)

        least, most = unlike(np.flatnonzero((members > 1)[group]))
        frequent = (most > FREQUENT) & (2 * most > members)
        fronts = np.bincount(group[front], minlength=len(members))
        if (fronts < members).any():
            among = np.where(fronts > 0, fronts, members)
            least = np.where(fronts > 0, unlike(np.flatnonzero(front))[0], least)
        else:
            among = members
        grade = np.log2(np.maximum(np.maximum(least, -(-among // ALIKE)), 1)).astype(np.int32)
        grade = np.where(frequent, FREQUENT_GRADE, grade)[group].astype(np.int32)
        keep = (members > 1)[group]
        columns = [token[keep].view("<i8"), c[keep], n[keep].astype(np.int64), held[keep].astype(np.int64), pos[keep].astype(np.int32), grade[keep]]
        return pa.table([pa.array(v) for v in columns], ["sig", "c", "n", "held", "pos", "grade"])

    dealt = lists.mapInArrow(deal, "bucket long, tokens binary, c binary, n binary, held binary, look binary, pos binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "sig long, c long, n long, held long, pos int, grade int")


def _postings(lists: DataFrame, bits: int, percent: int) -> DataFrame:
    """(sig, c, n, grade, rank): shared shingles of each class; rank counts the listed ones, shared or not, that come before it by grade and
    hash."""
    of = Window.partitionBy("c")
    worse = F.col("grade") > 0
    skipped = F.coalesce(F.sum(worse.cast("int")).over(of.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("held") - F.count("*").over(of) + F.row_number().over(of.orderBy("grade", "pos")) - 1
    return _shared(lists, bits, percent).select("sig", "c", "n", "grade", F.when(worse, last).otherwise(F.col("pos") - skipped).alias("rank"))


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (h, id, ...) with the text of that document."""
    few = wanted.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    texts = docs.withColumnRenamed("h", "_h")
    same = (F.col("_h") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))
    return texts.join(F.broadcast(wanted) if few else wanted, same).drop("_h", "doc_id")


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(c, n, look, head): every shingle of the wanted classes."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in small_batches(batches, "text"):
            rows = [(len(s), _look(s), s.tobytes()) for s in _sets(batch.column("text").to_pylist(), width, hashes)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("c"), *columns], ["c", "n", "look", "head"])

    return _fetch(docs, wanted).select("c", "text").dropDuplicates(["c"]).mapInArrow(whole, "c long, n long, look long, head binary")


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes that are similar, by their whole texts.

    Pairs that share their first signature ``sig`` meet in one cell, or in a square of cells if they are many, so that a text is
    read once for all its pairs there. ``load``, the shingles of a pair, bounds the cells.
    """
    sizes = pairs.groupBy("sig").agg(F.ceil(F.sqrt(F.sum("load") / CELL_SHINGLES)).cast("long").alias("k"))
    side = lambda c: F.pmod(F.xxhash64(c), F.greatest(F.col("k"), F.lit(1)))
    cells = pairs.join(sizes, "sig").select("sig", (side("a") * F.greatest(F.col("k"), F.lit(1)) + side("b")).alias("part"), "a", "b")
    cells = settle(cells, "cells")
    members = cells.select("sig", "part", F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = settle(members.join(classes.select("c", "h", "id"), "c"), "wanted")

    def compare(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        hashes, good = WordHash(), []
        sets = dict(zip(texts.column("c").to_pylist(), _sets(texts.column("text").to_pylist(), width, hashes), strict=True))
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                good.append((a, b))
        return pa.table([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], ["u", "v"])

    met = _fetch(docs, wanted).select("sig", "part", "c", "text")
    return met.groupBy("sig", "part").cogroup(cells.groupBy("sig", "part")).applyInArrow(compare, "u long, v long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that link the same nodes as the edges (u, v) of a task, in chunks: each node to the smallest of its component."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        names, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b, root = ends[: len(u)], ends[len(u) :], np.arange(len(names))
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (root != (up := root[root])).any():
                root = up
        inner = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[inner]), pa.array(names[root[inner]])], ["u", "v"])

    held, count = [], 0
    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in ("u", "v")])
        count += batch.num_rows
        if count >= FOREST_EDGES:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))
            held, count = [], 0
    if count:
        yield stars(*map(np.concatenate, zip(*held, strict=True)))


def components(edges: DataFrame) -> DataFrame:
    """(c, comp): the smallest node that each node of the edges (u, v) reaches, by alternating large and small stars.

    Bounded chunks of the edges are first reduced to forests, so that a dense group starts with few edges for each node."""
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    chunks = -(-edges.count() // FOREST_EDGES)
    edges = settle(edges.coalesce(max(chunks, 1)).mapInArrow(_forest, "u long, v long").distinct(), "forest")
    before = None
    while True:
        # Large star: larger neighbours of a node are linked to the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = settle(small.distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            return edges.select(F.col("u").alias("c"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("comp")).distinct())
        before = state


def _placed(posts: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Postings with the component of their class."""
    if comps is None:
        return posts.withColumn("comp", F.col("c"))
    return posts.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))


def _around_centres(placed: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs of classes of different components that share one of a few signatures, each with a centre of its signature."""
    few = Window.partitionBy("c").orderBy(F.xxhash64(F.lit(seed), "sig"), "sig")
    chosen = placed.withColumn("k", F.row_number().over(few)).where(F.col("k") <= TRIED).drop("k")
    sizes = chosen.groupBy("sig").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").drop("lo", "hi")
    spread = chosen.join(sizes, "sig").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "c"), F.ceil(F.col("size") / AROUND)).cast("long"))
    # A class with few shingles of lower grade before the signature has little of its own: most of a group are near it.
    own = F.struct(F.when(F.col("rank") < F.col("n"), F.col("rank") / F.col("n")), F.xxhash64(F.lit(seed + 1), "c"))
    lead = F.min_by(F.struct("c", "n", "comp"), own).alias("lead")
    leads = spread.groupBy("sig", "part").agg(lead)
    met = spread.join(leads, ["sig", "part"]).where("comp <> lead.comp")
    met = _sized(met, F.col("n"), F.col("lead.n"), percent)
    return _once(met.select(F.col("lead.c").alias("a"), F.col("c").alias("b"), "sig", (F.col("n") + F.col("lead.n")).alias("load")))


def _once(met: DataFrame) -> DataFrame:
    """Each pair once, a < b, with the least of its signatures."""
    pair = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sig", "load")
    return pair.groupBy("a", "b").agg(F.min("sig").alias("sig"), F.first("load").alias("load"))


def _sized(pairs: DataFrame, n: F.Column, m: F.Column, percent: int) -> DataFrame:
    return pairs.where(100 * F.least(n, m) >= percent * F.greatest(n, m))


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """Every pair of classes that share a signature and lie in different components.

    Rows of a signature's largest component meet the other rows only, never each other. Pairs whose first few signatures
    have one in common meet at the first of these; only the others meet at every signature that they share. What comes before the first
    common shingle is not in the other class, which bounds how similar the two can be.
    """
    counts = placed.groupBy("sig", "comp").agg(F.count("*").alias("k"))
    largest = counts.groupBy("sig").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    mixed_ = settle(placed.join(largest, "sig"), "mixed")
    minor = mixed_.where("comp <> largest").select("sig", F.col("c").alias("a"), F.col("n").alias("an"), F.col("comp").alias("acomp"), F.col("rank").alias("arank"), F.col("first").alias("afirst"), F.col("top").alias("atop"))
    apart = (F.col("comp") != F.col("acomp")) & ((F.col("comp") == F.col("largest")) | (F.col("a") < F.col("c")))
    apart = apart & (100 * F.least("n", "an") >= percent * F.greatest("n", "an"))
    common = F.least(F.col("n") - F.col("rank"), F.col("an") - F.col("arank"))
    apart = apart & ((F.col("rank") == UNRANKED) | ((100 + percent) * common >= percent * (F.col("n") + F.col("an"))))
    same = F.col("sig") == F.col("_sig")
    other = mixed_.withColumnRenamed("sig", "_sig")
    earliest = F.get(F.array_intersect("top", "atop"), F.lit(0)) == F.col("sig")
    early = minor.where("afirst").join(other.where("first"), same & apart & earliest)
    late = minor.join(other, same & apart & ~F.arrays_overlap("top", "atop"))
    wanted = ["a", F.col("c").alias("b"), "sig", (F.col("n") + F.col("an")).alias("load")]
    return _once(early.select(*wanted).unionByName(late.select(*wanted)))


def _parts(short: DataFrame, posts: DataFrame, percent: int) -> DataFrame:
    """(sig, c, n): signatures by frequent shingles of classes whose other shingles do not fill the prefix."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, n, sigs in zip(*(batch.column(k) for k in ("c", "n", "sigs")), strict=True):
                found = part_signatures(sigs.values.to_numpy().view(np.uint64), n.as_py(), percent).view(np.int64)
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.full(len(part), v.as_py(), np.int64)) for v in (c, n))], ["sig", "c", "n"])

    frequent = posts.where(F.col("grade") == FREQUENT_GRADE)
    lists = frequent.join(short.select("c"), "c", "left_semi").groupBy("c").agg(F.first("n").alias("n"), F.collect_set("sig").alias("sigs"))
    return lists.mapInArrow(deal, "sig long, c long, n long")


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Marks of all documents, and (c, comp, component): each class with its component and the least id in that."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    marks = settle(_marks(docs, width, percent), "marks")
    # One document stands for each class; copies meet within their partition before they move.
    chosen = F.min(F.struct("h", F.col("doc_id").alias("id"))).alias("chosen")
    rest = [F.first(k).alias(k) for k in ("n", "held", "whole")]
    able = marks.where(F.col("n") >= spare_from(percent)).withColumn("held", (F.length("head") / 8).cast("long"))
    classes = able.groupBy("c").agg(chosen, *rest).select("c", "chosen.h", "chosen.id", "n", "held", "whole")
    classes = settle(classes, "classes")
    listed = classes.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    bits = max(4, int(listed // BUCKET_SHINGLES).bit_length())
    need = F.expr(f"n - ceil({percent} * n / 100) + 1")
    lists, full = able.select("c", "n", "look", "head"), None
    while True:  # until every class either has enough shingles of grade 0 in its list or lists them all
        posts = settle(_postings(lists, bits, percent), "postings")
        worse = posts.where("grade > 0").groupBy("c").agg(F.count("*").alias("worse"), F.count(F.when(F.col("grade") == FREQUENT_GRADE, 1)).alias("often"))
        short = settle(classes.join(worse, "c").where(F.col("held") - F.col("worse") < need), "short")
        part = short.where("not whole")
        if part.isEmpty():
            break
        added = settle(_whole_sets(docs, part.select("c", "h", "id"), width), "whole")
        full = added if full is None else full.unionByName(added)
        done = full.select("c", F.lit(True).alias("all"))
        few = done.limit(SENT_ROWS + 1).count() <= SENT_ROWS
        sent = F.broadcast(done) if few else done
        lists = able.select("c", "n", "look", "head").join(sent, "c", "left_anti").unionByName(full)
        joined = classes.join(sent, "c", "left")
        joined = joined.withColumn("held", F.when(F.col("all"), F.col("n").cast("long")).otherwise(F.col("held"))).withColumn("whole", F.col("whole") | F.col("all").isNotNull())
        classes = settle(joined.drop("all"), "classes")
    rare = posts.where((F.col("grade") < FREQUENT_GRADE) & (F.col("rank") < need)).select("sig", "c", "n", "rank")
    short = short.where(F.col("held") - F.col("often") < need)
    posts = rare.unionByName(_parts(short, posts, percent).withColumn("rank", F.lit(UNRANKED)))
    sizes = posts.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1").select("sig")
    order = Window.partitionBy("c").orderBy("rank", "sig")
    posts = posts.join(sizes, "sig").withColumn("first", F.row_number().over(order) <= TOP)
    listed_first = F.array_sort(F.collect_list(F.when(F.col("first"), F.struct("rank", "sig"))).over(Window.partitionBy("c")))
    posts = posts.withColumn("top", F.transform(listed_first, lambda s: s["sig"]))
    posts = settle(posts, "signatures")

    comps, edges = None, None
    for turn in range(ROUNDS + 1):
        placed = _placed(posts, comps)
        pairs = settle(_around_centres(placed, turn, percent) if turn < ROUNDS else _across(placed, percent), "pairs")
        if pairs.isEmpty():
            continue
        found = _verify(docs, classes, pairs, width, percent)
        edges = found if edges is None else found.unionByName(comps.select(F.col("c").alias("u"), F.col("comp").alias("v")))
        comps = settle(components(edges), "components")
    labels = marks.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    labels = (labels.withColumn("comp", F.col("c")) if comps is None else labels.join(comps, "c", "left")).withColumn("comp", F.coalesce("comp", "c"))
    labels = settle(labels, "labels")
    names = labels.groupBy("comp").agg(F.min("least").alias("component"))
    return marks, settle(labels.join(names, "comp").select(F.col("c").alias("_c"), "comp", "component"), "names")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of (doc_id, text).

    A document's set holds the distinct runs of ``width`` words (A-Z lower-cased; fewer words are one run); it is empty
    without words, and then linked with nothing. Documents link when 100 * common >= percent * all of both. component_id is the
    smallest doc_id reached by links, its own included; null ids take part but name a component only if it has no other.
    Repeated rows stay and share a class; other columns are dropped; an empty table gives an empty one.
    """
    marks, labels = _linked(docs, width, percent)
    out = marks.select("doc_id", "n", "c").join(labels, F.col("c") == F.col("_c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def drop_linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one of each component: that with the least doc_id (null last), then hash of the text.

    Columns stay as they are; of repeated rows one stays, rows without words all stay.
    """
    marks, labels = _linked(docs, width, percent)
    rows = marks.where("c is not null").select("doc_id", "h", "c").join(labels, F.col("c") == F.col("_c"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    kept = rows.groupBy("comp").agg(first.alias("k")).select("comp", F.col("k.doc_id").alias("_id"), F.col("k.h").alias("_kept"))
    judged = rows.join(kept, "comp").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_kept")))
    judged = settle(judged.select("doc_id", "h", "stays"), "judged")
    gone = judged.where("not stays").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    few = gone.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_h"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    left = keyed.join(F.broadcast(gone) if few else gone, same, "left_anti")
    twice = judged.where("stays").groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    twice = settle(twice, "twice")
    if not twice.isEmpty():
        once = left.join(twice, same, "left_semi").dropDuplicates(["_doc", "_text"])
        left = left.join(twice, same, "left_anti").unionByName(once)
    return left.select("_row.*")


def spare_from(percent: int) -> int:
    """The least size of a set that can be similar to another one: a set of one more shingle, at best."""
    return next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1)) if percent < 100 else math.inf
