"""Shards by a Feistel permutation of global row numbers.

Rows get numbers 0 to n - 1 in the order of their keys. A keyed Feistel network permutes the cells of a rectangle of at least n
cells; a number that lands on a cell beyond n - 1 walks on along its cycle, so the numbers themselves are permuted. The
permuted number p gives shard p mod k and slot p div k: a row's place follows from its number alone, and :meth:`Permutation.back`
says which row is in a slot. The rectangle has sides a = ceil(sqrt(n)) and b = ceil(n / a), fewer than a cells too many, so walks are short.

Built-in functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevault.llm.common import settle, slots, without

#: Rounds of the network; each moves one side of the rectangle.
ROUNDS = 8
#: Steps of a walk in one expression; rows whose walk is longer, if there are any, walk on in a further one.
STEPS = 8
#: Round functions reckon modulo this prime, so products of two residues fit 64 bits.
PRIME = (1 << 31) - 1
#: Offsets of partitions that are sent to every task at most.
SENT_ROWS = 100_000
ADDED = ["row_number", "shard", "slot"]


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 .. rows - 1, chosen by the seed; at most about 4.6e18 rows."""

    rows: int
    seed: int = 17

    @property
    def sides(self) -> tuple[int, int]:
        a = math.isqrt(max(self.rows, 1) - 1) + 1
        return a, max(1, -(-self.rows // a))

    @property
    def outside(self) -> int:
        """Cells that are no row number; no walk is longer than this."""
        a, b = self.sides
        return a * b - self.rows

    @property
    def keys(self) -> list[tuple[int, int, int]]:
        """Of each round: its number, a factor and two summands, from a multiplicative generator."""
        x, drawn = self.seed % PRIME, []
        for _ in range(3 * ROUNDS):
            x = (48_271 * (x + 1) + 11) % PRIME
            drawn.append(x)
        return [(i, 1 + drawn[3 * i] % (PRIME - 1), drawn[3 * i + 1], drawn[3 * i + 2]) for i in range(ROUNDS)]

    def _network(self, x: Column, backwards: bool) -> Column:
        a, b = self.sides
        rounds = self.keys[::-1] if backwards else self.keys
        table = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("ifst", k)]) for k in rounds])

        def round_(cell: Column, key: Column) -> Column:
            even = key["i"] % 2 == 0  # even rounds move the left side by a function of the right one
            t = (F.when(even, cell["right"]).otherwise(cell["left"]) * key["f"] + key["s"]) % PRIME
            moved = (t * t + key["t"]) % PRIME
            by = F.when(even, moved % a).otherwise(moved % b)
            left, right = (cell["left"] - by + a, cell["right"] - by + b) if backwards else (cell["left"] + by, cell["right"] + by)
            return F.struct(F.when(even, left % a).otherwise(cell["left"]).alias("left"), F.when(even, cell["right"]).otherwise(right % b).alias("right"))

        start = F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("left"), (x % b).alias("right"))
        return F.aggregate(table, start, round_, lambda cell: cell["left"] * b + cell["right"])

    def walk(self, x: Column, backwards: bool = False) -> Column:
        """Up to STEPS passes through the network, until a row number comes out."""
        on = lambda y, _: F.when(y < self.rows, y).otherwise(self._network(y, backwards))
        return F.aggregate(F.sequence(F.lit(2), F.lit(STEPS)), self._network(x, backwards), on)

    def apply(self, frame: DataFrame, column: str, out: str, backwards: bool = False) -> DataFrame:
        """Add the permuted (or, backwards, the original) numbers of a column of row numbers."""
        frame = frame.withColumn(out, self.walk(F.col(column), backwards))
        while self.outside >= STEPS and not frame.where(F.col(out) >= self.rows).isEmpty():
            frame = frame.withColumn(out, F.when(F.col(out) < self.rows, F.col(out)).otherwise(self.walk(F.col(out), backwards)))
        return frame


def numbered(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """Add ``row_number``, the place of each row in the given order from 0, and return the number of rows too.

    Rows are range-partitioned and sorted, so that no task holds more than its range; rows that agree in all of ``order`` are divided
    by where they were read, so many equal rows fill many ranges. Partitions are fixed by writing them once; offsets
    are running sums over one number for each partition.
    """
    names = [f"_by{i}" for i in range(len(order))]
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *[c.alias(n) for c, n in zip(order, names)])
    keyed = keyed.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(n).asc_nulls_first() for n in [*names, "_tie"]]
    ranged = keyed.repartitionByRange(slots(rows.sparkSession), *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = settle(ranged.select("_row", F.spark_partition_id().alias("_part"), at.alias("_at")), "ranges")
    counts = fixed.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = settle(counts.select("_part", "n", before.alias("_before")), "offsets")
    found = offsets.agg(F.count("*").alias("parts"), F.sum("n").alias("n")).first()
    out = fixed.join(F.broadcast(offsets.drop("n")) if found["parts"] <= SENT_ROWS else offsets.drop("n"), "_part")
    return out.select("_row.*", (F.col("_before") + F.col("_at")).alias("row_number")), found["n"] or 0


def shard_rows(docs: DataFrame, shards: int, order: list[Column] | None = None, seed: int = 17) -> DataFrame:
    """Add ``row_number``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, without gaps in each shard) to each row.

    Row numbers follow ``order`` (doc_id, then crc32 and bytes of the text by default; nulls first). Shards differ by one row at most. The
    result depends on the rows and the seed alone: neither files, partitions nor reruns change it, but rows that agree in all
    of ``order`` may trade places among each other. Repeated rows count each time; an empty table gives no rows;
    columns named like an added one are replaced, all others are kept as they are.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    rows = without(docs, ADDED)
    if order is None:
        order = [F.col("doc_id"), text_crc(F.col("text")), F.octet_length("text")]
    placed, n = numbered(rows, order)
    placed = Permutation(n, seed).apply(placed, "row_number", "_p")
    shard, slot = (F.col("_p") % shards).cast("int"), F.call_function("div", F.col("_p"), F.lit(shards).cast("long"))
    return placed.select(*[f"`{c}`" for c in rows.columns], "row_number", shard.alias("shard"), slot.alias("slot"))


def row_at(slots_: DataFrame, rows: int, shards: int, seed: int = 17) -> DataFrame:
    """Add to each (shard, slot) the ``row_number`` that lies there."""
    asked = slots_.withColumn("_p", F.col("slot").cast("long") * shards + F.col("shard"))
    return Permutation(rows, seed).apply(asked, "_p", "row_number", backwards=True).drop("_p")


def text_crc(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes of a text; 0 for a null one."""
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long"))
