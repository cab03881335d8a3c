"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablevault.workspace import shared_folder

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Spark's setting for removing the shuffle files of a finished execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a new table in the shared folder and read it back.

    Cuts the lineage with files that outlive an executor, and fixes the rows and their partitions. Shuffle files of the
    write are of no use to anyone after it, so Spark is told to remove them then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without columns that an operator is about to add (names compared without case)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes not to be a column of the frame (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which is how a cluster states the width of its jobs."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, A-Z lower-cased. ``bytes.split`` divides at exactly the six characters of ``WORD``."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


class WordHash(dict):
    """64-bit hash of a word; remembers words seen lately, ``limit`` of them at most."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, one row at least, so that memory stays even."""
    for batch in batches:
        at, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(batch.schema.names.index(column))).to_pylist()):
            size += n or 0
            if size >= most:
                yield batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)
