"""Checksums of stored files and the check of a backup against its manifest."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tablevault.functions.fingerprint import DIGEST
from tablevault.workspace import path_exists

FILE = "_tv_file"
#: A part file is read as one value when it is hashed, so larger ones are written again in pieces.
PART_BYTES = 128 << 20
#: Hex digits that group the leaves of a Merkle tree.
NODE_DIGITS = 3


def _table_of(path_column: str, folder: str):
    """Table name of a file: the first path step below the backup folder."""
    tail = F.substring_index(F.col(path_column), f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return F.substring_index(tail, "/", 1)


def _binary(spark: SparkSession, folder: str):
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
    )


def list_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``table_name, path, length`` of the part files of a backup; contents are not read. A folder
    that is gone holds no files."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], "table_name string, path string, length bigint")
    return _binary(spark, folder).load(folder).select(
        _table_of("path", folder).alias("table_name"), "path", "length"
    )


def hashed_parts(spark: SparkSession, folder: str, tolerant: bool = False) -> DataFrame:
    """``table_name, path, length, sha256`` of the bytes of each part file, hashed where the tasks read them. A tolerant reader gives no
    hash for a file that cannot be read to its end."""
    if not path_exists(spark, folder):
        return list_parts(spark, folder).withColumn("sha256", F.lit(None).cast("string"))
    listed = list_parts(spark, folder)
    reader = _binary(spark, folder)
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    read = reader.load(folder).select("path", F.sha2("content", 256).alias("sha256"))
    if tolerant:
        return listed.join(read, "path", "left").select("table_name", "path", "length", "sha256")
    return reader.load(folder).select(_table_of("path", folder).alias("table_name"), "path", "length", F.sha2("content", 256).alias("sha256"))


def hashed_chunks(spark: SparkSession, table: str, folders: list[str]) -> DataFrame:
    """The same for the files of some folders of one table; a file that cannot be read has no hash."""
    if not folders:
        return spark.createDataFrame([], "table_name string, path string, length bigint, sha256 string")
    listed = _binary(spark, "").load(folders).select(F.lit(table).alias("table_name"), "path", "length")
    reader = _binary(spark, "").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    read = reader.load(folders).select("path", F.sha2("content", 256).alias("sha256"))
    return listed.join(read, "path", "left").select("table_name", "path", "length", "sha256")


def file_name(path: str) -> Column:
    """Name of a part file, with its chunk if it has one, which is unique within its table."""
    return F.regexp_extract(F.col(path), "((?:chunk=[^/]+/)?[^/]+)$", 1)


def with_rows(hashed: DataFrame, found: DataFrame) -> DataFrame:
    """Hashed files with the number of their rows; a file without rows has none in ``found``."""
    f = found.select(F.col("table_name").alias("f_table"), file_name(FILE).alias("f_name"), F.col("row_count").alias("f_rows"))
    joined = hashed.join(f, (F.col("table_name") == F.col("f_table")) & (file_name("path") == F.col("f_name")), "left")
    return joined.select("table_name", "path", "length", F.coalesce("f_rows", F.lit(0)).cast("bigint").alias("row_count"), "sha256")


def file_totals(files: DataFrame) -> DataFrame:
    """Files, bytes and the ``root`` of a Merkle tree over the files per table.

    A leaf is the hash of ``table/file:length:sha256``; leaves with the same first digits, in order, make a node, and the nodes in order the
    root. So no group grows with the number of files alone, and the order in which files are met does not matter."""
    label = F.concat(F.col("table_name"), F.lit("/"), file_name("path"), F.lit(":"), F.col("length").cast("string"), F.lit(":"), F.coalesce("sha256", F.lit("")))
    leaves = files.select("table_name", "length", F.sha2(label, 256).alias("leaf"))
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    nodes = leaves.groupBy("table_name", F.substring("leaf", 1, NODE_DIGITS).alias("at")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), joined("leaf").alias("node")
    )
    return nodes.groupBy("table_name").agg(
        F.sum("files").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"), joined(F.concat("at", "node")).alias("root")
    )


def overall_checksum(totals: list[Row]) -> str:
    """Root over the roots of all tables of a backup (one row per table)."""
    return hashlib.sha256("".join(sorted(f"{r['table_name']}:{r['files']}:{r['root']};" for r in totals)).encode()).hexdigest()


def compare_files(recorded: DataFrame, stored: DataFrame) -> DataFrame:
    """Status per file: ``ok``, ``missing``, ``extra``, ``changed`` or ``corrupt``.

    ``recorded`` comes from the catalog, ``stored`` from listing the storage and hashing the bytes of each file again; a file
    that could not be read is corrupt. Files recorded before bytes were hashed are compared by length."""
    r = recorded.select("table_name", *[F.col(c).alias(f"r_{c}") for c in ("path", "length", "sha256")])
    s = stored.select(F.col("table_name").alias("s_table"), *[F.col(c).alias(f"s_{c}") for c in ("path", "length", "sha256")])
    both = r.join(s, (F.col("table_name") == F.col("s_table")) & (file_name("r_path") == file_name("s_path")), "full_outer")
    status = (
        F.when(F.col("s_table").isNull(), "missing")
        .when(F.col("table_name").isNull(), "extra")
        .when(F.col("s_sha256").isNull(), "corrupt")
        .when((F.col("r_length") != F.col("s_length")) | (F.col("r_sha256") != F.col("s_sha256")), "changed")
        .otherwise("ok")
    )
    return both.select(
        F.coalesce("table_name", "s_table").alias("table_name"), F.coalesce("s_path", "r_path").alias("path"), status.alias("status")
    )


def compare_digests(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded against recomputed content per table. ``found`` has ``table_name, row_count,
    digest1, digest2``; a table that could not be read is absent from it."""
    f = found.select(
        "table_name",
        F.col("row_count").alias("found_rows"),
        F.col("digest1").cast(DIGEST).alias("f1"),
        F.col("digest2").cast(DIGEST).alias("f2"),
    )
    same = (F.col("row_count") == F.col("found_rows")) & (F.col("digest1") == F.col("f1")) & (F.col("digest2") == F.col("f2"))
    return manifest.join(f, "table_name", "left").select(
        "table_name",
        F.col("row_count").alias("recorded_rows"),
        "found_rows",
        F.coalesce(same, F.lit(False)).alias("content_ok"),
    )
