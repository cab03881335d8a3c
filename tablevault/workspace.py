"""Where a run may write: the shared folder the cluster names, never a node-local one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every node can reach.

    ``spark.checkpoint.dir`` (or the directory already set on the context) wins. Only a
    single-JVM ``local`` session may fall back to a temporary folder; on a cluster a missing
    setting is an error, because executors would write to disks nobody else can read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="tablevault-")
    raise ValueError("set spark.checkpoint.dir to a folder shared by all nodes")


def fresh_root(spark: SparkSession) -> str:
    """A new, unused vault root inside the shared folder."""
    return f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of the file system that owns it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a directory through the Hadoop file system that owns it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.delete(target, True)


def rename_path(spark: SparkSession, old: str, new: str) -> None:
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"cannot rename {old}")


def delete_units(units: DataFrame) -> int:
    """Remove the folders of a frame (``path``), dealt over the tasks; how many there were.

    A task opens the store that a path names. Paths of a store that tasks cannot open by themselves are handed back and removed through Hadoop
    by the driver, one after another."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for path in batch.column("path").to_pylist():
                try:
                    store, place = arrow_fs.FileSystem.from_uri(path)
                    store.delete_dir(place)
                except FileNotFoundError:
                    pass  # a repeated task
                except (OSError, ValueError, pa.ArrowException):
                    left.append(path)
            yield pa.RecordBatch.from_pydict({"path": left, "n": [0] * len(left)}, pa.schema([("path", pa.string()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_pydict({"path": [None], "n": [batch.num_rows]}, pa.schema([("path", pa.string()), ("n", pa.int64())]))

    spark, count = units.sparkSession, 0
    # a path without a scheme belongs to Hadoop's default store, which tasks must not take for their own disk
    default = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).toString().rstrip("/")
    full = F.when(F.col("path").startswith("/"), F.concat(F.lit("file://" if default.startswith("file:") else default), "path"))
    full = full.otherwise(F.regexp_replace("path", "^file:/+", "file:///"))
    dealt = units.select(full.alias("path")).repartition(F.xxhash64("path"))
    for row in dealt.mapInArrow(remove, "path string, n long").toLocalIterator():
        count += row["n"]
        if row["path"] is not None:
            delete_path(spark, row["path"])
    return count


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store, as listings give it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def _store_of(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is absent."""
    store, target = _store_of(spark, path)
    return [f.getPath().getName() for f in store.listStatus(target)] if store.exists(target) else []


def list_folders(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths two steps below a folder that match a pattern, relative to it. Folders without a finished write are left out."""
    store, target = _store_of(spark, root)
    found = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}/_SUCCESS"))
    return sorted("/".join(f.getPath().toString().split("/")[-3:-1]) for f in found) if found else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the catalog."""
    store, target = _store_of(spark, path)
    source = store.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if it is there. Of several writers one succeeds, on a store that creates files atomically."""
    store, target = _store_of(spark, path)
    full = store.makeQualified(target).toString()
    store.mkdirs(target.getParent())
    if full.startswith("file:"):  # Hadoop's local store looks first and creates then
        try:
            with open(full.removeprefix("file:"), "x", encoding="utf-8") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = store.create(target, False)
    except Exception:  # noqa: BLE001 - stores differ in what they raise
        if store.exists(target):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True
