"""Storage of the catalog: entries that are only added, and snapshots that take them in.

``<base>/<name>/month=YYYY-MM/entry=<owner>-<id>/`` holds one entry each, ``snapshots/<id>`` all entries up to some time as one table, and
``pointers/<n>`` names the snapshot of generation n and the entries it holds. The newest pointer counts. It is set by creating its file,
which succeeds for one writer only; a compactor that comes second starts again from the new state. Readers take the snapshot and
the entries that it lacks, so they see every entry once, whether it was taken in meanwhile or not. Entries and snapshots are
removed one generation after they were replaced: a reader may still be at the one before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablevault.workspace import create_exclusively, delete_path, list_folders, list_names, read_text

#: Entries beyond the snapshot that a run leaves before the catalog is compacted.
TAIL = 64
#: Rows of a snapshot's file.
FILE_ROWS = 1_000_000


class CatalogStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def append(self, name: str, rows: DataFrame, month: str, owner: str) -> str:
        """A new entry, named after the backup it belongs to so that it is found without reading others."""
        path = f"{self.base}/{name}/month={month}/entry={owner}-{uuid.uuid4().hex}"
        # an entry is there once its write is marked as finished
        rows.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
        return path

    def _pointer(self, name: str) -> tuple[int, dict]:
        """Generation and content of the newest pointer; generation 0 has no snapshot."""
        found = [int(n) for n in list_names(self.spark, f"{self.base}/{name}/pointers") if n.isdigit()]
        if not found:
            return 0, {"snapshot": None, "entries": [], "removed": []}
        return max(found), json.loads(read_text(self.spark, f"{self.base}/{name}/pointers/{max(found)}"))

    def _tail(self, name: str, pointer: dict, owner: str = "*") -> list[str]:
        """Entries (``month=.../entry=...``) that the snapshot lacks."""
        taken = {*pointer["entries"], *pointer["removed"]}
        return [e for e in list_folders(self.spark, f"{self.base}/{name}", f"month=*/entry={owner}") if e not in taken]

    def tail(self, name: str) -> int:
        return len(self._tail(name, self._pointer(name)[1]))

    def read(self, name: str, schema: T.StructType, since_month: str | None = None, owners: list[str] | None = None, key: str | None = None) -> DataFrame:
        """A catalog table, with the month of each row. ``owners`` reads the entries of some backups and of vault-wide runs only, and the rows of
        the snapshot whose ``key`` is one of them."""
        pointer = self._pointer(name)[1]
        pattern = "*" if owners is None else "{" + ",".join(f"{o}-*" for o in [*owners, "expire", "sweep"]) + "}"
        full = T.StructType(schema.fields + [T.StructField("month", T.StringType())])
        tail = self._tail(name, pointer, pattern)
        parts = []
        if tail:
            root = f"{self.base}/{name}"
            parts.append(self._entries(name, full, tail))
        if pointer["snapshot"]:
            taken = self.spark.read.schema(full).parquet(f"{self.base}/{name}/snapshots/{pointer['snapshot']}")
            parts.append(taken if owners is None else taken.where(F.col(key).isin(owners)))
        if not parts:
            return self.spark.createDataFrame([], full)
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return found.where(F.col("month") >= since_month) if since_month else found

    def _entries(self, name: str, schema: T.StructType, entries: list[str]) -> DataFrame:
        root = f"{self.base}/{name}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{e}" for e in entries]).select(*schema.fieldNames())

    def compact(self, name: str, schema: T.StructType, order: str, tries: int = 5) -> bool:
        """Take all entries into a new snapshot, sorted so that a lookup by ``order`` skips most of it. False when others were faster each time."""
        root = f"{self.base}/{name}"
        for _ in range(tries):
            generation, pointer = self._pointer(name)
            tail = self._tail(name, pointer)
            if not tail:
                return True
            full = T.StructType(schema.fields + [T.StructField("month", T.StringType())])
            rows = self._entries(name, full, tail)
            if pointer["snapshot"]:
                rows = rows.unionByName(self.spark.read.schema(full).parquet(f"{root}/snapshots/{pointer['snapshot']}"))
            new = uuid.uuid4().hex
            rows.orderBy(order).write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{root}/snapshots/{new}")
            # entries of the generation before were left for its readers; they go now, and with them the snapshot before that one
            there = set(list_folders(self.spark, root, "month=*/entry=*"))
            removed = [e for e in [*pointer["entries"], *pointer["removed"]] if e in there]
            text = json.dumps({"snapshot": new, "entries": tail, "removed": removed, "former": pointer["snapshot"]})
            if not create_exclusively(self.spark, f"{root}/pointers/{generation + 1}", text):
                delete_path(self.spark, f"{root}/snapshots/{new}")
                continue
            for entry in removed:
                delete_path(self.spark, f"{root}/{entry}")
            if pointer.get("former"):
                delete_path(self.spark, f"{root}/snapshots/{pointer['former']}")
            if generation > 1:
                delete_path(self.spark, f"{root}/pointers/{generation - 1}")
            return True
        return False
