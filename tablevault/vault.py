"""A vault: one root folder with the data of all backups and the catalog that describes them.

Layout: ``data/<backup_id>/<table>/part-*.parquet``, ``catalog/<name>/month=YYYY-MM/entry=<id>/``,
``index/<backup_id>/<table>`` for the indexes that deltas compare with, and ``work/<backup_id>/<table>`` for what a run leaves to no one. Every write goes to a
folder of its own, so concurrent runs never share an output directory. A backup counts only once
its ``success`` event is in the catalog; that append comes after data, sizes and checksum.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F, types as T

from tablevault.catalog_store import TAIL, CatalogStore
from tablevault.functions.fingerprint import FINGERPRINT, LEN, digest_columns, lane_sum, with_fingerprint
from tablevault.functions.scalars import DB_TYPES, SIZE_UNITS, redact_secrets
from tablevault.model import (
    BACKUP_LOGS, BACKUP_VERSION, CHUNKS, CONDEMNED, DEFAULT_RETENTION_DAYS, FILES, INDEXES, JOB_EVENTS, MANIFEST, BackupRequest, BackupResult, safe_name,
)
from tablevault.operators import catalog, chunks, delta, integrity, late, retention, state_index
from tablevault.operators import forecast as forecasts
from tablevault.operators.restore import apply_keyed, apply_multiset, keyed_prints, multiset_prints
from tablevault.operators.selection import select_names
from tablevault.plans import chains
from tablevault.workspace import delete_path, delete_units, path_exists, qualified, rename_path

# Ways a table is stored in one backup.
FULL, CHUNKED, KEYED, MULTISET, APPEND, LATE = "full", "chunked", "keyed", "multiset", "append", "late"
_SCHEMAS = {"job_events": JOB_EVENTS, "backup_logs": BACKUP_LOGS, "manifest": MANIFEST, "files": FILES, "indexes": INDEXES, "chunks": CHUNKS, "condemned": CONDEMNED}


class SourceChanged(RuntimeError):
    """The source gave different rows in the two passes of a delta."""


class DigestMismatch(RuntimeError):
    """Restored rows differ from what the backup recorded."""


@dataclass
class _Parent:
    """The state a delta is measured against: its rows, the manifest row describing it and the stored
    steps that lead to it."""

    manifest: Row
    state: DataFrame
    steps: list[tuple[Row, str]]

    @property
    def index(self) -> dict | None:
        text = self.manifest["index_json"]
        return json.loads(text) if text else None


def _void_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NullType)]


def _same_columns(a: T.StructType, b: T.StructType) -> bool:
    # what may be null is not part of it: files do not keep that
    return [(f.name, f.dataType.simpleString()) for f in a.fields] == [(f.name, f.dataType.simpleString()) for f in b.fields]


def payload_digest(mode: str) -> list[Column]:
    """Aggregates over a fingerprinted payload. Weights make the digest depend on what a delta
    row says, not only on its columns: a deleted key counts -1, a multiset row by its copies."""
    weight = None
    if mode == KEYED:
        weight = F.when(F.col(delta.OP) == "U", 1).otherwise(-1)
    elif mode in (MULTISET, LATE):
        weight = delta.multiset_weight()
    metrics = [
        F.count(F.lit(1)).alias("row_count"),
        *[lane_sum(h, weight).alias(n) for h, n in zip(FINGERPRINT, ("digest1", "digest2"))],
        F.coalesce(F.sum(LEN), F.lit(0)).cast("bigint").alias("raw_size"),
    ]
    if mode == KEYED:
        up = F.col(delta.OP) == "U"
        metrics += [lane_sum(F.when(up, F.col(h))).alias(n) for h, n in zip(FINGERPRINT, ("up1", "up2"))]
        metrics.append(F.count(F.when(up, 1)).alias("up_rows"))
    if mode == LATE:  # rows past the mark, which have no copies before
        new = F.col(delta.BEFORE) < 0
        metrics += [lane_sum(F.when(new, F.col(h))).alias(n) for h, n in zip(FINGERPRINT, ("up1", "up2"))]
        metrics.append(F.count(F.when(new, 1)).alias("up_rows"))
    return metrics


def _size_limit(text: str) -> int:
    """Driver-side reading of one size option, the same rule as the column version."""
    digits = text.strip().lower().removesuffix("b")
    unit = digits[-1] if digits[-1:] in SIZE_UNITS[1:] else ""
    return int(digits.removesuffix(unit)) * 1024 ** SIZE_UNITS.index(unit)


class Vault:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- catalog storage ------------------------------------------------------------------

    @property
    def store(self) -> CatalogStore:
        return CatalogStore(self.spark, f"{self.root}/catalog")

    def _append(self, name: str, rows: DataFrame, at: datetime, owner: str) -> str:
        return self.store.append(name, rows, f"{at:%Y-%m}", owner)

    def _append_rows(self, name: str, at: datetime, rows: list[dict], owner: str) -> None:
        """Append rows the driver holds: one per run, or one per table of a run."""
        plain = lambda v: v.isoformat() if isinstance(v, datetime) else int(v)
        text = json.dumps([{k: v for k, v in r.items() if v is not None} for r in rows], default=plain)
        parsed = F.from_json(F.lit(text), T.ArrayType(_SCHEMAS[name]))
        self._append(name, self.spark.range(0, 1, 1, 1).select(F.inline(parsed)), at, owner)

    def _append_row(self, name: str, at: datetime, **values) -> None:
        self._append_rows(name, at, [values], values.get("backup_job_id") or values["id"])

    def _read(self, name: str, since_month: str | None = None, owner: str | None = None) -> DataFrame:
        """A catalog table; ``since_month`` (``YYYY-MM``) leaves out older months, ``owner`` (ids, joined by commas) reads the entries of
        some backups, and those of expiry runs, only."""
        key = "backup_job_id" if name == "backup_logs" else "id" if name == "job_events" else "path" if name == "condemned" else "backup_id"
        found = self.store.read(name, _SCHEMAS[name], since_month, owner.split(",") if owner else None, key)
        return found.select(*[f.name for f in _SCHEMAS[name].fields])

    def compact(self, tail: int = 0) -> None:
        """Take the catalog's entries into snapshots, where there are more than ``tail``; runs do so by themselves now and then."""
        for name, schema in _SCHEMAS.items():
            if self.store.tail(name) > tail:
                self.store.compact(name, schema, "backup_job_id" if name == "backup_logs" else schema.fieldNames()[0])

    def job_events(self, since_month: str | None = None) -> DataFrame:
        return self._read("job_events", since_month)

    def jobs(self, since_month: str | None = None) -> DataFrame:
        return catalog.current_jobs(self.job_events(since_month))

    def logs(self, since_month: str | None = None) -> DataFrame:
        return self._read("backup_logs", since_month)

    def manifest(self, backup_id: str | None = None) -> DataFrame:
        found = self._read("manifest", owner=backup_id)
        return found.where(F.col("backup_id") == backup_id) if backup_id else found

    def files(self, backup_id: str | None = None) -> DataFrame:
        found = self._read("files", owner=backup_id)
        return found.where(F.col("backup_id") == backup_id) if backup_id else found

    def list_backups(self, **options) -> DataFrame:
        return catalog.list_view(self.jobs(), **options)

    def recent_backups(self, db_name: str) -> DataFrame:
        return catalog.recent_backups(self.jobs(), db_name)

    def status(self, backup_id: str) -> DataFrame:
        """The job with its logs, or no row for an unknown id."""
        events = self._read("job_events", owner=backup_id).where(F.col("id") == backup_id)
        return catalog.job_with_logs(catalog.current_jobs(events), self._read("backup_logs", owner=backup_id), backup_id)

    def data_path(self, backup_id: str, output: str | None = None) -> str:
        return f"{(output or self.root + '/data').rstrip('/')}/{backup_id}"

    # --- backup ---------------------------------------------------------------------------

    def backup(self, tables: dict[str, DataFrame], request: BackupRequest | None = None, at: datetime | None = None) -> BackupResult:
        """Back up the selected tables and record the run.

        Never raises for a failing run: the job becomes ``failed`` with an error log, and the
        result says so.
        """
        request = request or BackupRequest()
        at = (at or datetime.now(timezone.utc)).astimezone(timezone.utc)
        clock = time.monotonic()
        db = request.db_name or "unknown"
        stamp = at.strftime("%Y-%m-%dT%H-%M-%S-") + f"{at.microsecond // 1000:03d}Z"
        backup_id = safe_name(f"{db}_{int(at.timestamp() * 1000)}_{uuid.uuid4().hex[:8]}")
        name = request.name or safe_name(f"{db}_{stamp}")
        seconds = lambda: round(time.monotonic() - clock, 3)
        folder = self.data_path(backup_id, request.output)
        try:
            metadata = {"tables": request.tables, "excludeTables": request.exclude_tables, "host": request.host}
            self._append_row(
                "job_events", at, id=backup_id, seq=0, db_type=DB_TYPES.get(request.db_type.lower(), request.db_type), db_name=db, status="running",
                backup_type=request.backup_type, retry_count=0, started_at=at,
                metadata=json.dumps({k: v for k, v in metadata.items() if v is not None}),
            )
            chosen = select_names(list(tables), request.tables, request.exclude_tables)
            parents, chain, backup_type = self._parents(db, request, at)
            if request.max_size and backup_type == "full" and not request.dedup:
                self._forecast(tables, chosen, request, backup_id)
            with ThreadPoolExecutor(min(request.parallel, max(len(chosen), 1))) as pool:
                rows = list(
                    pool.map(
                        lambda t: self._store(safe_name(t), tables[t], request, backup_id, folder, parents.get(t)),
                        chosen,
                    )
                )
            totals, checksum = self._measure(backup_id, folder, rows, at, request.effective_codec) if chosen else ({}, None)
            self._write_manifest(backup_id, rows, totals, at)
            size = sum(b for _, b in totals.values())
            raw = sum(r["raw_size"] for r in rows)
            if request.max_size and size > _size_limit(request.max_size):
                if not request.dedup:  # others may have found its chunks already: a sweep takes them
                    delete_path(self.spark, folder)
                raise ValueError(f"backup holds {size} bytes, more than {request.max_size}")
            done = dict(
                file_path=folder, file_name=name, file_size=size, raw_size=raw, checksum=checksum,
                compressed_size=size if request.effective_codec != "none" else None,
            )
            self._log(backup_id, at, "info", "Backup completed successfully", {"duration": seconds(), "fileSize": size})
            full_id = chain[0]["id"] if chain else backup_id
            head_id = (chain[-1]["head_id"] or full_id) if backup_type == "incremental" else backup_id
            # The last step: nothing that can fail follows the event that makes the backup count.
            self._append_row(
                "job_events", at, id=backup_id, seq=1, status="success", backup_type=backup_type,
                parent_id=chain[-1]["id"] if chain else None, full_id=full_id, head_id=head_id, compression_type=request.effective_codec, backup_version=BACKUP_VERSION, duration=seconds(),
                completed_at=datetime.now(timezone.utc), **done,
            )
            self._tidy()
            return BackupResult(
                True, backup_id, seconds(), folder, size, done["compressed_size"], raw, checksum,
            )
        except Exception as error:  # noqa: BLE001 - every failure of a run is recorded
            message = redact_secrets(str(error))
            delete_path(self.spark, f"{self.root}/index/{backup_id}")
            self._append_row(
                "job_events", at, id=backup_id, seq=1, status="failed", error=message, duration=seconds(), file_path=folder,
                completed_at=datetime.now(timezone.utc),
            )
            self._log(backup_id, at, "error", "Backup failed", {"error": message})
            return BackupResult(False, backup_id, seconds(), error=message)
        finally:
            if request.backup_type != "full":
                delete_path(self.spark, f"{self.root}/work/{backup_id}")

    def _forecast(self, tables: dict[str, DataFrame], chosen: list[str], request: BackupRequest, backup_id: str) -> None:
        """Fail before anything is written when the backup will surely be too large; what is near the limit is measured afterwards."""
        most, least = _size_limit(request.max_size), 0
        for t in chosen:
            found = self.forecast(tables[t], request.effective_codec, f"{self.root}/work/{backup_id}-forecast/{safe_name(t)}")
            least += found.least
            if least > most:
                raise ValueError(f"backup would hold more than {request.max_size}: at least {least} bytes up to table {t}")

    def forecast(self, df: DataFrame, codec: str = "gzip", folder: str | None = None) -> forecasts.Forecast:
        """Expected size of a table in a full backup, with a bound of its error."""
        stored = df.select(*[f"`{c}`" for c in df.columns if c not in _void_columns(df.schema)])
        return forecasts.forecast(stored, codec, folder or f"{self.root}/work/forecast-{uuid.uuid4().hex}")

    def _tidy(self) -> None:
        """Compact the catalog when many entries have come. The backup counts already, so a failure here is left to the next run."""
        try:
            self.compact(TAIL)
        except Exception as error:  # noqa: BLE001
            warnings.warn(f"catalog not compacted: {redact_secrets(str(error))}", stacklevel=2)

    def _log(self, backup_id: str, at: datetime, level: str, message: str, details: dict) -> None:
        self._append_row(
            "backup_logs", at, id=self._log_id(backup_id, level), backup_job_id=backup_id, timestamp=datetime.now(timezone.utc),
            level=level, message=message, details=json.dumps(details),
        )

    @staticmethod
    def _log_id(backup_id: str, level: str) -> int:
        """From the run's own id and the place of the line in the run: runs at one time have different ids, and no clock is asked twice."""
        return int(hashlib.sha256(backup_id.encode()).hexdigest()[:15], 16) // 2 * 2 + (level == "error")

    def _parents(self, db: str, request: BackupRequest, at: datetime) -> tuple[dict[str, _Parent], list[Row], str]:
        """Per table, the state a delta starts from, and the members of its chain. Without an earlier full the run is a full."""
        if request.backup_type == "full":
            return {}, [], "full"
        kind = "full" if request.backup_type == "differential" else None
        members = self._chain_of(chains.last_backup(self.jobs(), db, F.lit(at), kind))
        if not members:
            return {}, [], "full"
        steps = self._steps(members)
        return {t: _Parent(s[-1][0], self._rebuild(s), s) for t, s in steps.items()}, members, request.backup_type

    def _store(self, table: str, df: DataFrame, request: BackupRequest, backup_id: str, folder: str, parent: _Parent | None) -> dict:
        """Write one table, full or as a delta, and return what the manifest says about it."""
        keys = request.keys.get(table)
        grows = request.high_water.get(table)
        path = f"{folder}/{table}"
        same = parent is not None and _same_columns(parent.state.schema, df.schema)
        info = dict(
            table_name=table, schema_json=df.schema.json(), key_columns=keys, high_water_column=grows,
            high_water=None, null_marks=None, upserts=None, deletes=0, touched=0, index_json=None,
        )
        # a delta needs the parent to have been stored under the same key or the same mark
        if same and grows:
            same = parent.manifest["high_water_column"] == grows
            if request.late_rows:
                same = same and parent.manifest["high_water"] is not None and parent.index is not None and "width" in parent.index
            else:
                same = same and self._mark_tells(df, grows, parent.manifest)
        elif same and keys:
            same = parent.manifest["key_columns"] == keys
        if not same:
            if keys:
                index, known = self._key_index(df, keys, backup_id, table)
            mode = CHUNKED if request.dedup else FULL
            if request.dedup:
                seen = self._write_chunks(df, table, path, backup_id, request, grows)
            else:
                seen = self._write(df, df.columns, FULL, path, request, grows)
            if keys:
                if (seen["row_count"], seen["digest1"], seen["digest2"]) != known:
                    raise SourceChanged(f"{table} changed while it was read")
                info["index_json"] = json.dumps(index)
            info.update(op_mode=mode, upserts=seen["row_count"], high_water=seen.pop("high_water", None), null_marks=seen.pop("null_marks", None))
            state = (seen["row_count"], seen["digest1"], seen["digest2"])
            if grows and request.late_rows:
                info["index_json"] = json.dumps(self._sketched(df, grows, state, backup_id, table))
        elif grows and request.late_rows:
            state = self._store_late(df, parent, grows, path, request, backup_id, table, info)
            seen = info.pop("seen")
        elif grows:
            mark = parent.manifest["high_water"]
            seen = self._write(delta.after_high_water(df, grows, mark), df.columns, APPEND, path, request, grows)
            info.update(op_mode=APPEND, upserts=seen["row_count"], high_water=seen.pop("high_water", None) or mark, null_marks=parent.manifest["null_marks"])
            state = self._moved(parent, seen["row_count"], seen["digest1"], seen["digest2"])
        elif keys:
            changes, found = self._keyed_changes(df, parent, keys, backup_id, table)
            if found["faults"]:
                raise ValueError(f"{table}: {keys} is repeated or null, not a key")
            payload = delta.keyed_payload(df, changes, keys, found["upserts"])
            seen = self._write(payload, df.columns, KEYED, path, request)
            if (seen["up_rows"], seen["up1"], seen["up2"]) != (found["upserts"], found["up1"], found["up2"]):
                raise SourceChanged(f"{table} changed while it was read")
            info.update(op_mode=KEYED, upserts=found["upserts"], deletes=found["deletes"], touched=found["touched"])
            info["index_json"] = self._next_index(parent.index, df, keys, found["upserts"] + found["deletes"], backup_id, table)
            state = self._moved(parent, found["rows"], int(found["up1"]) - int(found["out1"]), int(found["up2"]) - int(found["out2"]))
        else:
            index = parent.index or self._range_index(parent, table)
            changes, found, total = self._multiset_changes(df, index, backup_id, table)
            payload = delta.multiset_payload(df, self._stored_rows(parent.steps), changes, found["present"], found["gone"])
            seen = self._write(payload, df.columns, MULTISET, path, request)
            state = self._moved(parent, found["upserts"] - found["deletes"], found["net1"], found["net2"])
            if (seen["digest1"], seen["digest2"]) != (found["digest1"], found["digest2"]) or state != total:
                raise SourceChanged(f"{table} changed while it was read")
            info["index_json"] = self._next_index(index, df, None, found["present"] + found["gone"], backup_id, table)
            info.update(op_mode=MULTISET, upserts=found["upserts"], deletes=found["deletes"], touched=found["touched"])
        info.update({k: seen[k] for k in ("row_count", "digest1", "digest2", "raw_size")})
        info.update(zip(("state_rows", "state_digest1", "state_digest2"), state))
        return info

    # --- late rows behind a mark -------------------------------------------------------------

    def _sketch_part(self, sketch: DataFrame, backup_id: str, table: str) -> tuple[str, tuple[int, int, int]]:
        """Store a sketch; its path, and count and digest of the rows in it."""
        path = self._index_path(backup_id, table, "late")
        sketch.write.parquet(f"{self.root}/{path}")
        total = late.digests_of(late.read_sketch(self.spark, [f"{self.root}/{path}"])).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("row_count", "digest1", "digest2")])
        return path, tuple(int(v) for v in total.first())

    def _sketched(self, df: DataFrame, grows: str, state: tuple, backup_id: str, table: str) -> dict:
        """The sketch of a whole table."""
        width = late.bucket_width(df, grows)
        path, found = self._sketch_part(late.cells(late.prints(df, grows, width)), backup_id, table)
        if found != tuple(int(v) for v in state):
            raise SourceChanged(f"{table} changed while it was read")
        return {"width": width, "parts": [path]}

    def _store_late(self, df: DataFrame, parent: _Parent, grows: str, path: str, request: BackupRequest, backup_id: str, table: str, info: dict) -> tuple:
        """Write rows past the mark and what changed behind it; returns the state and leaves the rest in ``info``."""
        mark, index, m = parent.manifest["high_water"], dict(parent.index), parent.manifest
        width, new = index["width"], delta.after_high_water(df, grows, mark)
        behind = delta.up_to_high_water(df, grows, mark)
        before = late.added([late.read_sketch(self.spark, [f"{self.root}/{p}" for p in index["parts"]])])
        now = self._materialize(late.digests(late.prints(behind, grows, width)), backup_id, f"{table}-digests")
        nulls = now.where(F.col(late.BUCKET) == late.NO_VALUE).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n")).first()["n"]
        buckets = self._materialize(late.differing_buckets(late.digests_of(before), now), backup_id, f"{table}-buckets")
        count = buckets.count()
        columns, net, found = df.columns, None, dict.fromkeys(("present", "gone", "touched", "upserts", "deletes", "net1", "net2", "digest1", "digest2"), 0)
        if count:
            near = late.in_buckets(behind, grows, width, buckets, count)
            near_prints = late.prints(near, grows, width)
            old = before.join(delta.bounded_broadcast(buckets, count), late.BUCKET, "left_semi")
            read = self._materialize(late.decoded(late.added([late.cells(near_prints), old], [1, -1])), backup_id, f"{table}-decoded")
            net = read.where(F.col("_tv_h1").isNotNull())
            closed = read.where(F.col("_tv_h1").isNull()).select(late.BUCKET)
            shut = closed.count()
            if shut:  # too many rows of these differ: their rows are compared with the stored ones
                sides = [late.prints(late.in_buckets(side, grows, width, closed, shut), grows, width) for side in (behind, parent.state)]
                net = net.unionByName(late.compared(*sides))
            net = self._materialize(net, backup_id, f"{table}-net")
            seen = Observation()
            changes = late.with_copies(net, near_prints, net.count(), delta.BEFORE)
            changes = self._materialize(changes.observe(seen, *delta.multiset_change_totals(), F.min(delta.BEFORE).alias("least")), backup_id, f"{table}-changes")
            found = seen.get
            if (found["least"] or 0) < 0:
                raise SourceChanged(f"{table} changed while it was read")
        mode = LATE if net is not None else APPEND
        if net is None:
            payload = new
        else:
            former = late.in_buckets(parent.state, grows, width, buckets, count)
            late_rows = delta.multiset_payload(near, former, changes.select(*FINGERPRINT, delta.COPIES, delta.BEFORE), found["present"], found["gone"])
            one = F.lit(1).cast("bigint")
            payload = new.withColumns({delta.COPIES: one, delta.BEFORE: -one}).unionByName(late_rows)
        wrote = self._write(payload, columns, mode, path, request, grows)
        sketch = late.cells(late.prints(new, grows, width))
        if net is not None:
            sketch = late.added([sketch, late.cells(net, late.NET)])
        part, moved = self._sketch_part(sketch, backup_id, table)
        arrived = (wrote["up_rows"], wrote["up1"], wrote["up2"]) if mode == LATE else (wrote["row_count"], wrote["digest1"], wrote["digest2"])
        rows = found["upserts"] - found["deletes"]
        change = (arrived[0] + rows, int(arrived[1]) + int(found["net1"]), int(arrived[2]) + int(found["net2"]))
        weighed = tuple(int(wrote[d]) - 2 * int(a) for d, a in zip(("digest1", "digest2"), arrived[1:])) if mode == LATE else (0, 0)
        behind_now = [int(v) for v in now.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)") for c in ("row_count", "digest1", "digest2")]).first()]
        state = self._moved(parent, *change)
        held = tuple(b + int(a) for b, a in zip(behind_now, arrived))
        if moved != change or held != tuple(state) or weighed != (int(found["digest1"]), int(found["digest2"])):
            raise SourceChanged(f"{table} changed while it was read")
        index["parts"] = [*index["parts"], part]
        if len(index["parts"]) > late.MOST_PARTS:
            whole = late.added([late.read_sketch(self.spark, [f"{self.root}/{p}" for p in index["parts"]])])
            index["parts"] = [self._sketch_part(whole.where("n <> 0 or sum1 <> 0 or sum2 <> 0 or checks <> 0"), backup_id, table)[0]]
        wrote.pop("null_marks", None)
        highest = wrote.pop("high_water", None)
        info.update(
            op_mode=mode, upserts=arrived[0] + found["upserts"], deletes=found["deletes"], touched=found["touched"], index_json=json.dumps(index),
            high_water=highest if arrived[0] else mark, null_marks=nulls, seen=wrote,
        )
        return state

    # --- content-addressed chunks -----------------------------------------------------------

    def _write_chunks(self, df: DataFrame, table: str, path: str, backup_id: str, request: BackupRequest, grows: str | None) -> dict:
        """Store the chunks of a table that the vault does not hold, and name all of them in the catalog."""
        db, marked = request.db_name or "unknown", self._condemned().select(F.substring_index("path", "/", -3).alias("at")).distinct()
        held = self._read("chunks").where(F.col("table_name") == table)
        former = held.agg(F.max_by("bits", F.struct(F.col("db_name") == db, "backup_id")).alias("bits")).first()["bits"]
        bits = former or chunks.chunk_bits(df)
        names = self._materialize(chunks.chunk_names(df, bits), backup_id, f"{table}-chunks")
        # a chunk that a sweep has condemned is not used again, its rows are written anew
        usable = held.withColumn("at", F.substring_index("path", "/", -3)).join(marked, "at", "left_anti").groupBy("name").agg(F.max("path").alias("path"))
        listed = names.join(usable, "name", "left")
        listed = self._materialize(listed, backup_id, f"{table}-listed")
        wanted = listed.where("path is null")
        lacking = wanted.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("digest1", "digest2")]).first()
        if lacking["n"]:
            seen = Observation()
            kept = [f"`{c}`" for c in chunks.stored_columns(df.schema)]
            rows = chunks.chunk_rows(df, wanted, bits, lacking["n"]).observe(seen, *digest_columns()).select(*kept, chunks.NAME)
            rows.write.mode("errorifexists").option("compression", request.effective_codec).partitionBy(chunks.NAME).parquet(path)
            if (seen.get["digest1"], seen.get["digest2"]) != (lacking["digest1"], lacking["digest2"]):
                raise SourceChanged(f"{table} changed while it was read")
        at = datetime.now(timezone.utc)
        given = {"backup_id": F.lit(backup_id), "db_name": F.lit(db), "table_name": F.lit(table), "bits": F.lit(bits)}
        given["path"] = F.coalesce("path", F.concat(F.lit(f"{path}/{chunks.NAME}="), "name"))
        entry = listed.select(*[given.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CHUNKS.fields])
        self._append("chunks", entry, at, backup_id)
        metrics = [F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in (("row_count", "bigint"), ("digest1", "decimal(38,0)"), ("digest2", "decimal(38,0)"), ("raw_size", "bigint"))]
        out = names.agg(*metrics).first().asDict()
        if grows:
            marks = df.agg(delta.high_water(grows, df.schema[grows].dataType).alias("high_water"), F.count(F.when(F.col(grows).isNull(), 1)).alias("null_marks"))
            out.update(marks.first().asDict())
        return out

    def _chunk_paths(self, backup_id: str, table: str) -> list[str]:
        """Folders of the chunks of one table, at most 2 ** chunks.MOST_BITS."""
        rows = self._read("chunks", owner=backup_id).where((F.col("backup_id") == backup_id) & (F.col("table_name") == table))
        return sorted(r["path"] for r in rows.select("path").collect())

    # --- indexes of states ------------------------------------------------------------------

    def _index_path(self, backup_id: str, table: str, name: str) -> str:
        """Below the root, so that a vault may be moved as a whole."""
        return f"index/{backup_id}/{table}/{name}-{uuid.uuid4().hex[:8]}"

    def _key_index(self, df: DataFrame, keys: list[str], backup_id: str, table: str) -> tuple[dict, tuple]:
        """Check the keys of a table and store them with the fingerprints of their rows, in one pass; also count and digest of the rows."""
        buckets, path, seen = state_index.bucket_count(df), self._index_path(backup_id, table, "base"), Observation()
        prints = state_index.in_buckets(state_index.key_prints(df, keys), keys, buckets)
        prints = prints.observe(seen, *state_index.key_totals(keys)).select(*[f"`{k}`" for k in keys], *FINGERPRINT)
        state_index.write_buckets(prints, keys, buckets, f"{self.root}/{path}")
        got = seen.get
        if got["faults"]:
            raise ValueError(f"{table}: {keys} is repeated or null, not a key")
        index = {"buckets": buckets, "parts": [{"path": path, "level": 0, "rows": got["rows"]}]}
        return index, (got["rows"], got["digest1"], got["digest2"])

    def _key_parts(self, index: dict, df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[DataFrame]]:
        """Base and runs of the index of a table with a key."""
        fields = [df.schema[k] for k in keys]
        base, *runs = [f"{self.root}/{p['path']}" for p in index["parts"]]
        schema = T.StructType([*fields, *[T.StructField(h, T.LongType()) for h in FINGERPRINT]])
        return state_index.read_buckets(self.spark, schema, keys, index["buckets"], base), [state_index.read_keyed_run(self.spark, fields, r) for r in runs]

    def _keyed_changes(self, df: DataFrame, parent: _Parent, keys: list[str], backup_id: str, table: str) -> tuple[DataFrame, dict]:
        indexed = parent.index is not None  # else of a vault before indexes
        changes = (
            state_index.keyed_changes(df, *self._key_parts(parent.index, df, keys), keys) if indexed
            else delta.keyed_changes(df, self._prints(parent.steps, keys), keys)
        )
        seen = Observation()
        return self._materialize(changes.observe(seen, *delta.keyed_change_totals()), backup_id, table, indexed), seen.get

    def _range_index(self, parent: _Parent, table: str) -> dict:
        """The index of a state without a key, which the first delta on that state builds."""
        owner = parent.manifest["backup_id"]
        found = self._read("indexes", owner=owner).where((F.col("backup_id") == owner) & (F.col("table_name") == table)).first()
        if found is not None:
            return json.loads(found["index_json"])
        bits = state_index.band_bits(parent.manifest["state_rows"])
        base, tree = self._index_path(owner, table, "base"), self._index_path(owner, table, "tree")
        state_index.write_bands(self._prints(parent.steps, None), bits, f"{self.root}/{base}")
        prints = state_index.read_bands(self.spark, f"{self.root}/{base}")
        state_index.tree(prints, bits, delta.COPIES).write.parquet(f"{self.root}/{tree}")
        index = {"bits": bits, "tree": tree, "parts": [{"path": base, "level": 0, "rows": parent.manifest["state_rows"]}]}
        self._append_rows("indexes", datetime.now(timezone.utc), [{"backup_id": owner, "table_name": table, "index_json": json.dumps(index)}], owner)
        return index

    def _multiset_changes(self, df: DataFrame, index: dict, backup_id: str, table: str) -> tuple[DataFrame, dict, tuple]:
        """What changed since the indexed state, totals of the changes, and count and digest of the rows now. Only ranges in which the trees differ are compared."""
        bits, path = index["bits"], self._index_path(backup_id, table, "tree")
        prints = with_fingerprint(df).select(*FINGERPRINT)
        state_index.tree(prints, bits).write.parquet(f"{self.root}/{path}")
        before, now = (self._tree(p) for p in (index["tree"], path))
        index["tree"] = path
        bands, leaves = state_index.differing(before, now)
        if leaves is None:
            changes = self.spark.createDataFrame([], f"{FINGERPRINT[0]} bigint, {FINGERPRINT[1]} bigint, {delta.COPIES} bigint, {delta.BEFORE} bigint")
        else:
            leaves = self._materialize(leaves, backup_id, f"{table}-leaves")
            count = leaves.count()
            if 2 * count > 1 << (bits + state_index.LEAF_BITS):
                leaves = None  # most of them: looking each row up would not pay
            base, *runs = index["parts"]
            base = state_index.read_bands(self.spark, f"{self.root}/{base['path']}", bands)
            runs = [state_index.read_multiset_run(self.spark, f"{self.root}/{r['path']}") for r in runs]
            inside = F.shiftright(state_index.leaf(bits), state_index.LEAF_BITS).isin(bands)
            cut = lambda part: state_index.within(part.where(inside) if len(bands) < 1 << bits else part, bits, leaves, count)
            changes = state_index.multiset_changes(cut(prints), cut(base), [cut(r) for r in runs])
        seen = Observation()
        changes = self._materialize(changes.observe(seen, *delta.multiset_change_totals()), backup_id, table, indexed=True)
        total = now.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("digest1", "digest2")]).first()
        return changes, seen.get, (total["n"], int(total["digest1"]), int(total["digest2"]))

    def _tree(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{state_index.LEAF} int, row_count bigint, digest1 decimal(38,0), digest2 decimal(38,0)").parquet(f"{self.root}/{path}")

    def _next_index(self, index: dict | None, df: DataFrame, keys: list[str] | None, rows: int, backup_id: str, table: str) -> str:
        """The index after a delta of ``rows`` changes: one run more, some runs merged, or a new base."""
        if index is None:
            return json.dumps(self._key_index(df, keys, backup_id, table)[0])
        parts = [*index["parts"], {"path": f"index/{backup_id}/{table}/run", "level": 0, "rows": rows}]
        asked = state_index.to_merge(parts)
        if asked is not None:
            what, first = asked
            path = self._index_path(backup_id, table, "base" if what == "base" else "runs")
            some, target = parts[first:], f"{self.root}/{path}"
            if keys:
                base, runs = self._key_parts({**index, "parts": parts}, df, keys)
                if what == "base":
                    merged = state_index.keyed_base(base, runs, keys)
                    state_index.write_buckets(merged.repartition(index["buckets"], *keys), keys, index["buckets"], target)
                else:
                    state_index.merged_keyed_runs(runs[first - 1 :], keys).write.parquet(target)
            else:
                runs = [state_index.read_multiset_run(self.spark, f"{self.root}/{p['path']}") for p in parts[max(first, 1) :]]
                if what == "base":
                    base = state_index.read_bands(self.spark, f"{self.root}/{parts[0]['path']}")
                    state_index.write_bands(state_index.multiset_base(base, runs), index["bits"], target)
                else:
                    state_index.merged_multiset_runs(runs).write.parquet(target)
            level = 0 if what == "base" else some[0]["level"] + 1
            parts = [*parts[:first], {"path": path, "level": level, "rows": sum(p["rows"] for p in some)}]
        return json.dumps({**index, "parts": parts})

    @staticmethod
    def _mark_tells(df: DataFrame, grows: str, parent: Row) -> bool:
        """Whether the rows past the parent's mark are all that came since: a parent with rows needs
        a mark, and rows without a mark, which no comparison finds, must be as many as before. If
        not, the table is stored full."""
        if parent["high_water"] is None:
            return parent["state_rows"] == 0
        return df.where(F.col(grows).isNull()).count() == (parent["null_marks"] or 0)

    @staticmethod
    def _moved(parent: _Parent, rows: int, d1: int, d2: int) -> tuple:
        m = parent.manifest
        # plain integers: decimal arithmetic would round digests of more than 28 digits
        return m["state_rows"] + rows, int(m["state_digest1"]) + int(d1), int(m["state_digest2"]) + int(d2)

    def _materialize(self, changes: DataFrame, backup_id: str, table: str, indexed: bool = False) -> DataFrame:
        """Write the change list: lineage is cut, its size becomes known, a lost executor costs
        nothing that was already found. Beside an index it stays, as the index's next run."""
        path = f"{self.root}/index/{backup_id}/{table}/run" if indexed else f"{self.root}/work/{backup_id}/{table}"
        changes.write.parquet(path)
        return self.spark.read.schema(changes.schema).parquet(path)

    def _write(self, df: DataFrame, columns: list[str], mode: str, path: str, request: BackupRequest, grows: str | None = None) -> dict:
        """Write a payload; count, digest, raw size and high-water mark come from the same pass.

        The observation is the last node before the write, hence part of the result stage, whose
        metrics count once per task even when tasks are repeated. No shuffle is added.
        """
        metrics = payload_digest(mode)
        if grows:
            metrics.append(delta.high_water(grows, df.schema[grows].dataType).alias("high_water"))
            metrics.append(F.count(F.when(F.col(grows).isNull(), 1)).alias("null_marks"))
        seen = Observation()
        kept = [f"`{c}`" for c in df.columns if c not in _void_columns(df.schema)]
        out = with_fingerprint(df, columns, length=True).observe(seen, *metrics).select(*kept)
        writer = out.write.mode("errorifexists").option("compression", request.effective_codec)
        if request.chunk_rows:
            writer = writer.option("maxRecordsPerFile", request.chunk_rows)
        writer.parquet(path)
        return dict(seen.get)

    def _bounded(self, folder: str, written: list[dict], codec: str) -> None:
        """Write tables again that have a part too large to be hashed as one value, with rows per part from the width that their rows turned
        out to have. Few writes need it: a part is what one task wrote."""
        if not path_exists(self.spark, folder):
            return
        listed = integrity.list_parts(self.spark, folder)
        if listed.where(F.col("length") > integrity.PART_BYTES).isEmpty():
            return
        large = listed.groupBy("table_name").agg(F.max("length").alias("most"), F.sum("length").alias("bytes"))
        rows = {r["table_name"]: r for r in written if r["op_mode"] != CHUNKED}
        for found in large.where((F.col("most") > integrity.PART_BYTES) & F.col("table_name").isin(list(rows))).collect():
            row, path = rows[found["table_name"]], f"{folder}/{found['table_name']}"
            most = max(1, integrity.PART_BYTES * max(row["row_count"], 1) // (2 * found["bytes"]))
            self.spark.read.parquet(path).write.option("maxRecordsPerFile", most).option("compression", codec).parquet(f"{path}.parts")
            delete_path(self.spark, path)
            rename_path(self.spark, f"{path}.parts", path)

    def _measure(self, backup_id: str, folder: str, written: list[dict], at: datetime, codec: str) -> tuple[dict[str, tuple[int, int]], str]:
        """Hash the bytes of the part files, count their rows from the footers, record both, and total them per table and overall."""
        self._bounded(folder, written, codec)
        counted = [self._part_rows(row["table_name"], f"{folder}/{row['table_name']}") for row in written]
        found = reduce(DataFrame.unionByName, counted).groupBy("table_name", integrity.FILE).agg(F.count(F.lit(1)).alias("row_count"))
        stored = integrity.with_rows(integrity.hashed_parts(self.spark, folder), found).withColumn("backup_id", F.lit(backup_id))
        entry = self._append("files", stored.select(*FILES.fieldNames()), at, backup_id)
        rows = integrity.file_totals(self.spark.read.schema(FILES).parquet(entry)).collect()
        return {r["table_name"]: (r["files"], r["bytes"]) for r in rows}, integrity.overall_checksum(rows)

    def _part_rows(self, table: str, path: str) -> DataFrame:
        """A row for each stored row, with its file; only footers are read. A chunked table may have written nothing."""
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], f"table_name string, {integrity.FILE} string")
        rows = self.spark.read.schema("_tv_none int").option("recursiveFileLookup", "true").parquet(path)
        return rows.select(F.lit(table).alias("table_name"), F.col("_metadata.file_path").alias(integrity.FILE))

    def _write_manifest(self, backup_id: str, rows: list[dict], totals: dict, at: datetime) -> None:
        """One row per table; the number of tables bounds what the driver holds."""
        full = []
        for r in rows:
            files, size = totals.get(r["table_name"], (0, 0))
            values = {**r, "backup_id": backup_id, "files": files, "bytes": size}
            full.append({f: values[f] for f in MANIFEST.fieldNames()})
        self._append_rows("manifest", at, full, backup_id)

    # --- restore --------------------------------------------------------------------------

    def chain(self, backup_id: str) -> list[Row]:
        """``id, file_path, started_us, month`` of the members of a restore chain, oldest first;
        empty when the backup is unknown or has no full before it."""
        return self._chain_of(chains.successful(self.jobs()).where(F.col("id") == backup_id))

    def _chain_of(self, target: DataFrame) -> list[Row]:
        """The chain of the only job in ``target``: from it along the recorded parents to its full.

        A run that overlapped another one is no parent of it, whichever started or ended first. Only
        jobs that share the target's full are fetched. Jobs that recorded no parent are chained by
        their order."""
        t = target.select("id", "db_name", "backup_type", F.unix_micros("started_at").alias("us"), "full_id").first()
        if t is None:
            return []
        jobs = chains.successful(self.jobs()).where(F.col("db_name") == t["db_name"])
        month = F.date_format(F.col("started_at") - F.make_interval(days=F.lit(1)), "yyyy-MM").alias("month")
        wanted = ["id", "file_path", F.unix_micros("started_at").alias("started_us"), month, "parent_id", "head_id"]
        if t["full_id"] is None:
            members = chains.chain_members(jobs, chains.literal_position(t["us"], t["id"]), t["backup_type"])
            return sorted(members.select(*wanted).collect(), key=lambda r: (r["started_us"], r["id"]))
        near = jobs.where((F.col("full_id") == t["full_id"]) | (F.col("id") == t["full_id"]))
        return chains.ancestry({r["id"]: r for r in near.select(*wanted).collect()}, t["id"])

    def _steps(self, members: list[Row]) -> dict[str, list[tuple[Row, str]]]:
        """Per table the manifest rows to apply, starting at its last full copy in the chain."""
        order = {m["id"]: i for i, m in enumerate(members)}
        rows = self._read("manifest", min(m["month"] for m in members)).where(F.col("backup_id").isin(list(order))).collect()
        steps: dict[str, list[tuple[Row, str]]] = {}
        for r in sorted(rows, key=lambda r: order[r["backup_id"]]):
            step = (r, f"{members[order[r['backup_id']]]['file_path']}/{r['table_name']}")
            if r["op_mode"] in (FULL, CHUNKED):
                steps[r["table_name"]] = [step]
            else:
                steps[r["table_name"]].append(step)
        return steps

    def _payload(self, row: Row, path: str, tolerant: bool = False) -> DataFrame:
        """Rows of one table of one backup, read with the recorded schema.
        A tolerant reader finds no rows where files or the folder are gone."""
        schema = T.StructType.fromJson(json.loads(row["schema_json"]))
        void = _void_columns(schema)
        stored = [f for f in schema.fields if f.name not in void]
        copies = [T.StructField(c, T.LongType()) for c in (delta.COPIES, delta.BEFORE)]
        extra = {KEYED: [T.StructField(delta.OP, T.StringType())], MULTISET: copies, LATE: copies}
        reader = self.spark.read.schema(T.StructType(stored + extra.get(row["op_mode"], [])))
        if tolerant:
            reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        paths = self._chunk_paths(row["backup_id"], row["table_name"]) if row["op_mode"] == CHUNKED else [path]
        if row["op_mode"] == CHUNKED and tolerant:
            paths = [p for p in paths if path_exists(self.spark, p)]
        if not paths or (tolerant and not path_exists(self.spark, paths[0])):
            kinds = T.StructType(stored + extra.get(row["op_mode"], []))
            df = self.spark.createDataFrame([], kinds)
        else:
            df = reader.parquet(*paths)
        names = [f"`{f.name}`" if f.name not in void else F.lit(None).alias(f.name) for f in schema.fields]
        return df.select(*names, *[f.name for f in extra.get(row["op_mode"], [])])

    def _rebuild(self, steps: list[tuple[Row, str]]) -> DataFrame:
        """State after the steps: a full copy, then runs of deltas of the same kind."""
        state = self._payload(*steps[0])
        for mode, run in groupby(steps[1:], key=lambda s: APPEND if s[0]["op_mode"] == LATE else s[0]["op_mode"]):
            run = list(run)
            rows = [r for r, _ in run]
            payloads = [self._payload(r, p) for r, p in run]
            touched = sum(r["touched"] for r in rows)
            if mode == KEYED:
                stored = sum(r["row_count"] for r in rows)
                state = apply_keyed(state, payloads, rows[-1]["key_columns"], stored, touched)
            elif mode == MULTISET:
                state = apply_multiset(state, payloads, touched, sum(r["row_count"] for r in rows))
            else:
                # no row past a mark was touched before: all new rows may come first
                changed = [p for r, p in zip(rows, payloads) if r["op_mode"] == LATE]
                new = [p.where(F.col(delta.BEFORE) < 0).select(*[f"`{c}`" for c in state.columns]) if r["op_mode"] == LATE else p for r, p in zip(rows, payloads)]
                state = reduce(DataFrame.unionByName, new, state)
                if changed:
                    state = apply_multiset(state, [p.where(F.col(delta.BEFORE) >= 0) for p in changed], touched)
        return state

    def _stored_rows(self, steps: list[tuple[Row, str]]) -> DataFrame:
        """All rows that the steps store, those of the state and older ones, in no order and any number of copies; nothing is joined."""
        base, *payloads = [self._payload(r, p) for r, p in steps]
        return reduce(DataFrame.unionByName, [p.select(*[f"`{c}`" for c in base.columns]) for p in payloads], base)

    def _prints(self, steps: list[tuple[Row, str]], keys: list[str] | None) -> DataFrame:
        """The state after the steps, which is all that finding changes needs, as fingerprints: with the keys of the
        rows, or with copies for a table without a key. Deltas after a full copy are of one kind."""
        base, *payloads = [self._payload(r, p) for r, p in steps]
        rows = [r for r, _ in steps[1:]]
        touched = sum(r["touched"] for r in rows)
        if keys:
            return keyed_prints(base, payloads, keys, sum(r["row_count"] for r in rows), touched)
        return multiset_prints(base, payloads, touched)

    def _target_steps(self, backup_id: str, tables: list[str] | None) -> dict[str, list[tuple[Row, str]]]:
        members = self.chain(backup_id)
        if not members:
            raise ValueError(f"no restorable backup {backup_id}")
        steps = {t: s for t, s in self._steps(members).items() if s[-1][0]["backup_id"] == backup_id}
        return {t: steps[t] for t in select_names(list(steps), tables)}

    def restore(self, backup_id: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables of a backup as lazy frames, rebuilt through its chain."""
        return {t: self._rebuild(s) for t, s in self._target_steps(backup_id, tables).items()}

    def restore_to(
        self, backup_id: str, target: str, tables: list[str] | None = None, drop_existing: bool = False, parallel: int = 4
    ) -> dict[str, int]:
        """Write restored tables to ``<target>/<table>`` and check each against the recorded
        state while it is written. An existing table is an error unless it is to be dropped."""
        steps = self._target_steps(backup_id, tables)

        def one(table: str) -> int:
            seen = Observation()
            df = self._rebuild(steps[table])
            out = with_fingerprint(df).observe(seen, *digest_columns())
            kept = [f"`{c}`" for c in df.columns if c not in _void_columns(df.schema)]
            out.select(*kept).write.mode("overwrite" if drop_existing else "errorifexists").parquet(f"{target}/{table}")
            m, got = steps[table][-1][0], seen.get
            want = (m["state_rows"], m["state_digest1"], m["state_digest2"])
            if (got["row_count"], got["digest1"], got["digest2"]) != want:
                raise DigestMismatch(f"{table}: restored rows differ from backup {backup_id}")
            return got["row_count"]

        with ThreadPoolExecutor(parallel) as pool:
            return dict(zip(steps, pool.map(one, steps)))

    def payload(self, backup_id: str, table: str) -> DataFrame:
        """What one backup itself stores for a table: its rows, or its delta rows."""
        path = self._folder(backup_id)
        row = self.manifest(backup_id).where(F.col("table_name") == table).first()
        return self._payload(row, f"{path}/{table}")

    # --- checks and retention -------------------------------------------------------------

    def _folder(self, backup_id: str) -> str:
        events = self._read("job_events", owner=backup_id).where(F.col("id") == backup_id)
        found = catalog.current_jobs(events).select("file_path").first()
        if found is None or found["file_path"] is None:
            raise ValueError(f"no finished backup {backup_id}")
        return found["file_path"]

    def verify_files(self, backup_id: str) -> DataFrame:
        """Status of every recorded or stored part file."""
        folder = self._folder(backup_id)
        chunked = [r["table_name"] for r in self.manifest(backup_id).where(F.col("op_mode") == CHUNKED).select("table_name").collect()]
        if chunked:
            return self._verify_chunks(backup_id, chunked, folder)
        return integrity.compare_files(self.files(backup_id), integrity.hashed_parts(self.spark, folder, tolerant=True))

    def _verify_chunks(self, backup_id: str, chunked: list[str], folder: str) -> DataFrame:
        """Chunks may lie in the folders of earlier backups: their files are checked where they lie."""
        steps = lambda path, n: F.substring_index(path, "/", -n)
        used = self._read("chunks", owner=backup_id).where(F.col("backup_id") == backup_id).select(steps("path", 3).alias("at")).distinct()
        stored = [integrity.hashed_parts(self.spark, folder, tolerant=True).where(~F.col("table_name").isin(chunked))]
        owners = {backup_id}
        for table in chunked:
            paths = self._chunk_paths(backup_id, table)
            owners |= {p.rsplit("/", 3)[1] for p in paths}
            stored.append(integrity.hashed_chunks(self.spark, table, [p for p in paths if path_exists(self.spark, p)]))
        known = self._read("files", owner=",".join(sorted(owners))).withColumn("at", F.substring_index(steps("path", 4), "/", 3))
        own = known.where((F.col("backup_id") == backup_id) & ~F.col("table_name").isin(chunked))
        theirs = known.where(F.col("table_name").isin(chunked)).join(used, "at", "left_semi").select(*known.columns)
        return integrity.compare_files(own.unionByName(theirs), reduce(DataFrame.unionByName, stored))

    def verify_content(self, backup_id: str) -> DataFrame:
        """Recorded against recomputed row digest of every table, as one job over all tables.

        Parts that cannot be read contribute no rows, which shows as a difference."""
        folder = self._folder(backup_id)
        manifest = self.manifest(backup_id)
        parts = []
        for row in manifest.collect():
            df = self._payload(row, f"{folder}/{row['table_name']}", tolerant=True)
            columns = T.StructType.fromJson(json.loads(row["schema_json"])).fieldNames()
            found = with_fingerprint(df, columns).agg(*payload_digest(row["op_mode"])[:3])
            parts.append(found.withColumn("table_name", F.lit(row["table_name"])))
        nothing = "table_name string, row_count bigint, digest1 decimal(38,0), digest2 decimal(38,0)"
        found = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], nothing)
        return integrity.compare_digests(manifest, found)

    def differing_ranges(self, backup_id: str, table: str) -> DataFrame:
        """``leaf, recorded_rows, found_rows`` of the ranges of row prints in which a table without a key, restored now, differs from what its
        backup recorded: where a damage is, found from the root of the recorded tree. For tables whose backup was a delta."""
        steps = self._target_steps(backup_id, [table])[table]
        index = json.loads(steps[-1][0]["index_json"] or "{}")
        if "tree" not in index:
            raise ValueError(f"no tree of {table} in {backup_id}")
        before = self._tree(index["tree"])
        now = state_index.tree(with_fingerprint(self._rebuild(steps)).select(*FINGERPRINT), index["bits"])
        leaves = state_index.differing(before, now)[1]
        if leaves is None:
            leaves = before.select(state_index.LEAF).limit(0)
        side = lambda t, name: t.select(state_index.LEAF, F.col("row_count").alias(name))
        both = leaves.join(side(before, "recorded_rows"), state_index.LEAF, "left").join(side(now, "found_rows"), state_index.LEAF, "left")
        rows = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("recorded_rows", "found_rows")]
        return both.select(F.col(state_index.LEAF).alias("leaf"), *rows)

    def expired(self, as_of: Column, days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
        """Backups that may go; nothing is deleted here."""
        return retention.expired_backups(self.jobs(), as_of, days)

    def expire(self, as_of: Column, days: int = DEFAULT_RETENTION_DAYS) -> int:
        """Mark the expired backups, then delete their data. The mark comes first, so a reader
        never meets a listed backup whose files are gone."""
        now = datetime.now(timezone.utc)
        entry = f"{self.root}/work/expire-{uuid.uuid4().hex}"
        self.expired(as_of, days).select("id", "file_path").write.parquet(entry)
        gone = self.spark.read.parquet(entry)
        given = {"id": F.col("id"), "seq": F.lit(2), "status": F.lit("expired")}
        events = gone.select(
            *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOB_EVENTS.fields]
        )
        self._append("job_events", events, now, "expire")
        count = gone.count()
        # what nobody shares goes at once; chunks wait for two sweeps
        shared = self._read("chunks").select(F.col("backup_id").alias("id")).distinct()
        alone = gone.join(shared, "id", "left_anti").where("file_path is not null")
        index = gone.select(F.concat(F.lit(f"{self.root}/index/"), "id").alias("path"))
        delete_units(alone.select(F.col("file_path").alias("path")).unionByName(index))
        delete_path(self.spark, entry)
        return count

    def _roots(self) -> dict[str, str]:
        """Folders that hold backups, as recorded and with their store: the vault's own and those that requests named."""
        found = self.jobs().where("file_path is not null").select(F.regexp_replace("file_path", "/[^/]+$", "").alias("root")).distinct()
        return {r: qualified(self.spark, r) for r in {f"{self.root}/data"} | {r["root"] for r in found.collect()}}

    def units(self) -> DataFrame:
        """``path, bytes`` of what is stored for backups, in the units in which it is removed: a chunk, or else a table of a backup."""
        parts = []
        for root in sorted(set(self._roots().values())):
            if path_exists(self.spark, root):
                listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
                tail = F.split(F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path")), "/")
                steps = F.when(F.get(tail, F.lit(2)).startswith(f"{chunks.NAME}="), 3).otherwise(2)
                unit = F.concat(F.lit(f"{root}/"), F.array_join(F.slice(tail, F.lit(1), steps), "/"))
                parts.append(listed.where(F.size(tail) > 2).select(unit.alias("path"), "length"))
        if not parts:
            return self.spark.createDataFrame([], "path string, bytes bigint")
        return reduce(DataFrame.unionByName, parts).groupBy("path").agg(F.sum("length").alias("bytes"))

    def named_units(self) -> DataFrame:
        """``path`` of the units that kept backups name: their own tables, and their chunks wherever those lie."""
        kept = chains.successful(self.jobs()).select(F.col("id").alias("backup_id"), "file_path")
        own = self._read("manifest").where(F.col("op_mode") != CHUNKED).join(kept, "backup_id").select(F.concat_ws("/", "file_path", "table_name").alias("path"))
        named = own.unionByName(self._read("chunks").join(kept, "backup_id", "left_semi").select("path"))
        full = F.col("path")
        for root, store in self._roots().items():
            full = F.when(F.col("path").startswith(f"{root}/"), F.concat(F.lit(store), F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path")))).otherwise(full)
        return named.select(full.alias("path")).distinct()

    def sweep(self, grace_hours: int = 24, now: datetime | None = None) -> int:
        """Free what no kept backup names: chunks of expired backups and what failed runs left. Returns the number of units that went.

        A unit is condemned by one sweep and removed by a later one, once every run that began before it was condemned is over. A run that is
        open for longer than the grace counts as dead; what runs within it have written is no leftover. Which runs are open is asked before
        what is named, so that a run that ends in between is seen as one or the other."""
        now = now or datetime.now(timezone.utc)
        work = f"{self.root}/work/sweep-{uuid.uuid4().hex}"
        begun = F.col("started_at") > F.lit(now) - F.make_interval(hours=F.lit(grace_hours))
        self.jobs().where((F.col("status") == "running") & begun).select("id", "started_at").write.parquet(f"{work}/alive")
        alive = self.spark.read.parquet(f"{work}/alive")
        oldest = alive.agg(F.min("started_at").alias("t")).first()["t"]
        owner = F.element_at(F.split(F.regexp_replace("path", f"/{chunks.NAME}=[^/]*$", ""), "/"), -2)
        loose = retention.unreferenced(self.units(), self.named_units()).withColumn("id", owner).join(alive.select("id"), "id", "left_anti")
        loose.select("path", "bytes").write.parquet(f"{work}/loose")
        loose, marked = self.spark.read.parquet(f"{work}/loose"), self._condemned()
        retention.may_go(loose, marked, None if oldest is None else F.lit(oldest)).select("path").write.parquet(f"{work}/gone")
        fresh = loose.join(marked.select("path"), "path", "left_anti").select("path", F.lit(now).cast("timestamp").alias("at"))
        self._append("condemned", fresh, now, "sweep")
        count = delete_units(self.spark.read.parquet(f"{work}/gone"))
        delete_path(self.spark, work)
        return count

    def _condemned(self) -> DataFrame:
        return self._read("condemned")
