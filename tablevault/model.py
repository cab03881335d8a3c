"""Requests, results and the fixed schemas of the catalog."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# The words the catalog stores.
BACKUP_TYPES = ("full", "incremental", "differential")
STATUSES = ("pending", "running", "success", "failed", "expired")
CODECS = ("gzip", "zstd", "none")
BACKUP_VERSION = "1.0"
DEFAULT_LIST_LIMIT = 20
DEFAULT_RECENT_LIMIT = 50
DEFAULT_RETENTION_DAYS = 30
DEFAULT_SIZE_CAP = "50GB"

def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


_TEXT, _INT, _LONG, _TIME, _SUM = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.DecimalType(38, 0)

JOB_EVENTS = _schema(
    id=_TEXT, seq=_INT, db_type=_TEXT, db_name=_TEXT, backup_type=_TEXT, status=_TEXT, file_path=_TEXT, file_name=_TEXT,
    file_size=_LONG, compressed_size=_LONG, raw_size=_LONG, compression_type=_TEXT, backup_version=_TEXT, retry_count=_INT,
    checksum=_TEXT, started_at=_TIME, completed_at=_TIME, duration=T.DoubleType(), error=_TEXT, metadata=_TEXT, parent_id=_TEXT, full_id=_TEXT, head_id=_TEXT,
)
BACKUP_LOGS = _schema(id=_LONG, backup_job_id=_TEXT, timestamp=_TIME, level=_TEXT, message=_TEXT, details=_TEXT)
MANIFEST = _schema(
    backup_id=_TEXT, table_name=_TEXT, op_mode=_TEXT, key_columns=T.ArrayType(_TEXT), schema_json=_TEXT,
    row_count=_LONG, digest1=_SUM, digest2=_SUM, files=_LONG, bytes=_LONG, raw_size=_LONG, high_water_column=_TEXT,
    high_water=_TEXT, null_marks=_LONG, upserts=_LONG, deletes=_LONG, touched=_LONG, state_rows=_LONG, state_digest1=_SUM, state_digest2=_SUM,
    index_json=_TEXT,
)
CHUNKS = _schema(
    backup_id=_TEXT, db_name=_TEXT, table_name=_TEXT, bits=_INT, band=_INT, name=_TEXT, path=_TEXT, row_count=_LONG, digest1=_SUM, digest2=_SUM,
)
CONDEMNED = _schema(path=_TEXT, at=_TIME)
INDEXES = _schema(backup_id=_TEXT, table_name=_TEXT, index_json=_TEXT)
FILES = _schema(backup_id=_TEXT, table_name=_TEXT, path=_TEXT, length=_LONG, row_count=_LONG, sha256=_TEXT)

_SAFE_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def safe_name(name: str) -> str:
    """Names become directories, so only plain ones are accepted."""
    if not _SAFE_NAME.fullmatch(name) or ".." in name or name.startswith((".", "_")):
        raise ValueError(f"unusable name: {name!r}")
    return name


@dataclass(frozen=True)
class BackupRequest:
    """What one run backs up and how."""

    db_name: str = ""
    backup_type: str = "full"
    compress: bool = True
    codec: str = "gzip"
    output: str | None = None
    name: str | None = None
    tables: list[str] | None = None
    exclude_tables: list[str] | None = None
    db_type: str = "postgresql"
    host: str | None = None
    keys: dict[str, list[str]] = field(default_factory=dict)
    high_water: dict[str, str] = field(default_factory=dict)
    parallel: int = 4
    chunk_rows: int | None = None
    max_size: str | None = None
    dedup: bool = False
    late_rows: bool = False

    def __post_init__(self):
        if self.backup_type not in BACKUP_TYPES:
            raise ValueError(f"backup_type must be one of {BACKUP_TYPES}")
        if self.codec not in CODECS:
            raise ValueError(f"codec must be one of {CODECS}")
        if self.parallel < 1:
            raise ValueError("parallel must be at least 1")
        if self.name is not None:
            safe_name(self.name)

    @property
    def effective_codec(self) -> str:
        return self.codec if self.compress else "none"


@dataclass(frozen=True)
class BackupResult:
    success: bool
    backup_id: str
    duration: float
    file_path: str | None = None
    file_size: int | None = None
    compressed_size: int | None = None
    raw_size: int | None = None
    checksum: str | None = None
    error: str | None = None
