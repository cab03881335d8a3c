"""Log files that are appended to while they are read, as a streaming source of whole lines.

The offset of the stream has a mark for each file: the byte after its last line feed, a digest of its first line and one of the bytes
just before the mark. A file continues what was read when it holds the bytes that the mark describes, whatever its name: so a file
that was renamed goes on where it stood, one that was truncated or replaced begins anew, and a batch that is repeated after a failure
reads the same bytes wherever they now lie. Half a line at the end waits until its line feed has come.

Files are opened through Arrow's file systems, by the tasks that read them; marks cost two small reads of each file that grew.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tablevault.workspace import qualified

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

SCHEMA = "file string, position long, value string"
#: Bytes of one task, of one read, of a first line that count, and before a mark.
SLICE_BYTES, BLOCK_BYTES, HEAD_BYTES, TAIL_BYTES = 32 << 20, 1 << 20, 4096, 256


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:32]


def _read_at(source, start: int, length: int) -> bytes:
    source.seek(start)
    return source.read(length)


def _last_line_end(source, size: int) -> int:
    """The byte after the last line feed, found from the end; 0 without one."""
    stop = size
    while stop > 0:
        start = max(0, stop - BLOCK_BYTES)
        at = _read_at(source, start, stop - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return 0


def _head(source) -> str:
    """Digest of the first line, which is whole wherever there is a mark, or of as much of it as counts."""
    return _digest(_read_at(source, 0, HEAD_BYTES).split(b"\n", 1)[0])


def _tail(source, end: int) -> str:
    start = max(0, end - TAIL_BYTES)
    return _digest(_read_at(source, start, end - start))


@dataclass
class Slice(InputPartition):
    """Lines that begin in ``[start, stop)`` of the bytes up to a mark; ``whole`` if a line begins at ``start``."""

    file: str
    mark: dict
    start: int
    stop: int
    whole: bool


class GrowingFiles:
    """The files of a folder and what they hold."""

    def __init__(self, folder: str, pattern: str):
        self.store, self.place = arrow_fs.FileSystem.from_uri(folder)
        self.pattern = pattern

    def listed(self) -> dict[str, arrow_fs.FileInfo]:
        found = self.store.get_file_info(arrow_fs.FileSelector(self.place, allow_not_found=True))
        return {f.base_name: f for f in found if f.is_file and f.base_name[0] not in "._" and fnmatchcase(f.base_name, self.pattern)}

    def open(self, name: str):
        return self.store.open_input_file(f"{self.place}/{name}")

    def mark(self, name: str, size: int) -> dict | None:
        with self.open(name) as source:
            end = _last_line_end(source, size)
            return {"end": end, "head": _head(source), "tail": _tail(source, end)} if end else None

    def holds(self, name: str, mark: dict) -> bool:
        """Whether the bytes up to a mark are those of the file of this name now."""
        try:
            with self.open(name) as source:
                return source.size() >= mark["end"] and _head(source) == mark["head"] and _tail(source, mark["end"]) == mark["tail"]
        except FileNotFoundError:
            return False

    def whereabouts(self, name: str, mark: dict) -> str:
        for candidate in (name, *(n for n in sorted(self.listed()) if n != name)):
            if self.holds(candidate, mark):
                return candidate
        raise FileNotFoundError(f"lines of {name} up to byte {mark['end']} were removed before they were read")


class GrowingReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, slice_bytes: int):
        self.folder, self.pattern, self.slice_bytes = folder, pattern, slice_bytes
        self.seen: dict[tuple, dict | None] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files = GrowingFiles(self.folder, self.pattern)
        marks = {}
        for name, info in files.listed().items():
            known = (name, info.size, info.mtime_ns)
            try:
                marks[known] = self.seen[known] if known in self.seen else files.mark(name, info.size)
            except FileNotFoundError:
                pass  # renamed since it was listed: the next trigger sees it under its new name
        self.seen = marks
        return {known[0]: mark for known, mark in sorted(marks.items()) if mark is not None}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        files = GrowingFiles(self.folder, self.pattern)
        read_from = self._continued(files, start, end)
        slices = []
        for name, mark in end.items():
            at = read_from.get(name, 0)
            for first in range(at, mark["end"], self.slice_bytes):
                slices.append(Slice(name, mark, first, min(first + self.slice_bytes, mark["end"]), first == at))
        return slices

    @staticmethod
    def _continued(files: GrowingFiles, start: dict, end: dict) -> dict[str, int]:
        """How far each file has been read, under whatever name. Each former mark is continued by one file at most, its own name first."""
        read_from, former, others = {}, dict(start), []
        fits = lambda was, mark: was["head"] == mark["head"] and was["end"] <= mark["end"]
        for name, mark in end.items():
            was = start.get(name)
            if was == mark or (was is not None and fits(was, mark) and files.holds(files.whereabouts(name, mark), was)):
                read_from[name] = was["end"]
                del former[name]
            else:
                others.append(name)
        for name in others:
            likely = [n for n, was in former.items() if fits(was, end[name])]
            now = files.whereabouts(name, end[name]) if likely else name
            for n in sorted(likely, key=lambda n: -former[n]["end"]):
                if files.holds(now, former[n]):
                    read_from[name] = former.pop(n)["end"]
                    break
        return read_from

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files = GrowingFiles(self.folder, self.pattern)
        with files.open(files.whereabouts(partition.file, partition.mark)) as source:
            lines = whole_lines(source, partition)
            for batch in iter(lambda: _next_batch(lines), []):
                places, texts = zip(*batch)
                values = [t.removesuffix(b"\r").decode("utf-8", "replace") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.file] * len(batch), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())],
                    names=["file", "position", "value"],
                )


def _next_batch(lines: Iterator[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Lines of about a block."""
    batch, size = [], 0
    for line in lines:
        batch.append(line)
        size += len(line[1]) + 64
        if size >= BLOCK_BYTES:
            break
    return batch


def whole_lines(source, part: Slice) -> Iterator[tuple[int, bytes]]:
    """Position and bytes of the lines that begin in a slice; the last one may end behind it. A block and a line are held at a time."""
    # a slice inside the file looks one byte back: a line begins at its start if a line feed ends there
    at = part.start if part.whole else part.start - 1
    skip, rest, position = not part.whole, [], at
    while at < part.mark["end"]:
        block = _read_at(source, at, min(BLOCK_BYTES, part.mark["end"] - at))
        at += len(block)
        *ended, last = block.split(b"\n")
        for piece in ended:
            line = b"".join([*rest, piece])
            rest = []
            if skip:
                skip = False
            else:
                yield position, line
            position += len(line) + 1
            if position >= part.stop:
                return
        if last:
            rest.append(last)


class GrowingLines(DataSource):
    """Format ``growing_lines``: ``path`` is a folder, ``pattern`` names its files, ``sliceBytes`` bounds a task."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("sliceBytes", SLICE_BYTES)))


def growing_lines(spark: SparkSession, folder: str, pattern: str = "*", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``file, position, value`` of the whole lines in the files of a folder, as a stream."""
    spark.dataSource.register(GrowingLines)
    full = qualified(spark, folder)
    full = "file:///" + full.removeprefix("file:").lstrip("/") if full.startswith("file:") else full
    return spark.readStream.format("growing_lines").option("pattern", pattern).option("sliceBytes", slice_bytes).load(full)
