import io
import os
import random

from pyspark.sql import functions as F

from tablevault.sources import growing
from tablevault.streaming import intake


def _line(i, level="info"):
    return f'{{"level":"{level}","message":"m{i}","timestamp":"2024-01-02T03:04:05.000Z"}}\n'


def _messages(spark, table):
    return sorted(r["message"] for r in intake.stored_logs(spark, str(table)).collect())


def test_growth_half_lines_and_rotation(spark, tmp_path):
    folder, table, progress = (tmp_path / n for n in ("in", "table", "progress"))
    folder.mkdir()
    log = folder / "app.log"
    run = lambda: intake.start_growing_intake(spark, str(folder), str(table), str(progress)).awaitTermination()
    log.write_text(_line(1) + _line(2) + _line(3)[:20])
    run()
    assert _messages(spark, table) == ["m1", "m2"]
    with log.open("a") as out:
        out.write(_line(3)[20:] + _line(4))
    run()
    run()
    assert _messages(spark, table) == ["m1", "m2", "m3", "m4"]
    with log.open("a") as out:  # more lines, then rotation, before anyone looks
        out.write(_line(5))
    os.rename(log, folder / "app.log.1")
    log.write_text(_line(6))
    run()
    os.rename(folder / "app.log.1", folder / "app.log.2")  # moved on without growth
    os.rename(log, folder / "app.log.1")
    log.write_text(_line(7, "error"))
    run()
    assert _messages(spark, table) == [f"m{i}" for i in range(1, 8)]
    assert [r["message"] for r in intake.errors_of(spark, str(table)).collect()] == ["m7"]
    log.write_text(_line(8) * 3)  # replaced in place, longer than what was read
    run()
    assert _messages(spark, table) == [f"m{i}" for i in range(1, 8)] + ["m8"] * 3


def test_slices_give_every_line_once():
    draw = random.Random(5)
    for _ in range(200):
        lines = [b"x" * draw.choice([0, 1, 5, 40]) + str(i).encode() for i in range(draw.randrange(1, 12))]
        data = b"\n".join(lines) + b"\n"
        size, found = draw.randrange(1, 30), []
        for at in range(0, len(data), size):
            part = growing.Slice("f", {"end": len(data)}, at, min(at + size, len(data)), at == 0)
            found += list(growing.whole_lines(io.BytesIO(data), part))
        assert [t for _, t in found] == lines
        assert all(data[p : p + len(t)] == t for p, t in found)


def test_slices_in_a_stream(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"line {i}\n" for i in range(500)))
    (folder / "b.log").write_text("never ended")
    (folder / "c.txt").write_text("other\n")
    lines = growing.growing_lines(spark, str(folder), "*.log", slice_bytes=100)
    lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start(table).awaitTermination()
    got = spark.read.parquet(table)
    assert got.count() == 500 and got.select(F.countDistinct("value")).first()[0] == 500 and got.select("file").distinct().count() == 1


def test_a_repeated_batch_finds_renamed_files(tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    reader = growing.GrowingReader(f"file://{tmp_path}", "*", 1 << 20)
    end = reader.latestOffset()
    os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
    (tmp_path / "a.log").write_text("three, which is longer\n")
    parts = reader.partitions({}, end)
    assert [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()] == ["one", "two"]
    after = reader.latestOffset()
    parts = reader.partitions(end, after)
    assert [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()] == ["three, which is longer"]


def test_blocks_smaller_than_lines(monkeypatch):
    monkeypatch.setattr(growing, "BLOCK_BYTES", 3)
    data = b"abcdefgh\n\nxy\nhalf"
    assert growing._last_line_end(io.BytesIO(data), len(data)) == 13
    part = growing.Slice("f", {"end": 13}, 0, 13, True)
    assert list(growing.whole_lines(io.BytesIO(data), part)) == [(0, b"abcdefgh"), (9, b""), (10, b"xy")]
