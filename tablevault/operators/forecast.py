"""How large a backup of a table will be, from a sample that is written by the same writer with the same codec.

The rows of each task fall into blocks of consecutive rows, as they would lie in a file, and every so many blocks one is written to a
working folder, whole and again in quarters. A short file pays for its dictionaries anew: what quarters cost beyond whole blocks tells what blocks
cost beyond long files. Bytes a row, that surplus, and how much blocks differ give the size and a bound of its error. The sample has about
``SAMPLE_BLOCKS`` blocks at any size of the table, whose rows are read once for it; a table of few blocks is written whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevault.workspace import delete_path, path_exists

#: Rows of a block, and blocks of a sample.
BLOCK_ROWS, SAMPLE_BLOCKS = 16_384, 48
#: Pieces of a block that are written once more.
PIECES = 4
#: The bound: standard errors, a share of the size, and bytes of a file beside its rows; the surplus of short files is added whole.
ERRORS, SHARE, FILE_BYTES = 3.0, 0.15, 8_192

_PART, _BLOCK, _PIECE = "_tv_part", "_tv_block", "_tv_piece"


@dataclass(frozen=True)
class Forecast:
    """Expected bytes, and by how much they may be off."""

    rows: int
    size: int
    error: int

    @property
    def least(self) -> int:
        return max(0, self.size - self.error)


def blocks(df: DataFrame, every: int) -> DataFrame:
    """Rows of one block in ``every``, with the name of their block and the number of their piece in it."""
    place, length = F.col(_PART).bitwiseAND((1 << 33) - 1), F.lit(BLOCK_ROWS).cast("bigint")
    block = F.shiftright(F.col(_PART), 33) * (1 << 33) + F.call_function("div", place, length)
    piece = F.call_function("div", F.pmod(place, length) * PIECES, length)
    rows = df.withColumn(_PART, F.monotonically_increasing_id()).withColumns({_BLOCK: block, _PIECE: piece})
    return rows.where(F.pmod(F.xxhash64(_BLOCK), F.lit(every)) == 0).drop(_PART)


def forecast(df: DataFrame, codec: str, folder: str) -> Forecast:
    """Size of ``df`` as Parquet. ``folder`` holds the sample meanwhile."""
    spark = df.sparkSession
    tasks = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = tasks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("p").alias("files"), F.coalesce(F.sum(F.ceil(F.col("n") / BLOCK_ROWS)), F.lit(0)).alias("blocks")).first()
    rows, files = total["rows"], total["files"]
    if not rows:
        return Forecast(0, 0, FILE_BYTES)
    every = max(1, total["blocks"] // SAMPLE_BLOCKS)
    try:
        found = _measured(spark, df, codec, folder, every) or _measured(spark, df, codec, folder, 1)
    finally:
        if path_exists(spark, folder):
            delete_path(spark, folder)
    m, size, held = found["m"], found["bytes"], found["rows"]
    # bytes a row are a + b / length: whole blocks have b / length once, quarters four times
    surplus = max(0.0, (found["pieces"] - size) / held / (PIECES - 1)) if rows > BLOCK_ROWS else 0.0
    rate = size / held
    # variance of a ratio over clusters; squares of block sums, which are small, in doubles
    spread = max(0.0, found["bb"] - 2 * rate * found["br"] + rate * rate * found["rr"])
    error = rows * math.sqrt(spread / (m * max(m - 1, 1))) / (held / m)
    long = min(1.0, files * BLOCK_ROWS / rows)  # files of the backup compared with blocks
    size = (rate - surplus * (1 - long)) * rows
    return Forecast(rows, round(size), round(ERRORS * error + SHARE * size + surplus * rows + (files + m) * FILE_BYTES))


def _measured(spark: SparkSession, df: DataFrame, codec: str, folder: str, every: int) -> dict | None:
    path, again = f"{folder}/every={every}", f"{folder}/pieces={every}"
    blocks(df, every).drop(_PIECE).write.option("compression", codec).partitionBy(_BLOCK).parquet(path)
    blocks(df, every).write.option("compression", codec).partitionBy(_BLOCK, _PIECE).parquet(again)
    name = lambda p: F.regexp_extract(p, f"{_BLOCK}=(-?[0-9]+)", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    listed = files.load(path)
    sizes = listed.select(name("path").alias("b"), "length").groupBy("b").agg(F.sum("length").alias("bytes"))
    if sizes.isEmpty():
        return None
    kept = spark.read.schema("_tv_none int").option("recursiveFileLookup", "true").parquet(path)
    counts = kept.groupBy(name(F.col("_metadata.file_path")).alias("b")).agg(F.count(F.lit(1)).alias("rows"))
    x, y = F.col("bytes").cast("double"), F.col("rows").cast("double")
    sums = {"bytes": F.sum("bytes"), "rows": F.sum("rows"), "bb": F.sum(x * x), "br": F.sum(x * y), "rr": F.sum(y * y), "m": F.count(F.lit(1))}
    return sizes.join(counts, "b").agg(*[c.alias(n) for n, c in sums.items()]).first().asDict() | files.load(again).agg(F.sum("length").alias("pieces")).first().asDict()
