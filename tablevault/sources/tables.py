"""Table sets to back up, and the files they and their backups occupy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablevault.functions import scalars as X

# Connection defaults and driver classes per database type.
DEFAULT_HOST = "localhost"
DEFAULT_PORTS = {"postgresql": 5432, "mysql": 3306}
DEFAULT_USERS = {"postgresql": "postgres", "mysql": "root"}
JDBC_DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlite": "org.sqlite.JDBC",
}


def parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """``<folder>/<name>.parquet`` per table; the file list of each is fixed when it is opened."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def session_tables(spark: SparkSession, names: list[str], database: str | None = None) -> dict[str, DataFrame]:
    """Tables of the session catalog."""
    return {n: spark.table(f"{database}.{n}" if database else n) for n in names}


def jdbc_options(
    db_type: str,
    database: str,
    host: str | None = None,
    port: int | None = None,
    user: str | None = None,
    password: str | None = None,
    ssl: bool = False,
    fetch_size: int = 10_000,
    url: str | None = None,
) -> dict[str, str]:
    """Options of a JDBC read. The password stays in these options; it is never logged or stored."""
    kind = X.DB_TYPES.get(db_type)
    if kind not in JDBC_DRIVERS:
        raise ValueError(f"unsupported database type: {db_type}")
    if url is None and kind == "sqlite":
        url = f"jdbc:sqlite:{database}"
    if url is None:
        url = f"jdbc:{kind}://{host or DEFAULT_HOST}:{port or DEFAULT_PORTS[kind]}/{database}"
        if ssl:
            url += "?sslmode=require" if kind == "postgresql" else "?useSSL=true"
    options = {"url": url, "driver": JDBC_DRIVERS[kind], "fetchsize": str(fetch_size)}
    if kind != "sqlite":
        options["user"] = user or DEFAULT_USERS[kind]
    if password is not None:
        options["password"] = password
    return options


def jdbc_table(
    spark: SparkSession,
    options: dict[str, str],
    table: str,
    column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    predicates: list[str] | None = None,
    one_task: bool = False,
) -> DataFrame:
    """One table over JDBC, read in parallel.

    Either a numeric, date or timestamp ``column`` with its ``bounds`` is cut into ``partitions``
    equal ranges, or each of ``predicates`` becomes one partition (for a column whose values are
    unevenly spread). Bounds only place the cuts; rows outside them are still read. Partitions
    are separate statements without a common snapshot, so land a changing table first when
    a delta backup is to read it twice. Without ranges or predicates one task would read the whole
    table, which only ``one_task`` allows; without ``bounds`` the database is asked for them.
    """
    if column is None and not predicates and not one_task:
        raise ValueError(f"{table}: give a column or predicates to read it in parallel, or one_task for a small table")
    if predicates:
        opts = dict(options)
        url = opts.pop("url")
        return spark.read.jdbc(url, table, predicates=predicates, properties=opts)
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if column is not None:
        low, high = bounds or jdbc_bounds(spark, options, table, column)
        reader = (
            reader.option("partitionColumn", column)
            .option("lowerBound", low)
            .option("upperBound", high)
            .option("numPartitions", partitions or spark.sparkContext.defaultParallelism)
        )
    return reader.load()


def jdbc_bounds(spark: SparkSession, options: dict[str, str], table: str, column: str) -> tuple:
    """Smallest and largest value of a partition column; the database computes both."""
    query = f"SELECT min({column}) AS lo, max({column}) AS hi FROM {table}"
    row = spark.read.format("jdbc").options(**options).option("query", query).load().first()
    return row["lo"], row["hi"]


def jdbc_database_size(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Size in bytes as PostgreSQL reports it for the connected database."""
    query = "SELECT pg_database_size(current_database()) AS size_bytes"
    return spark.read.format("jdbc").options(**options).option("query", query).load()


def stored_files(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``name, path, length, modificationTime`` of the files under a root; ``name`` is relative to
    the root and may be filtered by its start. The content column is not selected, so no file is
    opened."""
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.substring(F.col("path"), F.instr("path", base) + len(base), F.length("path"))
    listed = found.select(name.alias("name"), "path", "length", "modificationTime")
    return listed.where(F.col("name").startswith(prefix)) if prefix else listed


def data_size(spark: SparkSession, root: str) -> DataFrame:
    """Number of files and bytes under a root."""
    return stored_files(spark, root).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("bytes")
    )
