"""Secret scans with a ledger of blobs: every distinct text is scanned once for each version of the rules.

A text's address is its SHA-256. The ledger is a table of (blob, rule_version, findings); a run scans the blobs that it
lacks for the present rules, appends them, and joins findings back to every row (path, version) that holds the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablevault.llm.common import small_batches, unused, without


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_NAMES = _either_case("password|passwd|secret|token|api_?key")
#: kind, pattern, group whose length counts, least length, and texts (lower case) of which one must occur. In this order at equal starts.
RULES = [
    ("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    ("hex", r"[0-9a-f]{24,}", 0, 24, ()),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1, ("private key-----",)),
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40, ("gho_", "ghp_", "ghs_", "ghu_", "ghr_")),
    ("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 0, 20, ("eyj",)),
    ("url", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/@]+@", 0, 1, ("://",)),
]
BASE = ["assign", "access", "hex"]
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
#: Rows of 32-byte addresses that are sent to every task at most.
SENT_ROWS = 200_000


def find_spans(text: str, rules: list[tuple]) -> list[tuple[str, int, int]]:
    """All spans, by start, then kind as listed; matches of one kind are leftmost and do not overlap."""
    low, found = text.lower(), []
    for rank, (kind, pattern, group, least, needed) in enumerate(rules):
        if not needed or any(n in low for n in needed):
            found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def blob_address(text: Column) -> Column:
    """SHA-256 of a text, 32 bytes; a null text counts as the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Findings by (blob, rule_version), once each, also if concurrent runs scanned the same blob."""
    schema = f"blob binary, rule_version string, findings {FINDINGS}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_new_blobs(docs: DataFrame, ledger: str, rules: list[tuple] = RULES, version: str = RULE_VERSION) -> None:
    """Scan the texts of ``docs`` whose blob the ledger lacks for these rules, each once, and append them to the ledger."""
    spark = docs.sparkSession
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == version).select("blob")
    addressed = docs.select(blob_address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if not seen.isEmpty():
        unseen = addressed.select("blob").distinct().join(seen, "blob", "left_anti")
        if unseen.limit(SENT_ROWS + 1).count() <= SENT_ROWS:  # few new texts: only they move
            addressed = addressed.join(F.broadcast(unseen), "blob", "left_semi")
    # Copies meet within their partition first, so a blob that fills a third of the table moves once for each partition.
    blobs = addressed.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left_anti")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(kind, re.compile(pattern), *rest) for kind, pattern, *rest in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in small_batches(batches, "text", 8 << 20):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, ready)] for t in batch.column("text").to_pylist()]
            columns = [batch.column("blob").cast(pa.binary()), pa.array([version] * batch.num_rows), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["blob", "rule_version", "findings"])

    found = blobs.select("blob", "text").mapInArrow(scan, f"blob binary, rule_version string, findings {FINDINGS}")
    found.write.mode("append").parquet(ledger)


def join_findings(docs: DataFrame, ledger: str, version: str = RULE_VERSION, drop_text: bool = False) -> DataFrame:
    """Every row with the ``findings`` of its text (an empty list if there are none). A column of that name is replaced."""
    spark = docs.sparkSession
    docs = without(docs, ["findings"])
    address, blob, held = unused(docs, "_blob", "blob", "_found")
    found = read_ledger(spark, ledger).where((F.col("rule_version") == version) & (F.size("findings") > 0))
    found = found.groupBy(F.col("blob").alias(blob)).agg(F.first("findings").alias(held))
    rows = docs.withColumn(address, blob_address(F.col("text")))
    if drop_text:
        rows = rows.drop("text")
    few = found.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    joined = rows.join(F.broadcast(found) if few else found, F.col(address) == F.col(blob), "left")
    none = F.expr(f"cast(array() as {FINDINGS})")
    return joined.withColumn("findings", F.coalesce(held, none)).drop(held, address, blob)


def scan_secrets(docs: DataFrame, ledger: str, drop_text: bool = False) -> DataFrame:
    """Bring the ledger up to date with ``docs`` and give each row its ``findings``.

    Offsets are code points, ends exclusive. A null text counts as empty and has no findings; copies of a text share theirs,
    repeated rows stay, an empty table gives an empty one.
    """
    scan_new_blobs(docs, ledger)
    return join_findings(docs, ledger, drop_text=drop_text)


def spans_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    of = lambda kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE]
    return scanned.select("doc_id", *counts, F.sha2(spans_text(of(BASE)), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"))


def redact(text: Column, findings: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first decides, to its longest end."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, f: Column) -> Column:
        past = F.greatest(done["at"], f["end"])
        between = F.substring(text, done["at"] + 1, F.greatest(f["start"] - done["at"], F.lit(0)))
        mark = F.when(f["start"] >= done["at"], F.concat(F.lit("["), f["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(done["out"], between, mark).alias("out"), past.alias("at"))

    done = F.aggregate(findings, empty, step)
    return F.when(F.size(findings) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
