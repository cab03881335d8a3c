"""Quality rules whose failures are also judged by host, with rates shrunk by an empirical beta prior. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablevault.llm.common import WORD, settle, without

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed"]
#: Name and condition of each rule that a document can fail.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "100 * n_dup_lines > 35 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 25 * n_words",
}
VERDICT = ["host_rate", "host_rejected", "kept"]
#: Rows of a table that is sent to every task at most; a row of verdicts takes under 200 bytes.
SENT_ROWS = 100_000


def _measured(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n = F.col("n_words").cast("int")
    joined = lambda a, step: F.zip_with(a, F.slice(a, step + 1, F.greatest(n, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    out = docs.withColumn("_words", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.size(F.regexp_extract_all(body, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long"))
    out = out.withColumn("_lines", F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_lines", F.size("_lines").cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Hashes of windows of 2, 4 and 8 words, each from two of half its width.
    out = out.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words", "_lines")
    out = out.withColumn("_h2", joined(F.col("_h1"), 1)).drop("_h1")
    out = out.withColumn("_h4", joined(F.col("_h2"), 2)).drop("_h2")
    out = out.withColumn("_h8", F.slice(joined(F.col("_h4"), 4), 1, F.greatest(n - (WINDOW - 1), F.lit(0)))).drop("_h4")
    again = F.size(F.array_distinct("_h8")) < F.size("_h8")
    pairs = F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    out = out.withColumn("_s", F.when(again, pairs)).drop("_h8")
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    out = out.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("_s")
    # Windows that start less than eight words apart share the words between them.
    gaps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    return out.withColumn("base_failed", F.expr(f"{RULES['short']} or {RULES['repeats']}"))


def prior(hosts: DataFrame) -> DataFrame:
    """One row: alpha and beta of a beta distribution with the hosts' mean failure rate and spread (method of moments).

    The spread that chance gives a host of its size is taken off; if none is left, the prior is worth 1,000,000 documents.
    """
    rate = F.col("failed") / F.col("docs")
    moments = hosts.agg(
        (F.sum("failed") / F.sum("docs")).alias("m"), F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("docs")).alias("inverse")
    )
    m = F.least(F.greatest(F.coalesce("m", F.lit(0.5)), F.lit(0.001)), F.lit(0.999))
    between = F.greatest(F.col("v") - m * (1 - m) * F.col("inverse"), m * (1 - m) / 1_000_001)
    worth = F.greatest(m * (1 - m) / between - 1, F.lit(1.0))
    return moments.select((m * worth).alias("alpha"), ((1 - m) * worth).alias("beta"))


def host_verdicts(measured: DataFrame, host: Column, bad_rate: float) -> DataFrame:
    """A row for each host: documents, failures of each rule and of any, shrunk rate, verdict."""
    failed = [F.expr(rule) for rule in RULES.values()]
    any_failed = failed[0]
    for rule in failed[1:]:
        any_failed = any_failed | rule
    counts = [F.sum(rule.cast("long")).alias(f"failed_{name}") for name, rule in zip(RULES, failed, strict=True)]
    hosts = measured.groupBy(host.alias("_host")).agg(F.count("*").alias("docs"), F.sum(any_failed.cast("long")).alias("failed"), *counts)
    hosts = settle(hosts, "hosts")
    fitted = prior(hosts).first()  # two numbers
    rate = (F.col("failed") + fitted.alpha) / (F.col("docs") + fitted.alpha + fitted.beta)
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > bad_rate)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", bad_rate: float = 0.6, carry: list[str] | None = None) -> DataFrame:
    """Measures of each document, the verdict on its host, and ``kept``.

    A document is kept if it fails no rule of ``RULES`` and its host's shrunk failure rate is at most ``bad_rate``. A null
    text has no words and fails; documents without a host form a host of their own; equal rows are judged each; an
    empty table gives an empty one. Columns named like a measure or a verdict are replaced, ``carry`` picks those kept.
    """
    carry = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in {*MEASURES, *VERDICT}]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.col(f"`{text}`").alias("_text"), F.col(f"`{host}`").cast("string").alias("_of"))
    measured = settle(_measured(inner, "_text").drop("_text"), "measured")
    verdicts = host_verdicts(measured, F.col("_of"), bad_rate).select("_host", "host_rate", "host_rejected")
    few = verdicts.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    joined = measured.join(F.broadcast(verdicts) if few else verdicts, F.col("_of").eqNullSafe(F.col("_host")), "left")
    fails = F.expr(" or ".join(f"({rule})" for rule in RULES.values()))
    return joined.select(*[F.col("_row")[c].alias(c) for c in carry], *MEASURES, "host_rate", "host_rejected", (~fails & ~F.col("host_rejected")).alias("kept"))
