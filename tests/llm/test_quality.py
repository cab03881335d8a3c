"""Quality rules against plain Python."""

import brute
from brute import MEDIUM

from tablevault.llm import quality_hosts, registry

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in registry.queries()["op6_host_rules"](spark, MEDIUM).collect()}
    texts = {r[0]: r[1] for r in registry.documents(spark, MEDIUM, "doc_id", "text").collect()}
    assert set(rows) == set(texts)
    for d, t in texts.items():
        assert tuple(rows[d][c] for c in COLUMNS) == brute.quality(t), d
        assert not (rows[d]["base_failed"] and rows[d]["kept"])
    assert 0.7 < sum(r["kept"] for r in rows.values()) / len(rows) < 1


def test_odd_rows(spark, odd_documents, no_documents):
    docs = odd_documents.withColumnRenamed("n_chars", "kept").withColumnRenamed("lang", "_words")
    rows = quality_hosts.quality_rules(docs).collect()
    want = sorted(brute.quality(r["text"]) for r in odd_documents.collect())
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == want
    assert quality_hosts.quality_rules(no_documents).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 50 == 0 else "short", "bad") for i in range(500)] + [(1000 + i, good, f"host{i % 20}") for i in range(400)]
    rows += [(5000, good, "tiny"), (5001, "short", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality_hosts.quality_rules(docs).collect()
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert not any(d < 500 for d in kept) and all(1000 + i in kept for i in range(400))
    assert 5000 in kept  # a rate from two documents is shrunk
    assert {r["host_rejected"] for r in out if r["source"] == "bad"} == {True}


def test_verdicts_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(quality_hosts, "SENT_ROWS", 0)
    assert quality_hosts.quality_rules(registry.documents(spark, MEDIUM, "doc_id", "text", "source")).count() == 1000
