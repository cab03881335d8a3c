"""Secret scans against Python's regular expressions over whole texts."""

import hashlib
import re

from brute import MEDIUM

from tablevault.llm import registry, secret_ledger as sl

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.I),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+"),
}


def base(text):
    found = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                found.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def expected(text):
    spans = base(text)
    said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return (*[sum(k == x for k, _, _ in spans) for x in PATTERNS], hashlib.sha256(said.encode()).hexdigest())


def test_query(spark):
    rows = {r["doc_id"]: r for r in registry.queries()["op9_secret_ledger"](spark, MEDIUM).collect()}
    texts = {r[0]: r[1] for r in registry.documents(spark, MEDIUM, "doc_id", "text").collect()}
    assert set(rows) == set(texts) and len(rows) == 1000
    for d, t in texts.items():
        assert tuple(rows[d])[1:5] == expected(t), d
        assert {f"{k}:{s}:{e}" for k, s, e in base(t)} <= set(rows[d]["spans"].split(","))
    assert sum(r["n_assign"] for r in rows.values()) > 0


TRICKY = [
    'API_KEY = "abcdef12" apikey: x Token:short PASSWORD=longenough1 passwd"  :  \'zzzzzzzz', "😀 secret=abcdefgh é token=tokentoken=1 AKIA" + "A" * 16 + " AKIAB",
    "0123456789abcdef01234567 " * 3 + "0123456789abcdef0123456", "ſecret=abcdefgh paſſword=abcdefgh", "password=password=abcdefg", "x" * 100_000 + " token=abcdef0", "",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- ghp_" + "a" * 36,
]


def test_tricky_texts_and_redaction(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    root = f"{spark.sparkContext.getCheckpointDir()}/ledger-a"
    scanned = sl.scan_secrets(docs, root)
    rows = {r["doc_id"]: r for r in sl.digests(scanned).collect()}
    for i, t in enumerate(TRICKY):
        if "ſ" not in t:
            assert tuple(rows[i])[1:5] == expected(t), t[:50]
    assert rows[3]["n_assign"] == 0
    clean = {r[0]: r[1] for r in scanned.select("doc_id", sl.redact(scanned.text, scanned.findings)).collect()}
    assert clean[1] == "😀 [assign] é [assign] [access] AKIAB" and clean[6] == "" and "[pem] [github]" in clean[7]


def test_ledger_scans_each_blob_once(spark, odd_documents, no_documents):
    root = f"{spark.sparkContext.getCheckpointDir()}/ledger-b"
    assert sl.scan_secrets(no_documents, root).count() == 0
    docs = odd_documents.withColumnRenamed("n_chars", "findings")
    assert sl.scan_secrets(docs, root).count() == 13
    n = sl.read_ledger(spark, root).count()
    assert n == len({r["text"] or "" for r in odd_documents.collect()})
    more = docs.unionByName(spark.createDataFrame([(99, "token=abcdefgh", "en", "a", 1)], docs.schema))
    out = {r["doc_id"]: r["findings"] for r in sl.scan_secrets(more, root).collect()}
    assert sl.read_ledger(spark, root).count() == n + 1 and len(out[99]) == 1
    sl.scan_new_blobs(more, root, version="other")
    assert sl.read_ledger(spark, root).count() == 2 * n + 2


def test_columns_with_the_names_of_helpers(spark, odd_documents, tmp_path):
    docs = odd_documents.withColumnRenamed("n_chars", "blob").withColumnRenamed("lang", "_found").withColumnRenamed("source", "_blob")
    got = sl.scan_secrets(docs, str(tmp_path / "ledger"))
    assert got.columns == [*docs.columns, "findings"]
    assert sorted(map(repr, got.drop("findings").collect())) == sorted(map(repr, docs.collect()))
