"""Packing and token files against the tokenizers library on whole texts."""

from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from brute import MEDIUM
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tablevault.llm import packing, registry, token_files
from tablevault.llm.encoding import Encoder

BYTE, WORDS = registry.vocabulary("byte_bpe_50k.json"), registry.vocabulary("word_bpe_49k.json")


def check_pieces(rows, texts, encode):
    """texts: (doc_id, text) pairs; ids that occur several times must have equal texts."""
    count, of = defaultdict(int), dict(texts)
    for d, _ in texts:
        count[d] += 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(of)
    for d, pieces in by_doc.items():
        ids = encode(of[d]) + [2]
        first = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        want = [(0, 0, first)] + [(k, first + (k - 1) * 1024, 1024) for k in range(1, -(-len(ids) // 1024))]
        want = [(*w, brute.crc(ids[w[1] : w[1] + w[2]])) for w in want] * count[d]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_encoder_equals_library(path):
    kept, plain = Encoder(path, most_units=50), Tokenizer.from_file(path)
    texts = ["a  b", "  lead", "trail \n", " \n\n x", "tab\tx y", "", None, "ÀÉ  ̀a  b", "don't <|endoftext|> it's", "x \n", "ab\x1ccd e", "1 2 a!b",
             "ΑΣ A", "word, Word. l'eau, o'x. a.b ,c", "one\ntwo three.\nFour", "ǅa.", "x́ y", "a\0b c", "Straße, İI", "中文, yes"]
    for _ in range(2):
        flat, sizes = kept.encode(texts, 2)
        got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_packing_query(spark):
    encode = lambda t: Tokenizer_byte.encode(t or "", add_special_tokens=False).ids
    rows = registry.queries()["op3_best_fit_packing"](spark, MEDIUM).collect()
    texts = [(r[0], r[1]) for r in registry.documents(spark, MEDIUM, "doc_id", "text").collect()]
    bins = check_pieces(rows, texts, encode)
    assert bins <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


Tokenizer_byte = Tokenizer.from_file(BYTE)


def test_packing_odd_and_empty(spark, odd_documents, no_documents):
    docs = odd_documents.withColumnRenamed("n_chars", "offset").repartition(5)
    out = packing.pack(packing.cut_documents(docs, BYTE))
    rows = out.collect()
    check_pieces(rows, [(r[0], r[1]) for r in odd_documents.collect()], lambda t: Tokenizer_byte.encode(t or "", add_special_tokens=False).ids)
    assert packing.pack(packing.cut_documents(no_documents, BYTE)).count() == 0


def test_pieces_carry_ids(spark, odd_documents):
    for r in packing.cut_documents(odd_documents, BYTE, 64, 2, ids=True).collect():
        assert len(r["ids"]) == r["length"] and brute.crc(r["ids"]) == r["ids_crc32"]


def test_tree_merges_underfull_bins(spark):
    items = spark.range(64, numPartitions=64).selectExpr("id", "cast(16 as long) length")
    rows = packing.pack(items, 1024).collect()
    assert len(rows) == 64 and len({r["sequence_id"] for r in rows}) == 1
    assert sorted(r["offset"] for r in rows) == list(range(0, 1024, 16))


def test_pack_keeps_items_without_length(spark):
    items = spark.createDataFrame([(1, None), (2, 0), (3, 5), (4, 2000), (5, 1024)], "id int, length long")
    rows = {r["id"]: r for r in packing.pack(items, 1024).collect()}
    assert len(rows) == 5 and rows[4]["sequence_id"] not in {rows[k]["sequence_id"] for k in (3, 5)}


def _expect(docs):
    encode = Tokenizer.from_file(WORDS).encode
    at, out = 0, []
    for d, t in docs:
        ids = encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), brute.crc(ids)))
        at += len(ids)
    return out


def test_token_files_query(spark):
    rows = registry.queries()["op4_token_files"](spark, MEDIUM).collect()
    texts = sorted((r[0], r[1]) for r in registry.documents(spark, MEDIUM, "doc_id", "text").collect())
    assert sorted(map(tuple, rows)) == _expect(texts)


def test_token_files_odd_and_empty(spark, tmp_path, odd_documents, no_documents):
    token_files.write_token_files(odd_documents.repartition(4), str(tmp_path / "a"), WORDS, segment=5000)
    rows = token_files.decode_documents(spark, str(tmp_path / "a"), ids=True).collect()
    texts = sorted([(r[0], r[1]) for r in odd_documents.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert sorted((tuple(r)[:4] for r in rows), key=lambda r: r[1]) == _expect(texts)
    assert all(brute.crc(r["ids"]) == r["ids_crc32"] for r in rows)
    token_files.write_token_files(no_documents, str(tmp_path / "b"), WORDS)
    assert token_files.decode_documents(spark, str(tmp_path / "b")).count() == 0


def test_grammar_compresses_and_gives_random_access(spark, tmp_path):
    docs = spark.range(300).selectExpr("id doc_id", "repeat(concat('the cat sat on the mat ', id % 7, ' '), 20) text")
    token_files.write_token_files(docs.coalesce(1), str(tmp_path / "a"), WORDS, rounds=6, each=64, least=4)
    rows = [r.asDict() for r in spark.read.parquet(str(tmp_path / "a")).collect()]
    for row in rows:
        part = token_files.Segment(row)
        flat = part.expand(part.symbols)
        assert len(part.symbols) < len(flat) / 4 and len(flat) == row["n_tokens"]
        ends = np.cumsum(part.token_counts)
        for i in (0, len(ends) // 2, len(ends) - 1):
            assert part.document(i).tolist() == flat[ends[i] - part.token_counts[i] : ends[i]].tolist()
        for a, b in ((0, 5), (17, 1000), (len(flat) - 3, len(flat)), (4, 4)):
            assert part.between(a, b).tolist() == flat[a:b].tolist()


def test_pairs_are_replaced_until_none_pays():
    rng = np.random.default_rng(6)
    passage, twins = np.arange(100, 160), np.full(33, 7)
    docs = [np.concatenate((rng.integers(200, 40_000, 50), passage, rng.integers(200, 40_000, 50), twins)) for _ in range(9)]
    flat = np.concatenate(docs).astype(np.uint32)
    last = np.zeros(len(flat), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, ends, rules = token_files.replace_pairs(flat, last, 49_152)
    lengths = token_files.rule_lengths(rules, 49_152)
    assert lengths.max() >= 60 and len(symbols) < 9 * 110  # a passage seen nine times is one symbol
    left = Counter(zip(symbols[:-1][~ends[:-1]].tolist(), symbols[1:][~ends[:-1]].tolist()))
    assert max(left.values()) < 7  # seven symbols of two bytes pay for a rule of twelve
    grown = {}
    for i, pair in enumerate(rules.tolist()):
        grown[49_152 + i] = [x for y in pair for x in grown.get(y, [y])]
    assert [x for y in symbols.tolist() for x in grown.get(y, [y])] == flat.tolist() and ends.sum() == 9


def test_packing_columns_with_the_names_of_helpers(spark):
    rows = [(i, i % 90 + 1, "a", "b", "c", "d") for i in range(3000)]
    pieces = spark.createDataFrame(rows, "id long, length long, _bin string, _into string, _shift string, _room string")
    got = packing.pack(pieces.repartition(7), 100)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"] and got.count() == 3000
    assert got.select("_bin", "_into", "_shift", "_room").distinct().collect() == [("a", "b", "c", "d")]
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 100").isEmpty()
