"""The pipeline, stage by stage, against brute-force versions."""

from collections import Counter, defaultdict

import brute
import pytest
from brute import MEDIUM
from test_jaccard import brute_components
from test_mixing import brute_targets
from test_secrets import base
from test_tokens import Tokenizer_byte, check_pieces

import corpus_pipeline as cp


def encode(text):
    return Tokenizer_byte.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(cp.settle(stage(spark, out[-1], MEDIUM), name.replace(" ", "-")))
    return [d.collect() for d in out]


def test_every_stage_but_the_last_has_the_columns_of_documents(staged):
    for rows in staged[:-1]:
        assert rows[0].asDict().keys() == staged[0][0].asDict().keys()


def test_quality(staged):
    before, after = staged[0], {r["doc_id"] for r in staged[1]}
    for r in before:
        n, chars, symbols, dups, _, failed = brute.quality(r["text"])
        lines = len([x for x in r["text"].split("\n") if brute.WORD.search(x)])
        bad = failed or 10 * symbols > 3 * n or 100 * dups > 35 * lines or not 2 * n <= chars <= 25 * n
        assert (r["doc_id"] in after) == (not bad)


def test_near_duplicates(staged):
    comps = brute_components([(r["doc_id"], r["text"]) for r in staged[1]], 5, 80)
    assert sorted(r["doc_id"] for r in staged[2]) == sorted({c for _, _, c in comps})
    assert len(staged[2]) < len(staged[1])


def test_secrets(staged):
    before, after = {r["doc_id"]: r for r in staged[2]}, {r["doc_id"]: r for r in staged[3]}
    assert set(before) == set(after) and any(base(r["text"]) for r in before.values())
    for d, r in before.items():
        assert not base(after[d]["text"])
        assert base(r["text"]) or after[d]["text"] == r["text"]
        assert after[d]["n_chars"] == len(after[d]["text"])


def test_mixing(staged):
    before, after = {r["doc_id"]: r for r in staged[3]}, Counter(r["doc_id"] for r in staged[4])
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, r in before.items():
        n = len(brute.words(r["text"]))
        size[r["source"]] += n
        taken[r["source"]] += n * after[d]
        largest[r["source"]] = max(largest[r["source"]], n)
    assert max(after.values()) == 2
    for s, target in brute_targets(size).items():
        assert abs(taken[s] - target) <= largest[s]
    assert all(tuple(r) == tuple(before[r["doc_id"]]) for r in staged[4])


def test_packing(staged):
    check_pieces(staged[5], [(r["doc_id"], r["text"]) for r in staged[4]], encode)


def test_run_equals_the_stages(spark, staged):
    pick = lambda rows: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert pick(cp.run(spark, MEDIUM).collect()) == pick(staged[5])


def test_stages_take_odd_and_empty_tables(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, MEDIUM)
            assert k == len(cp.STAGES) - 1 or out.columns == docs.columns
            assert out.count() >= 0
    kept = cp.near_duplicate_stage(spark, odd_documents, MEDIUM).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([0, 1, 2, 3, None, 5, 7, 8, 9, 10, -3])
    extra = odd_documents.selectExpr("*", "1 kept", "2 findings", "3 size", "4 _h")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, extra, MEDIUM).columns == extra.columns
