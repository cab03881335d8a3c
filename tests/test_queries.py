"""Every registered query against its SQL equivalent, on the whole tables."""

import pytest
from compare import MEDIUM, differences, duck

import __spark_entry__ as entry
from tablevault.plans import oracles, registry

# Those of the library; tests/llm has the tests of the training-data operators.
QUERIES, ORACLES = registry.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(MEDIUM)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 14 and all(r["files"] >= 1 for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, MEDIUM), con, ORACLES[name]) is None
