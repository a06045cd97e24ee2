"""Every query against its checking SQL on the smallest tables."""

import pytest
from compare import compare, connect
from conftest import SMALL

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, con, key):
    why, _ = compare(QUERIES[key](spark, SMALL), con, ORACLES[key])
    assert not why, why


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"repo_id", "risk_score", "verdict", "n_findings"}


def test_every_query_is_known():
    assert set(ORACLES) <= set(QUERIES)
