"""Every query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from oracle import database, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    top = entry.entry(spark).select("risk_score").limit(200).collect()
    scores = [r.risk_score for r in top]
    assert scores and scores == sorted(scores, reverse=True)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
