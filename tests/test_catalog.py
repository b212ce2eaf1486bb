"""Every registered query against its oracle, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from jurisindex.catalog import QUERIES
from tests.oracle import compare, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql()[name]
    assert compare(df, sql, connection) is None
    assert connection.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 0, "no row can tell anything"


@pytest.mark.parametrize("name", ["store_search", "faceted_search", "faceted_count"])
def test_searches_read_the_store(name):
    """One row for each link: the searches run on what the upsert leaves, not on all versions."""
    sql = entry.oracle_sql()[name]
    assert ", store AS (" in sql and "FROM store WHERE" in sql


def test_entry(spark):
    found = entry.entry(spark)
    assert len(found.columns) == 9 and found.count() > 0
