"""Every query with a SQL counterpart gives the same rows as DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 0


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_as_sql(spark, con, key):
    problem, rows = compare(spark, con, QUERIES[key], ORACLES[key], SF)
    assert problem == ""
    assert rows > 0


@pytest.mark.parametrize("key", sorted(k for k in set(QUERIES) - set(ORACLES) if k != "pipeline" and not k.startswith("op")))
def test_others_run_to_the_last_row(spark, key):
    QUERIES[key](spark, SF).write.format("noop").mode("overwrite").save()
