"""Every registered query against its SQL, on the smallest given tables."""

import pytest

import __spark_entry__ as driver
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["seq_id", "frame", "low", "high", "scale", "bias", "band", "bin", "n"]
    assert result.agg({"n": "sum"}).first()[0] == 500 * 64
