"""Every query with SQL agrees with it on the smallest scale."""

import pytest
from oracle import compare, connect

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name], con) == ""


def test_entry_runs(spark):
    assert driver.entry(spark).count() == 11


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
