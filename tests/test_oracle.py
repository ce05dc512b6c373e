"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from checks.compare import connect, difference
from checks.oracle import ORACLES
from checks.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert difference(got, duck.execute(ORACLES[name]).df()) is None
