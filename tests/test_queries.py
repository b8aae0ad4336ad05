"""Every named query against its SQL on DuckDB, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, duck  # noqa: E402

QUERIES, ORACLES = entry.plans.QUERIES, entry.plans.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    diff, rows = compare(spark, con, sf, QUERIES[name], ORACLES[name])
    assert diff is None
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["db_id", "path", "pos", "value"]
