"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, database
from tidewheel.plans.oracles import ORACLES
from tidewheel.plans.queries import QUERIES

@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_counts_every_line(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["n"] for r in rows) == 6000
