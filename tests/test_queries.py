"""Every registered query against its SQL equivalent, and the entry-point contract."""

import inspect

import pytest
from compare import difference, duck

import __spark_entry__ as entry_point
from fleetmeter.plans import catalog

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, con, name):
    assert name in ORACLES
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0
    assert df.columns == [
        "warehouse_name", "total_credits", "idle_credits", "total_hours", "idle_hours", "idle_pct", "wasted_usd",
    ]


def test_comparison_notices_a_difference(spark, con):
    assert difference(spark.sql("SELECT 1 AS a"), con, "SELECT 2 AS a") is not None
    assert difference(spark.sql("SELECT 1.5D AS a"), con, "SELECT 1.5::DOUBLE AS b") is not None
    assert difference(spark.sql("SELECT 1.5D AS a"), con, "SELECT 1.5::DOUBLE AS a") is None


def test_entry_point_lists_every_query():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_callables_take_session_and_folder():
    for job in entry_point.queries().values():
        assert len(inspect.signature(job).parameters) == 2
