"""Physical plans: what must not appear, and what must reach the scan."""

import re

import pytest

from fleetmeter.plans import catalog, views
from fleetmeter.operators import comparison

WRITING = ("stream", "merge", "append", "seed", "incremental", "retention", "late", "source_resolver_staged", "staged")
PLAIN = sorted(n for n in catalog.queries() if not n.startswith(WRITING))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_plan_is_distributed(spark, sf, name):
    """No cross or nested-loop join, no Python, and a single-partition exchange only behind a partial aggregate."""
    text = plan(catalog.queries()[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text
    for line, below in zip(text.splitlines(), text.splitlines()[1:]):
        if "Exchange SinglePartition" in line:
            assert "Aggregate(key" in below and ("partial_" in below or "functions=[]" in below), below


def test_no_forced_broadcast(spark, sf):
    """With broadcasting off, the join to the log still runs, spread over a salt."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    on = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        df = comparison.credit_comparison(views.metering(spark, sf), views.migration_log(spark, sf))
        assert "Broadcast" not in plan(df)
        assert re.search(r"SortMergeJoin \[warehouse_name#\d+, _salt", plan(df))
        without = sorted(map(tuple, df.collect()))
    finally:
        for k, v in on.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    df = comparison.credit_comparison(views.metering(spark, sf), views.migration_log(spark, sf))
    assert sorted(map(tuple, df.collect())) == without


def test_look_back_and_columns_reach_the_scan(spark, sf):
    text = plan(catalog.queries()["hourly_metering"](spark, sf))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-01T00:00)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text


@pytest.mark.parametrize(
    "name",
    ["credit_comparison", "performance_comparison", "daily_savings", "monthly_savings_report", "before_after", "before_after_kpis",
     "before_after_long", "latency_regression_alert", "cross_view_consistency"],
)
def test_scans_around_changes_are_bounded(spark, sf, name):
    assert "GreaterThanOrEqual(ts," in plan(catalog.queries()[name](spark, sf))


@pytest.mark.parametrize("name", ["detect_sla_breaches", "calendar_suppression", "blackout_violations"])
def test_patterns_and_windows_join_by_equality(spark, sf, name):
    text = plan(catalog.queries()[name](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Join" in text and "collect_list" not in text


@pytest.mark.parametrize(
    "name,scans", [("sla_latency_breaches", 2), ("detect_sla_breaches", 2), ("adaptive_vs_standard", 1), ("invariant_checks", 1), ("latency_before_after", 1), ("daily_savings", 2)]
)
def test_scans_per_report(spark, sf, name, scans):
    assert plan(catalog.queries()[name](spark, sf)).count("FileScan parquet") == scans


@pytest.mark.parametrize("name,scans", [("latency_by_pool_type", 1), ("workload_classes", 1), ("request_transitions", 2)])
def test_scans_when_run(spark, sf, name, scans):
    """An exchange that is used twice is written once, which only the plan that ran shows."""
    df = catalog.queries()[name](spark, sf)
    df.collect()
    assert plan(df).split("Initial Plan")[0].count("FileScan parquet") == scans


def test_hot_key_is_spread_over_tasks(spark):
    """One key holds every row, broadcasting is off: no task gets more than a fraction of it."""
    from pyspark.sql import functions as F

    from fleetmeter.functions.joins import join_spread

    off = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    on = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        facts = spark.range(16000).select(F.lit("HOT").alias("warehouse_name"), "id")
        dim = spark.createDataFrame([("HOT", 1)], "warehouse_name STRING, x INT")
        joined = join_spread(facts, dim, ["warehouse_name"], "id")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 16000
        assert max(sizes) < 16000 / 3
        assert join_spread(facts, dim.filter("x > 1"), ["warehouse_name"], "id", "left").count() == 16000
    finally:
        for k, v in on.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
