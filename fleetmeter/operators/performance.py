"""Latency, queueing, failure and event reports. ``hq``/``he`` are the hourly query and event rollups."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import (
    ADAPTIVE, RESUME_EVENTS, SUSPEND_EVENTS, first_match, load_window, matches_any, pool_type,
)
from ..functions.measures import count_where, ratio, rounded, seconds, total
from ..functions.quantiles import percentile_of_large_groups
from ..functions.times import hour_of, last, minutes_between, since_midnight
from ..sources.readers import warehouse_filter

# Query-tag patterns of the workload classes, in matching order.
AGENT_PATTERNS = ["%cortex%", "%agent%"]
ML_PATTERNS = ["%ml%", "%scoring%"]
WORKLOAD_RULES = [("AGENT", AGENT_PATTERNS), ("ML_BATCH", ML_PATTERNS)]
ETL_PATTERN = "%etl_pipeline%"


def load_sums() -> dict[str, Column]:
    """Sums that ride along with an exact percentile."""
    return {
        "_rows": F.count(F.lit(1)),
        "_timed": F.count("total_elapsed_time"),
        "_elapsed": F.sum("total_elapsed_time"),
        "_queue": F.sum("queued_overload_time"),
        "_queue_rows": F.count("queued_overload_time"),
    }


def _recent(queries: DataFrame, as_of: str | datetime, names: Iterable[str] | None, **span: float) -> DataFrame:
    rows = queries.filter(last(queries, "start_time", as_of, **span) & F.col("warehouse_name").isNotNull())
    return warehouse_filter(rows, names)


def query_performance(hq: DataFrame, names: Iterable[str] | DataFrame | None = None) -> DataFrame:
    return (
        warehouse_filter(hq, names)
        .withColumn("avg_latency_sec", seconds(F.col("avg_elapsed_ms")))
        .withColumn("p95_latency_sec", seconds(F.col("p95_elapsed_ms")))
        .withColumn("total_queue_sec", seconds(F.col("total_queue_ms")))
    )


def performance_kpis(perf: DataFrame, weighted: bool = False) -> DataFrame:
    """One row. The latency figures are plain means over hours; ``weighted`` weighs hours by query count."""

    def over_hours(column: str) -> Column:
        if not weighted:
            return F.avg(column)
        weight = F.when(F.col(column).isNotNull(), F.col("query_count"))
        return ratio(F.sum(F.col(column) * weight), F.sum(weight))

    return perf.agg(
        over_hours("avg_latency_sec").alias("avg_latency_sec"),
        over_hours("p95_latency_sec").alias("p95_latency_sec"),
        F.coalesce(F.sum("query_count"), F.lit(0)).alias("total_queries"),
        F.coalesce(F.sum("queued_queries"), F.lit(0)).alias("total_queued"),
    )


def performance_by_pool_type(queries: DataFrame, as_of: str | datetime, days: int = 14) -> DataFrame:
    """Per end date: the look-back applies to the start, so a query crossing midnight may fall on the next day."""
    rows = queries.filter(
        since_midnight(queries, "start_time", as_of, days) & F.col("warehouse_name").isNotNull()
    )
    return rows.groupBy(
        F.to_date("end_time").alias("query_date"), "warehouse_name", pool_type().alias("warehouse_type")
    ).agg(
        F.count(F.lit(1)).alias("query_count"),
        seconds(F.avg("total_elapsed_time")).alias("avg_latency_sec"),
        seconds(F.avg("execution_time")).alias("avg_exec_sec"),
        seconds(F.avg("queued_overload_time")).alias("avg_queue_sec"),
        seconds(F.avg("queued_provisioning_time")).alias("avg_provisioning_sec"),
    )


def adaptive_vs_standard(queries: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    """Daily averages by pool type, for warehouses that ran at least one adaptive query in the window.

    One scan: the warehouses are picked from the daily rows (at most two per day), not from the queries.
    """
    rows = queries.filter(
        since_midnight(queries, "start_time", as_of, days) & F.col("warehouse_name").isNotNull()
    )
    daily = rows.groupBy(
        F.to_date("end_time").alias("ds"), "warehouse_name", pool_type().alias("warehouse_type")
    ).agg(
        F.avg("total_elapsed_time").alias("avg_query_time_ms"),
        F.avg("execution_time").alias("avg_exec_time_ms"),
        F.avg("queued_overload_time").alias("avg_queued_overload_time_ms"),
        F.avg("queued_provisioning_time").alias("avg_queued_provisioning_time_ms"),
        F.count(F.lit(1)).alias("query_count"),
    )
    any_adaptive = F.max(F.col("warehouse_type") == ADAPTIVE).over(Window.partitionBy("warehouse_name"))
    return (
        daily.withColumn("_converted", any_adaptive)
        .filter(F.col("_converted"))
        .drop("_converted")
        .orderBy("ds", "warehouse_name")
    )


def latency_by_pool_type(
    queries: DataFrame, as_of: str | datetime, days: int = 7, exact: bool = True, accuracy: int = 10000
) -> DataFrame:
    """Two rows at most, each over a large part of the table.

    The exact 95th percentile comes from value counts; ``exact=False`` uses the sketch with error 1/``accuracy``.
    """
    rows = queries.filter(
        last(queries, "start_time", as_of, days=days)
        & (F.col("execution_status") == "SUCCESS")
        & F.col("warehouse_name").isNotNull()
    ).select(pool_type().alias("wh_type"), "total_elapsed_time", "queued_overload_time")
    if not exact:
        p95 = F.percentile_approx("total_elapsed_time", 0.95, accuracy)
        found = rows.groupBy("wh_type").agg(p95.cast("double").alias("_p95"), *[c.alias(n) for n, c in load_sums().items()])
    else:
        found = percentile_of_large_groups(rows, ["wh_type"], "total_elapsed_time", 0.95, "_p95", load_sums())
    return found.select(
        "wh_type",
        F.col("_rows").alias("total_queries"),
        rounded(seconds(ratio(F.col("_elapsed"), F.col("_timed"))), 2).alias("avg_latency_sec"),
        rounded(seconds(F.col("_p95")), 2).alias("p95_latency_sec"),
        rounded(seconds(ratio(F.col("_queue"), F.col("_queue_rows"))), 2).alias("avg_queue_sec"),
    )


def queue_load_analysis(load: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    rows = load.filter(last(load, "start_time", as_of, days=days))
    return (
        rows.groupBy(hour_of(rows).alias("hour_ts"), "warehouse_name")
        .agg(
            F.avg("avg_running").alias("avg_running_queries"),
            F.avg("avg_queued_load").alias("avg_queued_queries"),
            F.avg("avg_blocked").alias("avg_blocked_queries"),
        )
        .filter(F.col("avg_queued_queries") > 0)
        .orderBy(F.desc("avg_queued_queries"), "hour_ts", "warehouse_name")
    )


def failure_detail(
    queries: DataFrame, as_of: str | datetime, days: int = 30, names: Iterable[str] | None = None, n: int = 20
) -> DataFrame:
    rows = _recent(queries, as_of, names, days=days).filter(F.col("execution_status") == "FAIL")
    return (
        rows.groupBy("warehouse_name", "error_code", "error_message")
        .agg(
            F.count(F.lit(1)).alias("failed_queries"),
            rounded(F.sum("total_elapsed_time") / F.lit(3600000.0), 4).alias("wasted_hours"),
        )
        .orderBy(F.desc("failed_queries"), "warehouse_name", "error_code", "error_message")
        .limit(n)
    )


def events_summary(he: DataFrame, names: Iterable[str] | DataFrame | None = None) -> DataFrame:
    return (
        warehouse_filter(he, names)
        .groupBy("warehouse_name", "event_name")
        .agg(F.sum("event_count").alias("event_count"))
        .orderBy("warehouse_name", F.desc("event_count"), "event_name")
    )


def suspend_resume(he: DataFrame, names: Iterable[str] | DataFrame | None = None) -> DataFrame:
    def events(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("event_count")).otherwise(0))

    name = F.col("event_name")
    return (
        warehouse_filter(he, names)
        .groupBy("warehouse_name")
        .agg(
            events(name.isin(*SUSPEND_EVENTS)).alias("suspends"),
            events(name.isin(*RESUME_EVENTS)).alias("resumes"),
            events(name.rlike("(?i)SCALE")).alias("scaling_events"),
        )
        .orderBy(F.desc("resumes"), "warehouse_name")
    )


def concurrency_pattern(
    queries: DataFrame, as_of: str | datetime, days: int = 7, names: Iterable[str] | None = None, exact: bool = True
) -> DataFrame:
    rows = _recent(queries, as_of, names, days=days)
    users = F.count_distinct("user_name") if exact else F.approx_count_distinct("user_name")
    return (
        rows.groupBy("warehouse_name", hour_of(rows).alias("hour_ts"))
        .agg(
            users.alias("active_users"),
            F.count(F.lit(1)).alias("queries"),
            seconds(F.avg("total_elapsed_time")).alias("avg_sec"),
            seconds(F.max("queued_overload_time")).alias("max_queue_sec"),
        )
        .withColumn("hour_of_day", F.hour("hour_ts"))
    )


def peak_offpeak(
    queries: DataFrame, as_of: str | datetime, days: int = 14, names: Iterable[str] | None = None
) -> DataFrame:
    rows = _recent(queries, as_of, names, days=days)
    return rows.groupBy("warehouse_name", load_window("start_time").alias("period")).agg(
        F.count(F.lit(1)).alias("queries"),
        total("credits_used_cloud_services").alias("credits"),
        seconds(F.avg("queued_overload_time")).alias("avg_queue_sec"),
    )


def workload_variability(
    queries: DataFrame, as_of: str | datetime, days: int = 7, names: Iterable[str] | None = None
) -> DataFrame:
    rows = _recent(queries, as_of, names, days=days)
    return rows.groupBy("warehouse_name", hour_of(rows).alias("hour_ts")).agg(
        F.count(F.lit(1)).alias("queries"),
        seconds(F.avg("total_elapsed_time")).alias("avg_sec"),
        seconds(F.stddev_samp("total_elapsed_time")).alias("stddev_sec"),
        count_where(F.col("queued_overload_time") > 0).alias("queued"),
    )


def tag_share(
    queries: DataFrame,
    as_of: str | datetime,
    patterns: list[str] | None = None,
    days: int = 7,
    names: Iterable[str] | None = None,
) -> DataFrame:
    """How many queries carry a tag that matches any of ``patterns``."""
    tagged = matches_any("query_tag", patterns or AGENT_PATTERNS)
    return (
        _recent(queries, as_of, names, days=days)
        .groupBy("warehouse_name")
        .agg(F.count(F.lit(1)).alias("total_queries"), count_where(tagged).alias("agent_queries"))
        .withColumn("agent_pct", rounded(ratio(F.col("agent_queries"), F.col("total_queries")) * 100, 1))
    )


def workload_classes(
    queries: DataFrame,
    as_of: str | datetime,
    days: int = 1,
    rules: list[tuple[str, list[str]]] | None = None,
    names: Iterable[str] | None = None,
) -> DataFrame:
    """Latency by workload class; the first matching rule wins, untagged queries are OTHER.

    A warehouse and class may hold a large part of the table, so the percentile works from value counts.
    """
    rows = _recent(queries, as_of, names, days=days).select(
        "warehouse_name",
        first_match("query_tag", rules or WORKLOAD_RULES, "OTHER").alias("workload_type"),
        "total_elapsed_time",
        "queued_overload_time",
    )
    keys = ["warehouse_name", "workload_type"]
    found = percentile_of_large_groups(rows, keys, "total_elapsed_time", 0.95, "_p95", load_sums())
    return found.select(
        *keys,
        F.col("_rows").alias("queries"),
        seconds(ratio(F.col("_elapsed"), F.col("_timed"))).alias("avg_latency_sec"),
        seconds(F.col("_p95")).alias("p95_sec"),
        seconds(F.col("_queue")).alias("total_queue_sec"),
    )


def pipeline_duration(
    queries: DataFrame,
    as_of: str | datetime,
    pattern: str = ETL_PATTERN,
    days: int = 14,
    names: Iterable[str] | None = None,
) -> DataFrame:
    rows = _recent(queries, as_of, names, days=days).filter(F.col("query_tag").like(pattern))
    return (
        rows.groupBy("warehouse_name", F.to_date("start_time").alias("run_date"))
        .agg(F.min("start_time").alias("pipeline_start"), F.max("end_time").alias("pipeline_end"))
        .withColumn("duration_min", minutes_between(F.col("pipeline_start"), F.col("pipeline_end")))
    )


def slow_queries(
    queries: DataFrame, as_of: str | datetime, names: Iterable[str] | None = None, days: int = 3, n: int = 20
) -> DataFrame:
    return (
        _recent(queries, as_of, names, days=days)
        .orderBy(F.desc_nulls_first("total_elapsed_time"), "query_id")
        .limit(n)
        .select(
            "query_id",
            F.substring("query_text", 1, 100).alias("query_preview"),
            seconds(F.col("total_elapsed_time")).alias("elapsed_sec"),
            seconds(F.col("compilation_time")).alias("compile_sec"),
            seconds(F.col("execution_time")).alias("exec_sec"),
        )
    )


def recent_performance(
    queries: DataFrame, as_of: str | datetime, hours: int = 1, names: Iterable[str] | None = None
) -> DataFrame:
    return (
        _recent(queries, as_of, names, hours=hours)
        .groupBy("warehouse_name")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            seconds(F.avg("total_elapsed_time")).alias("avg_sec"),
            seconds(F.max("queued_overload_time")).alias("max_queue_sec"),
        )
    )


def perf_summary(hq: DataFrame, n: int | None = None) -> DataFrame:
    """Mean hourly p95 and queue time per warehouse, in name order; ``n`` keeps the first names only."""
    summary = (
        hq.groupBy("warehouse_name")
        .agg(
            seconds(F.avg("p95_elapsed_ms")).alias("p95_sec"),
            seconds(F.avg("total_queue_ms")).alias("queue_sec"),
        )
        .orderBy("warehouse_name")
    )
    return summary if n is None else summary.limit(n)
