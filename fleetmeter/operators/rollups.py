"""Hourly rollups: the shared base of nearly every report.

``*_measures`` are shared by batch and stream. ``*_by_hour`` aggregate whatever rows they are given (the incremental
jobs use them); the functions with ``as_of`` add the look-back. Sums, counts and percentiles all combine map-side, so a hot warehouse
reaches the shuffle as one partial row per hour and task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import COMPLEX_SIZES
from ..functions.measures import count_where, mean, seconds, total
from ..functions.times import hour_of, last

SUCCESS = "SUCCESS"
FAIL = "FAIL"


def query_measures() -> list[Column]:
    """The nine per-hour measures; latency figures cover successful queries only.

    The exact percentile keeps value counts. Latencies are whole milliseconds, so the buffer of an hour is bounded by
    their distinct values, not by its queries, and partial buffers merge map-side.
    """
    ok = F.col("execution_status") == SUCCESS
    failed = F.col("execution_status") == FAIL
    elapsed = F.when(ok, F.col("total_elapsed_time"))
    return [
        count_where(ok).alias("query_count"),
        F.avg(elapsed).alias("avg_elapsed_ms"),
        F.percentile(elapsed, F.lit(0.95)).alias("p95_elapsed_ms"),
        F.sum(F.when(ok, F.col("queued_overload_time")).otherwise(0)).cast("double").alias("total_queue_ms"),
        count_where(ok & (F.col("queued_overload_time") > 0)).alias("queued_queries"),
        count_where(failed).alias("failed_queries"),
        F.sum(F.when(failed, F.col("total_elapsed_time")).otherwise(0)).cast("double").alias("total_elapsed_failed_ms"),
        count_where(ok & F.col("warehouse_size").isin(*COMPLEX_SIZES)).alias("complex_queries"),
        F.stddev_samp(elapsed).alias("latency_stddev"),
    ]


def metering_measures() -> list[Column]:
    return [total("credits_used").alias("credits")]


def event_measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("event_count")]


def metering_by_hour(metering: DataFrame) -> DataFrame:
    return metering.groupBy("warehouse_name", hour_of(metering).alias("hour_ts")).agg(*metering_measures())


def queries_by_hour(queries: DataFrame) -> DataFrame:
    return (
        queries.filter(F.col("warehouse_name").isNotNull())
        .groupBy("warehouse_name", hour_of(queries).alias("hour_ts"))
        .agg(*query_measures())
    )


def events_by_hour(events: DataFrame) -> DataFrame:
    return events.groupBy("warehouse_name", hour_of(events, "timestamp").alias("hour_ts"), "event_name").agg(
        *event_measures()
    )


def cost_centers(tags: DataFrame) -> DataFrame:
    """Cost-centre tags of warehouses. The object kind is called ``domain`` or ``object_type``."""
    kind = "domain" if "domain" in tags.columns else "object_type"
    return tags.filter((F.col(kind) == "WAREHOUSE") & (F.col("tag_name") == "COST_CENTER")).select(
        F.col("object_name").alias("warehouse_name"), "tag_value"
    )


def with_cost_center(hourly: DataFrame, tags: DataFrame) -> DataFrame:
    """Add one ``tag_cost_center`` per warehouse (the greatest when several are set).

    The tag joins the finished rollup, so several tags on one warehouse do not multiply its credits.
    """
    one = cost_centers(tags).groupBy("warehouse_name").agg(F.max("tag_value").alias("tag_cost_center"))
    return hourly.join(one, "warehouse_name", "left")


def hourly_metering(metering: DataFrame, as_of: str | datetime, days_back: int = 30) -> DataFrame:
    return metering_by_hour(metering.filter(last(metering, "start_time", as_of, days=days_back)))


def hourly_queries(queries: DataFrame, as_of: str | datetime, days_back: int = 30) -> DataFrame:
    return queries_by_hour(queries.filter(last(queries, "start_time", as_of, days=days_back)))


def hourly_events(events: DataFrame, as_of: str | datetime, days_back: int = 30) -> DataFrame:
    return events_by_hour(events.filter(last(events, "timestamp", as_of, days=days_back)))


def tagged_hourly_metering(
    metering: DataFrame, tags: DataFrame, as_of: str | datetime, days_back: int = 30
) -> DataFrame:
    return with_cost_center(hourly_metering(metering, as_of, days_back), tags)


def hourly_query_metrics(queries: DataFrame, as_of: str | datetime, lookback: int = 14) -> DataFrame:
    """Successful queries only."""
    rows = queries.filter(
        last(queries, "start_time", as_of, days=lookback)
        & F.col("warehouse_name").isNotNull()
        & (F.col("execution_status") == SUCCESS)
    )
    return rows.groupBy("warehouse_name", hour_of(queries).alias("hour_ts")).agg(
        F.count(F.lit(1)).alias("query_count"),
        seconds(mean("total_elapsed_time")).alias("avg_duration_sec"),
        seconds(F.max("total_elapsed_time")).alias("max_duration_sec"),
        seconds(F.sum("queued_overload_time")).alias("total_queue_sec"),
        count_where(F.col("queued_overload_time") > 0).alias("queued_queries"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Table name and row count, one row per table."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result
