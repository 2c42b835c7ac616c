"""Before/after reports around a pool-type change.

Three notions of "when it changed" exist and stay apart: the first MIGRATE in the log (``migration_dates``), the latest
MIGRATE (``lifecycle.latest_migrations``) and the first conversion event (``conversion_dates``).

Reports that take ``stored`` (a stored hourly table) read it for all whole hours, and raw rows only for the hours that hold a
change or an end of its window, and for those the table doesn't hold for good (``functions/hours.py``).
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hours import split_at
from ..functions.joins import join_per_warehouse
from ..functions.labels import period
from ..functions.measures import count_where, ratio, rounded, seconds, total
from ..functions.times import between, day_of, hour_of, instant, last, moment
from ..session import shared_dir
from ..sources.readers import warehouse_filter


def migration_dates(log: DataFrame) -> DataFrame:
    return (
        log.filter(F.col("action") == "MIGRATE").groupBy("warehouse_name").agg(F.min("migrated_at").alias("migration_ts"))
    )


def conversion_dates(events: DataFrame) -> DataFrame:
    return (
        events.filter((F.col("event_name") == "CONVERT_WAREHOUSE") & (F.col("event_reason") == "CONVERT_TO_ADAPTIVE"))
        .groupBy("warehouse_name")
        .agg(F.min("timestamp").alias("migration_date"))
    )


def around_changes(
    facts: DataFrame, column: str, dates: DataFrame, change: str, before: timedelta, after: timedelta | None = None
) -> DataFrame:
    """Rows of ``facts`` from ``before`` the earliest change on (and up to ``after`` the latest one).

    The two times are read from the small table of changes, so that they reach the scan of the facts as constants.
    """
    first, final = dates.agg(
        F.min(F.col(change).cast("string")).alias("first"), F.max(F.col(change).cast("string")).alias("final")
    ).first()
    if first is None:
        return facts.filter(F.lit(False))
    rows = facts.filter(F.col(column) >= moment(facts, column, instant(first) - before))
    return rows if after is None else rows.filter(F.col(column) <= moment(facts, column, instant(final) + after))


def metering_around(
    metering: DataFrame,
    dates: DataFrame,
    change: str,
    before: timedelta,
    after: timedelta | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Metered rows of changed warehouses near a change, joined with it; with ``stored`` a whole hour is one row."""
    near = around_changes(metering, "start_time", dates, change, before, after)
    if stored is None:
        return join_per_warehouse(near, dates, spread_by="start_time")
    shared_dir(metering.sparkSession)
    dates = dates.checkpoint(eager=True)  # one line per changed warehouse, read five times from here on
    at = F.col(change)
    edges = [at - F.lit(before), at] + ([] if after is None else [at + F.lit(after)])
    split = split_at(stored, metering, "start_time", dates, edges)
    rest = join_per_warehouse(near.filter(split.near), dates, spread_by="start_time").filter(split.rest)
    hours = around_changes(stored, "hour_ts", dates, change, before, after).join(dates, "warehouse_name").filter(split.whole)
    kinds = metering.schema
    return rest.select("warehouse_name", "start_time", "credits_used", change).unionByName(
        hours.select(
            "warehouse_name", F.col("hour_ts").cast(kinds["start_time"].dataType).alias("start_time"),
            # an hour's credits are an exact sum, so they have the raw type's digits
            F.col("credits").cast(kinds["credits_used"].dataType).alias("credits_used"), change,
        )
    )


def credit_comparison(
    metering: DataFrame, log: DataFrame, days_before: int = 14, stored: DataFrame | None = None
) -> DataFrame:
    """Hourly credits labelled PRE or POST; a change inside an hour gives that hour one row of each."""
    dates, span = migration_dates(log), timedelta(days=days_before)
    rows = metering_around(metering, dates, "migration_ts", span, stored=stored).filter(
        F.col("start_time") >= F.col("migration_ts") - F.lit(span)
    )
    return rows.groupBy(
        "warehouse_name", hour_of(metering).alias("hour_ts"), period("start_time", "migration_ts").alias("period")
    ).agg(total("credits_used").alias("credits"))


def performance_comparison(
    queries: DataFrame, log: DataFrame, days_before: int = 14, stored: DataFrame | None = None
) -> DataFrame:
    """Hourly latency and queueing of successful queries, PRE and POST.

    In ``stored`` hours a query without a queueing time counts as one that didn't queue.
    """
    dates, span = migration_dates(log), timedelta(days=days_before)
    near = around_changes(queries, "start_time", dates, "migration_ts", span)
    split = None
    if stored is not None:
        split = split_at(stored, queries, "start_time", dates, [F.col("migration_ts") - F.lit(span), F.col("migration_ts")])
        near = near.filter(split.near)
    ok = near.filter(F.col("execution_status") == "SUCCESS").select(
        "warehouse_name", "start_time", "total_elapsed_time", "queued_overload_time"
    )
    rows = join_per_warehouse(ok, dates, spread_by="start_time").filter(F.col("start_time") >= F.col("migration_ts") - F.lit(span))
    if split is not None:
        rows = rows.filter(split.rest)
    measured = rows.groupBy(
        "warehouse_name", period("start_time", "migration_ts").alias("period"), hour_of(queries).alias("hour_ts")
    ).agg(
        F.count(F.lit(1)).alias("query_count"),
        seconds(F.avg("total_elapsed_time")).alias("avg_latency_sec"),
        seconds(F.percentile("total_elapsed_time", F.lit(0.95))).alias("p95_latency_sec"),
        seconds(F.avg("queued_overload_time")).alias("avg_queue_sec"),
        count_where(F.col("queued_overload_time") > 0).alias("queued_count"),
    )
    if split is None:
        return measured
    hours = around_changes(stored, "hour_ts", dates, "migration_ts", span).filter("query_count > 0").join(dates, "warehouse_name")
    return measured.unionByName(
        hours.filter((F.col("hour_ts") >= F.col("migration_ts") - F.lit(span)) & split.whole).select(
            "warehouse_name",
            period("hour_ts", "migration_ts").alias("period"),
            F.col("hour_ts").cast(measured.schema["hour_ts"].dataType).alias("hour_ts"),
            "query_count",
            seconds(F.col("avg_elapsed_ms")).alias("avg_latency_sec"),
            seconds(F.col("p95_elapsed_ms")).alias("p95_latency_sec"),
            seconds(ratio(F.col("total_queue_ms"), F.col("query_count"))).alias("avg_queue_sec"),
            F.col("queued_queries").alias("queued_count"),
        )
    )


def daily_savings(comparison: DataFrame) -> DataFrame:
    """POST days against the mean PRE day. ``comparison`` is the output of ``credit_comparison``.

    One scan: the mean is taken over the warehouse's daily rows, which the kept days bound.
    """
    daily = comparison.groupBy("warehouse_name", "period", day_of(comparison, "hour_ts").alias("day_ts")).agg(
        F.sum("credits").alias("_credits")
    )
    warehouse = Window.partitionBy("warehouse_name")
    before = F.when(F.col("period") == "PRE", F.col("_credits"))
    return (
        daily.withColumn("baseline_daily_credits", F.avg(before).over(warehouse))
        .withColumn("_pre_days", F.count(F.when(F.col("period") == "PRE", F.lit(1))).over(warehouse))
        .filter((F.col("period") == "POST") & (F.col("_pre_days") > 0))
        .select(
            "warehouse_name",
            "day_ts",
            F.col("_credits").alias("actual_credits"),
            "baseline_daily_credits",
            rounded((1 - ratio(F.col("_credits"), F.col("baseline_daily_credits"))) * 100, 1).alias("savings_pct"),
        )
        .orderBy("warehouse_name", "day_ts")
    )


def before_after(
    metering: DataFrame, events: DataFrame, days: int = 30, stored: DataFrame | None = None
) -> DataFrame:
    """Credits of the ``days`` before and after conversion; a row exactly at the conversion counts on both sides.

    First (warehouse, day) rows with conditional sums, then one row per warehouse: days are counted without a
    distinct, and a hot warehouse is spread over its days.
    """
    window = F.expr(f"INTERVAL {days} DAYS")
    start, change = F.col("start_time"), F.col("migration_date")
    before = start.between(change - window, change)
    after = start.between(change, change + window)
    dates, span = conversion_dates(events), timedelta(days=days)
    rows = metering_around(metering, dates, "migration_date", span, span, stored).filter(
        start.between(change - window, change + window)
    )
    per_day = rows.groupBy("warehouse_name", F.to_date("start_time").alias("_day")).agg(
        F.sum(F.when(before, F.col("credits_used"))).alias("_pre"),
        F.sum(F.when(after, F.col("credits_used"))).alias("_post"),
        F.max(before).alias("_has_pre"),
        F.max(after).alias("_has_post"),
    )
    pre, post = F.col("_pre"), F.coalesce("_post", F.lit(0.0))
    return (
        per_day.groupBy("warehouse_name")
        .agg(
            total("_pre").alias("_pre"),
            total("_post").alias("_post"),
            count_where(F.col("_has_pre")).alias("_pre_days"),
            count_where(F.col("_has_post")).alias("_post_days"),
        )
        .filter(F.col("_pre_days") > 0)
        .select(
            "warehouse_name",
            rounded(pre, 2).alias("pre_credits_30d"),
            rounded(post, 2).alias("post_credits_30d"),
            rounded(ratio(pre, F.col("_pre_days")), 2).alias("pre_daily_avg"),
            F.when(F.col("_post_days") > 0, rounded(ratio(post, F.col("_post_days")), 2)).alias("post_daily_avg"),
            rounded(ratio(pre - post, pre) * 100, 1).alias("savings_pct"),
        )
        .orderBy(F.desc_nulls_first("savings_pct"), "warehouse_name")
    )


def before_after_kpis(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.avg("savings_pct").alias("avg_savings_pct"), F.count(F.lit(1)).alias("warehouses_migrated")
    )


def before_after_long(comparison: DataFrame) -> DataFrame:
    return comparison.unpivot(
        ["warehouse_name"],
        [F.col("pre_daily_avg").alias("PRE_DAILY_AVG"), F.col("post_daily_avg").alias("POST_DAILY_AVG")],
        "period",
        "credits",
    )


def latency_before_after(
    queries: DataFrame,
    as_of: str | datetime,
    names: Iterable[str] | None = None,
    change_days_ago: int = 3,
    baseline_days: int = 7,
) -> DataFrame:
    """Mean latency and queueing per warehouse around a change ``change_days_ago``; one pass over both windows."""
    now = instant(as_of)
    change = now - timedelta(days=change_days_ago)
    start = change - timedelta(days=baseline_days)
    rows = warehouse_filter(
        queries.filter(between(queries, "start_time", start, now) & F.col("warehouse_name").isNotNull()), names
    )
    before, after = between(rows, "start_time", start, change), between(rows, "start_time", change, now)

    def avg_sec(side: Column, column: str) -> Column:
        return seconds(F.avg(F.when(side, F.col(column))))

    figures = rows.groupBy("warehouse_name").agg(
        avg_sec(before, "total_elapsed_time").alias("_pre"),
        avg_sec(after, "total_elapsed_time").alias("_post"),
        avg_sec(before, "queued_overload_time").alias("_pre_queue"),
        avg_sec(after, "queued_overload_time").alias("_post_queue"),
    )
    return figures.select(
        "warehouse_name",
        rounded("_pre", 2).alias("pre_avg_latency_sec"),
        rounded("_post", 2).alias("post_avg_latency_sec"),
        rounded((1 - ratio(F.col("_post"), F.col("_pre"))) * 100, 1).alias("latency_improvement_pct"),
        rounded("_pre_queue", 2).alias("pre_avg_queue_sec"),
        rounded("_post_queue", 2).alias("post_avg_queue_sec"),
        rounded((1 - ratio(F.col("_post_queue"), F.col("_pre_queue"))) * 100, 1).alias("queue_reduction_pct"),
    )


def query_volume_before_after(
    queries: DataFrame, log: DataFrame, as_of: str | datetime, days: int = 14, names: Iterable[str] | None = None
) -> DataFrame:
    """Query count and cloud credits before and after the first log entry; POST where there is none."""
    first = log.groupBy("warehouse_name").agg(F.min("migrated_at").alias("_first"))
    recent = queries.filter(last(queries, "start_time", as_of, days=days) & F.col("warehouse_name").isNotNull())
    rows = warehouse_filter(recent, names).select("warehouse_name", "start_time", "credits_used_cloud_services")
    return (
        join_per_warehouse(rows, first, spread_by="start_time", how="left")
        .groupBy(
            "warehouse_name", F.when(F.col("start_time") < F.col("_first"), "PRE").otherwise("POST").alias("period")
        )
        .agg(
            F.count(F.lit(1)).alias("query_count"), total("credits_used_cloud_services").alias("cloud_credits")
        )
    )
