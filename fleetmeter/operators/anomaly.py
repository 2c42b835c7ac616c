"""Cost anomalies, their calendar suppression, and spend and latency alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import count_where, ratio, rounded_even, total
from ..functions.times import HOUR, between, day_of, instant, is_weekend, last, moment
from .comparison import migration_dates, performance_comparison
from .governance import with_calendar_windows
from .lifecycle import latest_migrations

SPIKE, DROP, EXPECTED_BATCH = "SPIKE", "DROP", "EXPECTED_BATCH"


def credit_anomalies(hm: DataFrame) -> DataFrame:
    """Days that deviate from the mean of up to seven previous observed days (at least three).

    The window runs on the daily rollup, so its partitions are bounded by the days kept. Sums are decimal there, so
    a day exactly at a threshold is classified the same however the rows arrive.
    """
    daily = hm.groupBy("warehouse_name", day_of(hm, "hour_ts").alias("day_ts")).agg(
        F.sum(F.col("credits").cast("decimal(20,6)")).alias("_daily")
    )
    week = Window.partitionBy("warehouse_name").orderBy("day_ts").rowsBetween(-7, -1)
    rated = (
        daily.withColumn("_days", F.count("_daily").over(week))
        .withColumn("_mean", ratio(F.sum("_daily").over(week), F.col("_days")))
        .withColumn("_std", F.stddev_samp("_daily").over(week))
        .filter(F.col("_days") >= 3)
        .withColumn("_x", F.col("_daily").cast("double"))
    )
    x, expected, std = F.col("_x"), F.col("_mean"), F.col("_std")
    days_left = F.datediff(F.last_day("day_ts"), F.to_date("day_ts"))
    month_end, weekend = days_left <= 1, is_weekend(F.col("day_ts"))
    spike = x > expected * 2
    drop = (x < expected * 0.2) & (expected > 1)
    kind = (
        F.when(drop & ~weekend, DROP)
        .when(spike & month_end, EXPECTED_BATCH)
        .when(spike, SPIKE)
    )
    return (
        rated.withColumn("anomaly_type", kind)
        .filter(F.col("anomaly_type").isNotNull())
        .select(
            "warehouse_name",
            "day_ts",
            rounded_even(x, 2).alias("daily_credits"),
            rounded_even(expected, 2).alias("expected_credits"),
            std.alias("rolling_std"),
            rounded_even(F.when(std == 0, F.lit(0.0)).otherwise(ratio(x - expected, std)), 2).alias("z_score"),
            F.dayofmonth("day_ts").alias("day_of_month"),
            F.dayofmonth(F.last_day("day_ts")).alias("days_in_month"),
            month_end.alias("is_month_end"),
            (month_end & F.month("day_ts").isin(3, 6, 9, 12)).alias("is_quarter_end"),
            weekend.alias("is_weekend"),
            "anomaly_type",
        )
        .orderBy(F.desc("day_ts"), "warehouse_name")
    )


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    kind = F.col("anomaly_type")
    return anomalies.agg(
        count_where(kind == SPIKE).alias("unexpected_spikes"),
        count_where(kind == DROP).alias("unexpected_drops"),
        count_where(kind == EXPECTED_BATCH).alias("expected_batch_spikes"),
        F.count_distinct("warehouse_name").alias("warehouses_affected"),
    )


def calendar_suppression(anomalies: DataFrame, calendar: DataFrame, drop: bool = False) -> DataFrame:
    """Mark (or with ``drop`` remove) anomalies inside a suppressing calendar window that names their warehouse."""
    suppressing = calendar.filter(F.coalesce("suppress_anomaly", F.lit(False)))
    marked = with_calendar_windows(anomalies, "day_ts", suppressing).withColumn("suppressed", F.col("_windows") > 0)
    if drop:
        return marked.filter(~F.col("suppressed")).select(anomalies.columns)
    return marked.select(*anomalies.columns, "suppressed")


def credit_spike_alert(
    log: DataFrame,
    metering: DataFrame,
    as_of: str | datetime,
    hours: int = 4,
    factor: float = 1.5,
    exclude_rolled_back: bool = False,
) -> DataFrame:
    """Migrated warehouses whose last ``hours`` cost more than ``factor`` times their baseline; no rows, no alert."""
    rows = metering.filter(last(metering, "start_time", as_of, hours=hours))
    recent = rows.groupBy("warehouse_name").agg(total("credits_used").alias("recent_credits"))
    return (
        latest_migrations(log, exclude_rolled_back)
        .select("warehouse_name", (F.col("baseline_credits_7d") / 7 / 24).alias("baseline_hourly"))
        .join(recent, "warehouse_name")
        .withColumn("alert_threshold", F.col("baseline_hourly") * hours * factor)
        .filter(F.col("recent_credits") > F.col("alert_threshold"))
    )


def critical_spike_alert(
    log: DataFrame, metering: DataFrame, as_of: str | datetime, exclude_rolled_back: bool = False
) -> DataFrame:
    return credit_spike_alert(log, metering, as_of, 6, 2.0, exclude_rolled_back)


def latency_regression_alert(
    queries: DataFrame,
    log: DataFrame,
    as_of: str | datetime,
    hours: int = 4,
    regression_pct: float = 25.0,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Warehouses whose hourly p95 exceeded the mean PRE p95 by ``regression_pct`` in every observed recent hour.

    The scan gets two ranges, the time up to the latest change and the recent hours: nothing between them is judged. With
    ``stored`` hourly queries raw rows are read for the hours of changes and the newest hours only.
    """
    now = instant(as_of)
    final = migration_dates(log).agg(F.max("migration_ts").cast("string")).first()[0]
    judged = queries.filter(F.lit(False)) if final is None else queries.filter(
        (F.col("start_time") < moment(queries, "start_time", instant(final)))
        | between(queries, "start_time", now - timedelta(hours=hours), now.replace(minute=0, second=0, microsecond=0) + HOUR)
    )
    hourly = performance_comparison(judged, log, stored=stored)
    recent_hour = between(hourly, "hour_ts", now - timedelta(hours=hours), now)
    return (
        hourly.groupBy("warehouse_name")
        .agg(
            F.avg(F.when(F.col("period") == "PRE", F.col("p95_latency_sec"))).alias("baseline_p95_sec"),
            F.min(F.when((F.col("period") == "POST") & recent_hour, F.col("p95_latency_sec"))).alias("lowest_p95_sec"),
            count_where((F.col("period") == "POST") & recent_hour).alias("recent_hours"),
        )
        .filter(F.col("lowest_p95_sec") > F.col("baseline_p95_sec") * (1 + regression_pct / 100))
    )
