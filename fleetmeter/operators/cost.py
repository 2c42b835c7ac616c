"""Cost and credit reports. ``hm`` is the hourly metering rollup: one row per (warehouse, hour)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import ADAPTIVE, STANDARD
from ..functions.measures import fixed, mean, ratio, rounded, rounded_even, scalar, seconds, total
from ..functions.times import day_of, floor_to, hour_of, instant, last, moment
from ..sources.readers import warehouse_filter
from .rollups import cost_centers

#: Price per credit where no rate is known.
FALLBACK_CREDIT_PRICE = 3.0


def credit_usage(hm: DataFrame, names: Iterable[str] | DataFrame | None = None, allowlist=None) -> DataFrame:
    return warehouse_filter(hm, names, allowlist).select("warehouse_name", "hour_ts", "credits")


def credit_totals(hm: DataFrame) -> DataFrame:
    """Totals in descending order. Sums are decimal, so that equal totals are equal however the rows arrive."""
    return (
        hm.groupBy("warehouse_name")
        .agg(F.sum(F.col("credits").cast("decimal(20,6)")).cast("double").alias("total_credits"))
        .orderBy(F.desc("total_credits"), "warehouse_name")
    )


def top_consumers(hm: DataFrame, inventory: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` largest totals with the pool type; the top-k runs before the join."""
    return (
        credit_totals(hm)
        .limit(n)
        .join(inventory.select("warehouse_name", "warehouse_type"), "warehouse_name", "left")
        .select(
            "warehouse_name", "total_credits", F.coalesce("warehouse_type", F.lit(STANDARD)).alias("warehouse_type")
        )
        .orderBy(F.desc("total_credits"), "warehouse_name")
    )


def credit_distribution(hm: DataFrame, names: Iterable[str] | DataFrame | None = None, n: int = 8) -> DataFrame:
    return credit_totals(credit_usage(hm, names)).withColumnRenamed("total_credits", "credits").limit(n)


def daily_credit_trend(metering: DataFrame, as_of: str | datetime, days: int = 30) -> DataFrame:
    rows = metering.filter(last(metering, "start_time", as_of, days=days))
    return (
        rows.groupBy(day_of(rows).alias("day_ts"), "warehouse_name")
        .agg(total("credits_used").alias("daily_credits"))
        .orderBy("day_ts", "warehouse_name")
    )


def hourly_metering_stats(metering: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    rows = metering.filter(last(metering, "start_time", as_of, days=days))
    return rows.groupBy(hour_of(rows).alias("hour_ts"), "warehouse_name").agg(
        F.count(F.lit(1)).alias("metering_events"),
        total("credits_used").alias("total_credits"),
        mean("credits_used").alias("avg_credits_per_entry"),
    )


def weekly_scorecard(metering: DataFrame, as_of: str | datetime, days: int = 28) -> DataFrame:
    rows = metering.filter(last(metering, "start_time", as_of, days=days))
    weekly = rows.groupBy("warehouse_name", floor_to(rows, "week", "start_time").alias("week_ts")).agg(
        F.sum("credits_used").alias("weekly_credits")
    )
    return (
        weekly.groupBy("warehouse_name")
        .agg(
            F.min("weekly_credits").cast("double").alias("min_weekly_credits"),
            F.max("weekly_credits").cast("double").alias("max_weekly_credits"),
            mean("weekly_credits").alias("avg_weekly_credits"),
        )
        .orderBy(F.desc("avg_weekly_credits"), "warehouse_name")
    )


def tag_attribution(
    metering: DataFrame,
    tags: DataFrame,
    as_of: str | datetime,
    days_back: int = 30,
    price: float = FALLBACK_CREDIT_PRICE,
    every_tag: bool = False,
) -> DataFrame:
    """Credits and cost per (cost centre, warehouse).

    A warehouse with several cost-centre rows is charged once, to the greatest value. With ``every_tag`` it is charged
    in full once per tag row. Either way credits are summed per warehouse before the tags join.
    """
    rows = metering.filter(last(metering, "start_time", as_of, days=days_back))
    used = rows.groupBy("warehouse_name").agg(F.sum("credits_used").alias("_credits"))
    if every_tag:
        centers = cost_centers(tags).groupBy("warehouse_name", "tag_value").agg(F.count(F.lit(1)).alias("_times"))
    else:
        centers = cost_centers(tags).groupBy("warehouse_name").agg(
            F.max("tag_value").alias("tag_value"), F.lit(1).alias("_times")
        )
    # exact while decimal, double only at the end
    charged = F.col("_credits") * F.coalesce("_times", F.lit(1))
    return (
        used.join(centers, "warehouse_name", "left")
        .groupBy(F.coalesce("tag_value", F.lit("Untagged")).alias("cost_center"), "warehouse_name")
        .agg(F.sum(charged).cast("double").alias("_total"))
        .select(
            "cost_center",
            "warehouse_name",
            rounded("_total", 2).alias("total_credits"),
            rounded(F.col("_total") * F.lit(float(price)), 2).alias("estimated_cost_usd"),
        )
        .orderBy(F.desc("total_credits"), "cost_center", "warehouse_name")
    )


def tag_summary(attribution: DataFrame, n: int | None = 10) -> DataFrame:
    """Per cost centre, from the rounded attribution rows; ``n=None`` keeps all."""
    summary = (
        attribution.groupBy("cost_center")
        .agg(F.sum("total_credits").alias("total_credits"), F.sum("estimated_cost_usd").alias("estimated_cost_usd"))
        .orderBy(F.desc("total_credits"), "cost_center")
    )
    return summary if n is None else summary.limit(n)


def credit_price(
    rates: DataFrame,
    currency: DataFrame,
    as_of: str | datetime,
    fallback: float = FALLBACK_CREDIT_PRICE,
    days: int = 7,
) -> DataFrame:
    """One row: the newest positive rate of the window, else money per unit of usage, else the fallback."""
    today = F.lit(instant(as_of).date())
    start = F.date_sub(today, days)
    sheet = rates.filter(
        (F.col("service_type") == "WAREHOUSE_METERING")
        & (F.col("usage_type") == "compute")
        & F.col("date").between(start, today)
        & (F.col("effective_rate") > 0)
    ).agg(F.max(F.struct("date", "effective_rate")).getField("effective_rate").alias("credit_price"))
    derived = currency.filter(
        (F.col("usage_type") == "compute") & F.col("usage_date").between(start, today) & (F.col("usage") > 0)
    ).agg(rounded(ratio(F.sum("usage_in_currency"), F.sum("usage")), 2).alias("credit_price"))
    spark = rates.sparkSession
    default = spark.range(1).select(F.lit(float(fallback)).alias("credit_price"))
    candidates = (
        sheet.withColumn("_order", F.lit(1))
        .unionByName(derived.withColumn("_order", F.lit(2)))
        .unionByName(default.withColumn("_order", F.lit(3)))
    )
    return candidates.filter(F.col("credit_price") > 0).agg(F.min_by("credit_price", "_order").alias("credit_price"))


def idle_waste(hm: DataFrame, hq: DataFrame) -> DataFrame:
    """Credits of hours in which no query succeeded (failed queries do not make an hour active).

    Both sides are rollups, so the join is (warehouses x hours) wide whatever the raw volume.
    """
    succeeded = hq.groupBy("warehouse_name", "hour_ts").agg(F.sum("query_count").alias("_succeeded"))
    idle = F.coalesce("_succeeded", F.lit(0)) == 0
    return (
        hm.join(succeeded, ["warehouse_name", "hour_ts"], "left")
        .groupBy("warehouse_name")
        .agg(
            F.sum("credits").alias("total_credits"),
            F.sum(F.when(idle, F.col("credits")).otherwise(0.0)).alias("idle_credits"),
            F.count("hour_ts").alias("total_hours"),
            F.count(F.when(idle, F.lit(1))).alias("idle_hours"),
        )
        .filter(F.col("total_credits") > 0)
        .orderBy(F.desc("idle_credits"), "warehouse_name")
    )


def idle_waste_priced(idle: DataFrame, price: float | DataFrame = FALLBACK_CREDIT_PRICE) -> DataFrame:
    """``price`` is a number or the frame of ``credit_price``, here and below."""
    return idle.withColumn(
        "idle_pct", rounded_even(ratio(F.col("idle_credits"), F.col("total_credits")) * 100, 1)
    ).withColumn("wasted_usd", rounded_even(F.col("idle_credits") * scalar(price), 2))


def savings_projection(
    idle: DataFrame,
    inventory: DataFrame,
    savings_pct: float = 25.0,
    price: float | DataFrame = FALLBACK_CREDIT_PRICE,
    days: int = 30,
) -> DataFrame:
    """Fleet totals and what the standard pools would save; one row."""
    standard = inventory.filter(~F.col("warehouse_type").eqNullSafe(ADAPTIVE)).select(
        "warehouse_name", F.lit(True).alias("_standard")
    )
    fleet = idle.join(standard, "warehouse_name", "left").agg(
        F.coalesce(F.sum("total_credits"), F.lit(0.0)).alias("total_credits"),
        F.coalesce(F.sum("idle_credits"), F.lit(0.0)).alias("idle_credits"),
        F.coalesce(F.sum(F.when(F.col("_standard"), F.col("total_credits"))), F.lit(0.0)).alias("standard_credits"),
    )
    saved = F.col("standard_credits") * F.lit(savings_pct / 100)
    usd = saved * F.col("_price")
    return fleet.withColumn("_price", scalar(price)).select(
        "total_credits",
        "idle_credits",
        F.coalesce(rounded_even(ratio(F.col("idle_credits"), F.col("total_credits")) * 100, 1), F.lit(0.0)).alias("idle_pct"),
        "standard_credits",
        saved.alias("projected_savings_credits"),
        usd.alias("projected_savings_usd"),
        (usd * F.lit(365 / max(days, 1))).alias("annual_savings_usd"),
    )


def gl_mappings_active(gl: DataFrame, as_of: str | datetime) -> DataFrame:
    """Mappings not yet ended; a future start does not exclude one."""
    return (
        gl.filter(F.col("effective_to") >= F.lit(instant(as_of).date()))
        .select(
            "warehouse_name", "gl_code", "cost_center", "department", "business_line", "allocation_pct",
            "effective_from", "approved_by",
        )
        .orderBy("warehouse_name", "gl_code")
    )


def gl_chargeback(totals: DataFrame, active_gl: DataFrame, price: float | DataFrame = FALLBACK_CREDIT_PRICE) -> DataFrame:
    """Totals allocated by percentage; what a mapping leaves unallocated is not redistributed."""
    share = F.col("total_credits") * F.coalesce("allocation_pct", F.lit(100.0)) / 100
    mapping = active_gl.select("warehouse_name", "gl_code", "business_line", "allocation_pct")
    return (
        totals.join(mapping, "warehouse_name", "left")
        .withColumn("_price", scalar(price))
        .groupBy(
            F.coalesce("gl_code", F.lit("UNALLOCATED")).alias("gl_code"),
            F.coalesce("business_line", F.lit("Unassigned")).alias("business_line"),
        )
        .agg(F.sum(share).alias("allocated_credits"), F.sum(share * F.col("_price")).alias("allocated_cost"))
        .orderBy(F.desc("allocated_cost"), "gl_code", "business_line")
    )


def usage_baseline_stats(
    metering: DataFrame, as_of: str | datetime, days: int = 7, names: Iterable[str] | None = None
) -> DataFrame:
    rows = warehouse_filter(metering.filter(last(metering, "start_time", as_of, days=days)), names)
    return rows.groupBy("warehouse_name").agg(
        total("credits_used").alias("credits_7d"),
        mean("credits_used").alias("avg_hourly"),
        F.max("credits_used").cast("double").alias("peak_hourly"),
        F.min("credits_used").cast("double").alias("min_hourly"),
        ratio(F.stddev_samp("credits_used"), mean("credits_used")).alias("coefficient_of_variation"),
    )


def idle_ratio(
    metering: DataFrame, as_of: str | datetime, days: int = 7, names: Iterable[str] | None = None
) -> DataFrame:
    rows = warehouse_filter(metering.filter(last(metering, "start_time", as_of, days=days)), names)
    active = rows.select("warehouse_name", hour_of(rows).alias("hour_ts")).distinct()
    hours = float(days * 24)
    return active.groupBy("warehouse_name").agg(
        F.count(F.lit(1)).alias("active_hours"),
        F.lit(days * 24).alias("total_hours"),
        rounded((1 - F.count(F.lit(1)) / F.lit(hours)) * 100, 1).alias("idle_pct"),
    )


def rolling_cost(
    metering: DataFrame, as_of: str | datetime, days: int = 14, names: Iterable[str] | None = None
) -> DataFrame:
    """Daily credits and their trailing average over up to seven observed days."""
    rows = warehouse_filter(metering.filter(last(metering, "start_time", as_of, days=days)), names)
    daily = rows.groupBy("warehouse_name", F.to_date("start_time").alias("run_date")).agg(
        F.sum("credits_used").alias("_credits")
    )
    week = Window.partitionBy("warehouse_name").orderBy("run_date").rowsBetween(-6, 0)
    return daily.select(
        "warehouse_name",
        "run_date",
        F.col("_credits").cast("double").alias("daily_credits"),
        ratio(F.sum("_credits").over(week), F.count("_credits").over(week)).alias("rolling_7d_avg"),
    )


def schedule_pattern(
    queries: DataFrame, as_of: str | datetime, days: int = 7, names: Iterable[str] | None = None
) -> DataFrame:
    rows = warehouse_filter(
        queries.filter(last(queries, "start_time", as_of, days=days) & F.col("warehouse_name").isNotNull()), names
    )
    return rows.groupBy("warehouse_name", hour_of(rows).alias("hour_ts")).agg(
        F.count(F.lit(1)).alias("queries"),
        (seconds(F.sum("total_elapsed_time")) / 60).alias("total_runtime_min"),
        total("credits_used_cloud_services").alias("credits"),
    )


def monthly_savings_report(daily_savings: DataFrame, as_of: str | datetime) -> DataFrame:
    """Month to date, per warehouse, from the daily savings rows."""
    month = instant(as_of).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    rows = daily_savings.filter(F.col("day_ts") >= moment(daily_savings, "day_ts", month))
    base, actual = F.sum("baseline_daily_credits"), F.sum("actual_credits")
    return (
        rows.groupBy("warehouse_name")
        .agg(
            rounded(base, 0).alias("baseline_credits"),
            rounded(actual, 0).alias("actual_credits"),
            rounded(base - actual, 0).alias("credits_saved"),
            F.concat(fixed(F.avg("savings_pct"), 1), F.lit("%")).alias("avg_savings"),
        )
        .orderBy(F.desc("credits_saved"), "warehouse_name")
    )


def capture_baseline(
    metering: DataFrame, as_of: str | datetime, names: DataFrame | None = None, days: int = 7
) -> DataFrame:
    """Credits of the last ``days`` per warehouse; 0 for a requested warehouse without usage."""
    rows = metering.filter(last(metering, "start_time", as_of, days=days))
    used = rows.groupBy("warehouse_name").agg(total("credits_used").alias("baseline_credits_7d"))
    if names is None:
        return used
    return (
        names.select("warehouse_name")
        .distinct()
        .join(used, "warehouse_name", "left")
        .select("warehouse_name", F.coalesce("baseline_credits_7d", F.lit(0.0)).alias("baseline_credits_7d"))
    )


def refresh_baseline(
    log: DataFrame, metering: DataFrame, as_of: str | datetime, names: Iterable[str] | None = None, days: int = 7
) -> DataFrame:
    """The log with the baseline of MIGRATE rows replaced by the current sum (NULL without usage)."""
    used = capture_baseline(metering, as_of, days=days).withColumnRenamed("baseline_credits_7d", "_current")
    renew = F.col("action") == "MIGRATE"
    if names:
        renew = renew & F.col("warehouse_name").isin(list(names))
    return (
        log.join(used, "warehouse_name", "left")
        .withColumn("baseline_credits_7d", F.when(renew, F.col("_current")).otherwise(F.col("baseline_credits_7d")))
        .select(log.columns)
    )
