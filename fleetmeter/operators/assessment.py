"""Readiness scores, fleet figures, scenario projections and selection plans."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ADAPTIVE, STANDARD, UNSUPPORTED_SIZES, is_multi_cluster, recommendation_band
from ..functions.measures import capped, count_where, ratio, rounded, rounded_even, scalar
from ..functions.times import instant, last, moment
from .cost import FALLBACK_CREDIT_PRICE
from .rollups import hourly_metering, hourly_query_metrics

# Scenario names and the share of active credits each assumes to remain.
SCENARIOS = [
    ("Conservative (15%)", 0.85),
    ("Moderate (25%)", 0.75),
    ("Optimistic (35%)", 0.65),
    ("Aggressive (45%)", 0.55),
]
DEFAULT_FACTORS = {"Optimistic (35%)": 0.65, "Moderate (25%)": 0.75, "Conservative (15%)": 0.85}

#: Share of credits taken as idle where a warehouse has no query telemetry.
ASSUMED_IDLE_SHARE = 0.3
#: Credits one extra cluster costs, as a share of active credits.
CLUSTER_OVERHEAD = 0.10


def score_components(cv: Column, active_hours: Column, queued: Column, credits: Column, window_hours: float) -> list[Column]:
    """Variability (up to 40), idleness (30), queueing (20) and volume (10). Upper caps only; NULL stays NULL."""
    return [
        capped(cv * 40, 40).alias("variability_component"),
        capped((1 - active_hours / F.lit(float(window_hours))) * 30, 30).alias("idle_component"),
        capped(ratio(queued, active_hours) * 5, 20).alias("queue_component"),
        capped(credits / 100, 10).alias("credit_component"),
    ]


def readiness_score(cv: Column, active_hours: Column, queued: Column, credits: Column, window_hours: float) -> Column:
    variability, idle, queue, volume = score_components(cv, active_hours, queued, credits, window_hours)
    return variability + idle + queue + volume


def _variation(credits: str) -> Column:
    """Standard deviation over mean; 0 where the mean is not positive, NULL for a single hour."""
    mean = F.avg(credits)
    return F.when(mean > 0, F.try_divide(F.stddev_samp(credits), mean)).otherwise(F.lit(0.0))


def usage_stats(metering: DataFrame, queries: DataFrame, as_of: str | datetime, lookback: int = 14) -> DataFrame:
    """Per warehouse: active hours, credits, their variation, and queued successful queries of metered hours."""
    hm = hourly_metering(metering, as_of, lookback)
    queued = hourly_query_metrics(queries, as_of, lookback).select("warehouse_name", "hour_ts", "queued_queries")
    return (
        hm.join(queued, ["warehouse_name", "hour_ts"], "left")
        .groupBy("warehouse_name")
        .agg(
            F.count("hour_ts").alias("active_hours"),
            F.sum("credits").alias("total_credits"),
            _variation("credits").alias("credit_cv"),
            F.sum("queued_queries").alias("total_queued_queries"),
        )
    )


def assessment_sql(
    inventory: DataFrame, metering: DataFrame, queries: DataFrame, as_of: str | datetime, lookback: int = 14
) -> DataFrame:
    """Every STANDARD pool of the inventory; one without usage has a NULL score and stays KEEP STANDARD."""
    hours = float(lookback * 24)
    queued = F.coalesce("total_queued_queries", F.lit(0))
    score = readiness_score(F.col("credit_cv"), F.col("active_hours"), queued, F.col("total_credits"), hours)
    return (
        inventory.filter(F.col("warehouse_type") == STANDARD)
        .select("warehouse_name", "warehouse_type", "warehouse_size")
        .join(usage_stats(metering, queries, as_of, lookback), "warehouse_name", "left")
        .select(
            "warehouse_name",
            "warehouse_type",
            "warehouse_size",
            "active_hours",
            F.lit(lookback * 24).alias("total_hours"),
            rounded(F.col("active_hours") / F.lit(hours) * 100, 1).alias("utilization_pct"),
            rounded("total_credits", 2).alias("total_credits"),
            rounded("credit_cv", 3).alias("variability_score"),
            queued.alias("total_queued_queries"),
            rounded(score, 1).alias("adaptive_score"),
            recommendation_band(score).alias("recommendation"),
        )
        .orderBy(F.desc_nulls_first("adaptive_score"), "warehouse_name")
    )


def assessment_scores(hm: DataFrame, hq: DataFrame, days_back: int, inventory: DataFrame | None = None) -> DataFrame:
    """Scores from the rollups: adaptive and unsupported pools excluded, gaps as 0, variation rounded before scoring."""
    if inventory is not None:
        excluded = F.col("warehouse_type") == ADAPTIVE
        if "warehouse_size" in inventory.columns:
            excluded = excluded | F.col("warehouse_size").isin(*UNSUPPORTED_SIZES)
        out = inventory.filter(excluded).select("warehouse_name")
        hm = hm.join(out, "warehouse_name", "left_anti")
    usage = hm.groupBy("warehouse_name").agg(
        F.count("hour_ts").alias("active_hours"),
        F.avg("credits").alias("avg_credits"),
        F.coalesce(F.stddev_samp("credits"), F.lit(0.0)).alias("std_credits"),
        F.sum("credits").alias("total_credits"),
    )
    activity = hq.groupBy("warehouse_name").agg(
        F.sum("queued_queries").alias("queued_queries"),
        F.sum("complex_queries").alias("complex_queries"),
        F.sum("query_count").alias("total_queries"),
        F.avg("latency_stddev").alias("latency_stddev"),
    )
    variability = F.coalesce(rounded_even(ratio(F.col("std_credits"), F.col("avg_credits")), 3), F.lit(0.0))
    return (
        usage.join(activity, "warehouse_name", "left")
        .fillna(0, ["queued_queries", "complex_queries", "total_queries", "latency_stddev"])
        .withColumn("variability", variability)
        .withColumn(
            "adaptive_score",
            rounded_even(
                readiness_score(
                    F.col("variability"), F.col("active_hours"), F.col("queued_queries"), F.col("total_credits"),
                    days_back * 24,
                ),
                1,
            ),
        )
        .orderBy(F.desc("adaptive_score"), "warehouse_name")
    )


def assessment_windowless(metering: DataFrame, queries: DataFrame, as_of: str | datetime, lookback: int = 14) -> DataFrame:
    """Scores with queued queries of any status counted per warehouse, metered hour or not."""
    hm = hourly_metering(metering, as_of, lookback)
    recent = queries.filter(last(queries, "start_time", as_of, days=lookback) & F.col("warehouse_name").isNotNull())
    queued = recent.groupBy("warehouse_name").agg(
        count_where(F.col("queued_overload_time") > 0).alias("queued_queries")
    )
    usage = hm.groupBy("warehouse_name").agg(
        F.count("hour_ts").alias("active_hours"),
        F.sum("credits").alias("_total"),
        _variation("credits").alias("_cv"),
    )
    return (
        usage.join(queued, "warehouse_name", "left")
        .fillna(0, ["queued_queries"])
        .select(
            "warehouse_name",
            "active_hours",
            rounded("_total", 2).alias("total_credits_14d"),
            rounded("_cv", 3).alias("variability"),
            "queued_queries",
            rounded(
                readiness_score(
                    F.col("_cv"), F.col("active_hours"), F.col("queued_queries"), F.col("_total"), lookback * 24
                ),
                1,
            ).alias("adaptive_score"),
        )
    )


def assessment_enriched(scores: DataFrame, inventory: DataFrame) -> DataFrame:
    known = inventory.select(
        "warehouse_name", "warehouse_type", "warehouse_size", is_multi_cluster().alias("_multi")
    )
    return (
        scores.join(known, "warehouse_name", "left")
        .withColumn("warehouse_type", F.coalesce("warehouse_type", F.lit("UNKNOWN")))
        .withColumn("warehouse_size", F.coalesce("warehouse_size", F.lit("")))
        .withColumn("multi_cluster", F.when(F.col("_multi"), "Yes").otherwise("No"))
        .drop("_multi")
    )


def fleet_kpis(inventory: DataFrame) -> DataFrame:
    adaptive = count_where(F.col("warehouse_type") == ADAPTIVE)
    everything = F.count(F.lit(1))
    return inventory.agg(
        everything.alias("total_warehouses"),
        adaptive.alias("adaptive"),
        (everything - adaptive).alias("standard"),
        count_where(is_multi_cluster()).alias("multi_cluster"),
        F.coalesce(rounded_even(ratio(adaptive, everything) * 100, 1), F.lit(0.0)).alias("adoption_pct"),
    )


def multi_cluster(inventory: DataFrame) -> DataFrame:
    return inventory.filter(is_multi_cluster()).select("warehouse_name", "max_clusters")


def scenario_default(utilization_pct: Column) -> Column:
    """The scenario suggested for a utilisation."""
    return (
        F.when(utilization_pct < 30, "Optimistic (35%)")
        .when(utilization_pct < 60, "Moderate (25%)")
        .otherwise("Conservative (15%)")
    )


def default_factor(utilization_pct: Column) -> Column:
    name = scenario_default(utilization_pct)
    factor = F.lit(None).cast("double")
    for label, value in DEFAULT_FACTORS.items():
        factor = F.when(name == label, F.lit(value)).otherwise(factor)
    return factor


def scenario_stats(hm: DataFrame, hq: DataFrame, inventory: DataFrame, as_of: str | datetime, days_back: int) -> DataFrame:
    """What the projection needs per standard pool.

    Hours of the last two hours are never idle: their queries may not have been reported. Without any query telemetry a
    fixed share is taken as idle.
    """
    settled = F.col("hour_ts") < moment(hm, "hour_ts", instant(as_of) - timedelta(hours=2))
    hours = hq.select(
        "warehouse_name", "hour_ts", "query_count", "avg_elapsed_ms", "queued_queries", F.lit(1).alias("_seen")
    )
    activity = hours.groupBy("warehouse_name").agg(
        F.sum("query_count").alias("total_queries"),
        F.avg("avg_elapsed_ms").alias("_avg_ms"),
        F.sum("queued_queries").alias("queued_queries"),
        F.max("_seen").alias("_observed"),
    )
    idle = settled & (F.coalesce("query_count", F.lit(0)) == 0)
    usage = (
        hm.join(hours.select("warehouse_name", "hour_ts", "query_count"), ["warehouse_name", "hour_ts"], "left")
        .groupBy("warehouse_name")
        .agg(
            F.sum("credits").alias("total_credits"),
            F.count(F.lit(1)).alias("active_hours"),
            F.sum(F.when(idle, F.col("credits")).otherwise(0.0)).alias("_idle"),
        )
    )
    pools = inventory.filter(~F.col("warehouse_type").eqNullSafe(ADAPTIVE)).select(
        "warehouse_name",
        "warehouse_size",
        F.when(is_multi_cluster(), F.trim(F.col("max_clusters").cast("string")).try_cast("long"))
        .otherwise(F.lit(1))
        .alias("max_clusters"),
    )
    total_hours = days_back * 24
    return (
        usage.join(activity, "warehouse_name", "left")
        .join(pools, "warehouse_name")
        .select(
            "warehouse_name",
            "warehouse_size",
            "max_clusters",
            "total_credits",
            "active_hours",
            F.lit(total_hours).alias("total_hours"),
            (F.lit(total_hours) - F.col("active_hours")).alias("idle_hours"),
            (F.col("active_hours") / F.lit(float(total_hours)) * 100).alias("utilization_pct"),
            F.coalesce("total_queries", F.lit(0)).alias("total_queries"),
            (F.coalesce("_avg_ms", F.lit(0.0)) / 1000).alias("avg_latency_sec"),
            F.coalesce("queued_queries", F.lit(0)).alias("queued_queries"),
            F.col("_observed").isNotNull().alias("has_query_telemetry"),
            F.when(F.col("_observed").isNotNull(), F.col("_idle"))
            .otherwise(F.col("total_credits") * ASSUMED_IDLE_SHARE)
            .alias("idle_credits"),
        )
        .withColumn("active_credits", F.col("total_credits") - F.col("idle_credits"))
        .withColumn("cluster_overhead", F.col("active_credits") * CLUSTER_OVERHEAD * (F.col("max_clusters") - 1))
    )


def _projected(factor: Column) -> Column:
    return F.greatest(F.col("active_credits") * factor - F.col("cluster_overhead"), F.lit(0.0))


def scenario_projection(
    hm: DataFrame,
    hq: DataFrame,
    inventory: DataFrame,
    as_of: str | datetime,
    days_back: int,
    price: float | DataFrame = FALLBACK_CREDIT_PRICE,
) -> DataFrame:
    """Every standard pool under every scenario; the factors are unfolded per row, nothing is cross joined.

    Figures are not rounded: at one decimal the products sit on rounding boundaries.
    """
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("factor")) for n, f in SCENARIOS])
    saved = F.col("total_credits") - F.col("_projected")
    return (
        scenario_stats(hm, hq, inventory, as_of, days_back)
        .select("*", F.inline(scenarios))
        .withColumns({"_projected": _projected(F.col("factor")), "_price": scalar(price)})
        .select(
            "warehouse_name",
            "scenario",
            F.col("total_credits").alias("current_credits"),
            F.col("_projected").alias("projected_credits"),
            saved.alias("credits_saved"),
            F.coalesce(ratio(saved, F.col("total_credits")) * 100, F.lit(0.0)).alias("savings_pct"),
            (saved * F.col("_price") * 365 / max(days_back, 1)).alias("annual_savings_usd"),
            (F.col("scenario") == scenario_default(F.col("utilization_pct"))).alias("is_default"),
        )
    )


def scenario_hourly(
    hm: DataFrame,
    hq: DataFrame,
    inventory: DataFrame,
    as_of: str | datetime,
    days_back: int,
    factor: float | None = None,
) -> DataFrame:
    """Actual and projected credits per hour, long. ``factor=None`` uses each pool's default scenario."""
    used = scenario_stats(hm, hq, inventory, as_of, days_back)
    chosen = default_factor(F.col("utilization_pct")) if factor is None else F.lit(float(factor))
    pools = used.select("warehouse_name", chosen.alias("_factor"), "has_query_telemetry")
    hours = hq.select("warehouse_name", "hour_ts", "query_count")
    active = ~F.col("has_query_telemetry") | (F.coalesce("query_count", F.lit(0)) > 0)
    rows = (
        hm.join(hours, ["warehouse_name", "hour_ts"], "left")
        .join(pools, "warehouse_name")
        .select(
            "warehouse_name",
            "hour_ts",
            F.col("credits").alias("Gen1"),
            F.when(active, F.col("credits") * F.col("_factor")).otherwise(0.0).alias("Adaptive"),
        )
    )
    return rows.unpivot(["warehouse_name", "hour_ts"], ["Gen1", "Adaptive"], "type", "credits")


def scenario_findings(
    hm: DataFrame,
    hq: DataFrame,
    inventory: DataFrame,
    as_of: str | datetime,
    days_back: int,
) -> DataFrame:
    """Rules that apply to each standard pool under its default scenario, one row per finding."""
    total = F.col("total_credits")
    stats = scenario_stats(hm, hq, inventory, as_of, days_back).withColumn(
        "_saved_pct",
        F.coalesce(
            ratio(total - _projected(default_factor(F.col("utilization_pct"))), total) * 100, F.lit(0.0)
        ),
    )
    queued = F.col("queued_queries") > 0
    rules = [
        ("IDLE_ELIMINATED", F.col("idle_credits") > total * 0.2, F.col("idle_credits")),
        ("QUEUE_ELIMINATED", queued, F.col("queued_queries").cast("double")),
        ("MULTI_CLUSTER_REMOVED", F.col("max_clusters") > 1, F.col("max_clusters").cast("double")),
        ("LOW_UTILIZATION", F.col("utilization_pct") < 50, F.col("utilization_pct")),
        ("COST_REDUCTION", F.col("_saved_pct") > 20, F.col("_saved_pct")),
        ("QUEUED_LATENCY_IMPROVES", queued & (F.col("avg_latency_sec") > 0), F.col("avg_latency_sec")),
        ("UNSUPPORTED_SIZE", F.col("warehouse_size").isin(*UNSUPPORTED_SIZES), F.lit(None).cast("double")),
    ]
    hits = F.array_compact(
        F.array(*[F.when(rule, F.struct(F.lit(n).alias("finding"), v.alias("value"))) for n, rule, v in rules])
    )
    steady = F.array(F.struct(F.lit("STEADY_WORKLOAD").alias("finding"), F.lit(None).cast("double").alias("value")))
    return stats.withColumn("_hits", hits).select(
        "warehouse_name", F.inline(F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(steady))
    )


# Filter keys that differ from the canonical inventory columns.
PROPERTY_COLUMNS = {
    "warehouse_size": "warehouse_size",
    "max_query_performance_level": "max_query_perf_level",
    "query_throughput_multiplier": "throughput_multiplier",
    "max_cluster_count": "max_clusters",
    "min_cluster_count": "min_clusters",
}


def bulk_plan(
    inventory: DataFrame,
    property_filter: dict[str, str],
    tag_filter: dict[str, str] | None = None,
    tags: DataFrame | None = None,
    property_name: str = "WAREHOUSE_TYPE",
    new_value: str = ADAPTIVE,
) -> DataFrame:
    """Dry run of a bulk change: a summary row (``row_kind`` SUMMARY) and one row per selected pool.

    ``name`` is a regular expression for the whole name; other properties compare for equality; every tag must match.
    """
    chosen = inventory
    for key, value in property_filter.items():
        if key.lower() == "name":
            chosen = chosen.filter(F.col("warehouse_name").rlike(f"^(?:{value})$"))
        else:
            column = PROPERTY_COLUMNS.get(key.lower(), key.lower())
            chosen = chosen.filter(F.col(column).cast("string") == value)
    for tag, value in (tag_filter or {}).items():
        if tags is None:
            raise ValueError("a tag filter needs the tag references")
        tagged = tags.filter((F.col("tag_name") == tag) & (F.col("tag_value") == value)).select(
            F.col("object_name").alias("warehouse_name")
        )
        chosen = chosen.join(tagged, "warehouse_name", "left_semi")
    none = F.lit(None).cast("string")
    summary = chosen.agg(F.count(F.lit(1)).alias("total_warehouses")).select(
        F.lit("SUMMARY").alias("row_kind"),
        "total_warehouses",
        F.lit(property_name).alias("property_to_update"),
        F.lit(new_value).alias("property_value_to_set"),
        F.lit("dry-run").alias("mode"),
        none.alias("name"),
        none.alias("warehouse_size"),
        none.alias("max_query_performance_level"),
        none.alias("query_throughput_multiplier"),
    )
    details = chosen.select(
        F.lit("WAREHOUSE").alias("row_kind"),
        F.lit(None).cast("long").alias("total_warehouses"),
        none.alias("property_to_update"),
        none.alias("property_value_to_set"),
        none.alias("mode"),
        F.col("warehouse_name").alias("name"),
        F.col("warehouse_size").cast("string").alias("warehouse_size"),
        F.col("max_query_perf_level").cast("string").alias("max_query_performance_level"),
        F.col("throughput_multiplier").cast("string").alias("query_throughput_multiplier"),
    )
    return summary.unionByName(details)


def guardrail_coverage(inventory: DataFrame) -> DataFrame:
    """Pools with a monitor, with a tuned performance level, and with several clusters."""

    def filled(column: str) -> Column:
        if column not in inventory.columns:
            return F.lit(0).cast("long")
        return count_where(F.trim(F.col(column).cast("string")) != "")

    return inventory.agg(
        filled("resource_monitor").alias("with_resource_monitor"),
        filled("max_query_perf_level").alias("perf_level_tuned"),
        count_where(is_multi_cluster()).alias("multi_cluster"),
    )
