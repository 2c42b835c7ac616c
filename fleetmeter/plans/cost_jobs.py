"""Rollup and cost jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison, cost, rollups
from ..sources import readers
from . import views as v
from .registry import big, query, r
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
HQ_COLUMNS = ", ".join(
    [
        "warehouse_name", "hour_ts", "query_count", r("avg_elapsed_ms"), r("p95_elapsed_ms"), r("total_queue_ms"),
        "queued_queries", "failed_queries", r("total_elapsed_failed_ms"), "complex_queries", r("latency_stddev"),
    ]
)


def hm(spark, sf):
    return rollups.hourly_metering(v.metering(spark, sf), AS_OF, 30)


def hq(spark, sf):
    return rollups.hourly_queries(v.query_history(spark, sf), AS_OF, 30)


def he(spark, sf):
    return rollups.hourly_events(v.events_history(spark, sf), AS_OF, 30)


def idle(spark, sf):
    return cost.idle_waste(hm(spark, sf), hq(spark, sf))


def _since(days: int, column: str = "start_time") -> str:
    return f"{column} >= {NOW} - INTERVAL {days} DAY"


@query("hourly_metering", f"SELECT warehouse_name, hour_ts, {r('credits')} FROM hm")
def hourly_metering(spark, sf):
    return hm(spark, sf)


@query("hourly_queries", f"SELECT {HQ_COLUMNS} FROM hq")
def hourly_queries(spark, sf):
    return hq(spark, sf)


@query("hourly_events", "SELECT warehouse_name, hour_ts, event_name, event_count FROM he")
def hourly_events(spark, sf):
    return he(spark, sf)


@query(
    "hourly_query_metrics",
    f"""SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts, count(*) AS query_count,
               {r('avg(total_elapsed_time) / 1000', 'avg_duration_sec')},
               {r('max(total_elapsed_time) / 1000', 'max_duration_sec')},
               {r('sum(queued_overload_time) / 1000', 'total_queue_sec')},
               count(*) FILTER (WHERE queued_overload_time > 0) AS queued_queries
        FROM query_history
        WHERE {_since(30)} AND warehouse_name IS NOT NULL AND execution_status = 'SUCCESS' GROUP BY 1, 2""",
)
def hourly_query_metrics(spark, sf):
    return rollups.hourly_query_metrics(v.query_history(spark, sf), AS_OF, 30)


@query(
    "tagged_hourly_metering",
    f"""SELECT warehouse_name, hour_ts, {r('credits')}, tag_cost_center
        FROM hm LEFT JOIN (SELECT object_name AS warehouse_name, max(tag_value) AS tag_cost_center FROM tag_references
                           WHERE domain = 'WAREHOUSE' AND tag_name = 'COST_CENTER' GROUP BY 1) USING (warehouse_name)""",
)
def tagged_hourly_metering(spark, sf):
    return rollups.tagged_hourly_metering(v.metering(spark, sf), v.tag_references(spark, sf), AS_OF, 30)


@query(
    "source_resolver",
    f"SELECT warehouse_name, hour_ts, {r('credits')} FROM hm",
)
def source_resolver(spark, sf):
    """No staged table is deployed here, so the raw computation answers."""
    return readers.resolve_source(spark, "fleetmeter_absent_hourly_metering", lambda: hm(spark, sf))


@query(
    "inventory_normalise",
    """SELECT warehouse_name, warehouse_type, state, warehouse_size, generation, max_query_perf_level,
              throughput_multiplier, min_clusters, max_clusters, auto_suspend, resource_monitor
       FROM (SELECT *, CAST(NULL AS VARCHAR) AS min_clusters FROM inventory)""",
)
def inventory_normalise(spark, sf):
    raw = v.raw_inventory(spark, sf).withColumn("min_cluster_count", F.lit(None).cast("string")).withColumn("owner", F.lit("x"))
    return readers.inventory_normalise(raw)


@query(
    "fleet_listing",
    """SELECT warehouse_name, warehouse_type, state, warehouse_size, max_clusters, auto_suspend, resource_monitor,
              generation, max_query_perf_level, throughput_multiplier FROM inventory""",
)
def fleet_listing(spark, sf):
    return readers.fleet_listing(v.inventory(spark, sf))


@query(
    "numeric_normalise",
    f"SELECT warehouse_name, start_time, {r('CAST(credits_used AS DOUBLE)', 'credits_used')} FROM metering",
)
def numeric_normalise(spark, sf):
    return readers.numeric_normalise(v.metering(spark, sf))


@query(
    "warehouse_filter",
    f"""SELECT warehouse_name, hour_ts, {r('credits')} FROM hm
        WHERE warehouse_name IN (SELECT warehouse_name FROM inventory WHERE warehouse_type = 'ADAPTIVE')""",
)
def warehouse_filter(spark, sf):
    inventory = v.inventory(spark, sf)
    return readers.warehouse_filter(hm(spark, sf), inventory.filter("warehouse_type = 'ADAPTIVE'"), inventory)


NAMES = ["TRADING_WH_8", "RISK_WH_1", "ETL_WH_4", "ANALYTICS_WH_5", "NONEXISTENT_WH_XYZ_12345"]
NAMES_SQL = ", ".join(f"'{n}'" for n in NAMES)


@query(
    "credit_usage",
    f"SELECT warehouse_name, hour_ts, {r('credits')} FROM hm WHERE warehouse_name IN ({NAMES_SQL})",
)
def credit_usage(spark, sf):
    return cost.credit_usage(hm(spark, sf), NAMES)


@query("credit_totals", f"SELECT warehouse_name, {r('sum(credits)', 'total_credits')} FROM hm GROUP BY 1")
def credit_totals(spark, sf):
    return cost.credit_totals(hm(spark, sf))


@query(
    "top_consumers",
    f"""SELECT warehouse_name, {r('total', 'total_credits')}, coalesce(warehouse_type, 'STANDARD') AS warehouse_type
        FROM (SELECT warehouse_name, sum(CAST(credits AS DECIMAL(18,2)))::DOUBLE AS total FROM hm GROUP BY 1
              ORDER BY 2 DESC, 1 LIMIT 6) LEFT JOIN inventory USING (warehouse_name)""",
)
def top_consumers(spark, sf):
    return cost.top_consumers(hm(spark, sf), v.inventory(spark, sf))


@query(
    "credit_distribution",
    f"""SELECT warehouse_name, {r('total', 'credits')} FROM (
          SELECT warehouse_name, sum(CAST(credits AS DECIMAL(18,2)))::DOUBLE AS total FROM hm GROUP BY 1
          ORDER BY 2 DESC, 1 LIMIT 8)""",
)
def credit_distribution(spark, sf):
    return cost.credit_distribution(hm(spark, sf))


@query(
    "daily_credit_trend",
    f"""SELECT date_trunc('day', start_time) AS day_ts, warehouse_name,
               {r('CAST(sum(credits_used) AS DOUBLE)', 'daily_credits')}
        FROM metering WHERE {_since(30)} GROUP BY 1, 2""",
)
def daily_credit_trend(spark, sf):
    return cost.daily_credit_trend(v.metering(spark, sf), AS_OF)


@query(
    "hourly_metering_stats",
    f"""SELECT date_trunc('hour', start_time) AS hour_ts, warehouse_name, count(*) AS metering_events,
               {r('CAST(sum(credits_used) AS DOUBLE)', 'total_credits')},
               {r('CAST(sum(credits_used) AS DOUBLE) / count(*)', 'avg_credits_per_entry')}
        FROM metering WHERE {_since(7)} GROUP BY 1, 2""",
)
def hourly_metering_stats(spark, sf):
    return cost.hourly_metering_stats(v.metering(spark, sf), AS_OF)


@query(
    "weekly_scorecard",
    f"""SELECT warehouse_name, {r('CAST(min(w) AS DOUBLE)', 'min_weekly_credits')},
               {r('CAST(max(w) AS DOUBLE)', 'max_weekly_credits')},
               {r('CAST(sum(w) AS DOUBLE) / count(*)', 'avg_weekly_credits')}
        FROM (SELECT warehouse_name, date_trunc('week', start_time) AS week_ts, sum(credits_used) AS w
              FROM metering WHERE {_since(28)} GROUP BY 1, 2) GROUP BY 1""",
)
def weekly_scorecard(spark, sf):
    return cost.weekly_scorecard(v.metering(spark, sf), AS_OF)


TAG_ROWS = "SELECT object_name AS warehouse_name, tag_value FROM tag_references WHERE domain = 'WAREHOUSE' AND tag_name = 'COST_CENTER'"


def _attribution_sql(tags: str) -> str:
    return f"""SELECT coalesce(tag_value, 'Untagged') AS cost_center, warehouse_name,
                      round(CAST(sum(credits_used) AS DOUBLE), 2) AS total_credits,
                      round(CAST(sum(credits_used) AS DOUBLE) * 3.0, 2) AS estimated_cost_usd
               FROM metering LEFT JOIN ({tags}) USING (warehouse_name) WHERE {_since(30)} GROUP BY 1, 2"""


ONE_TAG = f"SELECT warehouse_name, max(tag_value) AS tag_value FROM ({TAG_ROWS}) GROUP BY 1"


@query(
    "tag_attribution",
    f"SELECT cost_center, warehouse_name, {r('total_credits')}, {r('estimated_cost_usd')} FROM ({_attribution_sql(ONE_TAG)})",
)
def tag_attribution(spark, sf):
    return cost.tag_attribution(v.metering(spark, sf), v.tag_references(spark, sf), AS_OF, 30)


@query(
    "tag_attribution_every_tag",
    f"SELECT cost_center, warehouse_name, {r('total_credits')}, {r('estimated_cost_usd')} FROM ({_attribution_sql(TAG_ROWS)})",
)
def tag_attribution_every_tag(spark, sf):
    """Each tag row charged in full, as a join before the sum does."""
    return cost.tag_attribution(v.metering(spark, sf), v.tag_references(spark, sf), AS_OF, 30, every_tag=True)


@query(
    "tag_summary",
    f"""SELECT cost_center, {r('total_credits')}, {r('estimated_cost_usd')}
        FROM (SELECT cost_center, sum(CAST(total_credits AS DECIMAL(18,2)))::DOUBLE AS total_credits,
                     sum(CAST(estimated_cost_usd AS DECIMAL(18,2)))::DOUBLE AS estimated_cost_usd
              FROM ({_attribution_sql(ONE_TAG)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
)
def tag_summary(spark, sf):
    return cost.tag_summary(tag_attribution(spark, sf))


RATE_SQL = f"""SELECT effective_rate FROM rate_sheet_daily WHERE service_type = 'WAREHOUSE_METERING' AND usage_type = 'compute'
               AND date >= DATE '2024-01-31' - 7 AND effective_rate > 0 ORDER BY date DESC LIMIT 1"""
DERIVED_SQL = """SELECT round(sum(usage_in_currency) / NULLIF(sum(usage), 0), 2) FROM usage_in_currency_daily
                 WHERE usage_type = 'compute' AND usage_date >= DATE '2024-01-31' - 7 AND usage > 0"""


PRICE_SQL = f"SELECT coalesce(({RATE_SQL}), ({DERIVED_SQL}), 3.0)"


@query("credit_price", f"SELECT {r(f'({PRICE_SQL})', 'credit_price')}")
def credit_price(spark, sf):
    return cost.credit_price(v.rate_sheet_daily(spark, sf), v.usage_in_currency_daily(spark, sf), AS_OF)


@query("credit_price_from_currency", f"SELECT {r(f'coalesce(({DERIVED_SQL}), 3.0)', 'credit_price')}")
def credit_price_from_currency(spark, sf):
    """No positive rate: the price follows from money per unit."""
    unpriced = v.rate_sheet_daily(spark, sf).withColumn("effective_rate", F.col("effective_rate") * 0)
    return cost.credit_price(unpriced, v.usage_in_currency_daily(spark, sf), AS_OF)


@query(
    "idle_waste",
    f"SELECT warehouse_name, {r('total_credits')}, {r('idle_credits')}, total_hours, idle_hours FROM idle",
)
def idle_waste(spark, sf):
    return idle(spark, sf)


@query(
    "idle_waste_priced",
    f"""SELECT warehouse_name, {r('total_credits')}, {r('idle_credits')}, total_hours, idle_hours,
               {r('round_even(idle_credits / total_credits * 100, 1)', 'idle_pct')},
               {r(f'round_even(idle_credits * ({PRICE_SQL}), 2)', 'wasted_usd')} FROM idle""",
)
def idle_waste_priced(spark, sf):
    return cost.idle_waste_priced(idle(spark, sf), credit_price(spark, sf))


@query(
    "savings_projection",
    f"""SELECT {r('total', 'total_credits')}, {r('idle_sum', 'idle_credits')},
               {r('round_even(idle_sum / total * 100, 1)', 'idle_pct')}, {r('std', 'standard_credits')},
               {r('std * 0.25', 'projected_savings_credits')}, {r(f'std * 0.25 * ({PRICE_SQL})', 'projected_savings_usd')},
               {r(f'std * 0.25 * ({PRICE_SQL}) * 365 / 30', 'annual_savings_usd')}
        FROM (SELECT sum(total_credits) AS total, sum(idle_credits) AS idle_sum,
                     sum(total_credits) FILTER (WHERE warehouse_type = 'STANDARD') AS std
              FROM idle LEFT JOIN inventory USING (warehouse_name))""",
)
def savings_projection(spark, sf):
    return cost.savings_projection(idle(spark, sf), v.inventory(spark, sf), price=credit_price(spark, sf), days=30)


GL_ACTIVE = "SELECT * FROM gl_code_mapping WHERE effective_to >= DATE '2024-01-31'"


@query(
    "gl_mappings_active",
    f"""SELECT warehouse_name, gl_code, cost_center, department, business_line, {r('allocation_pct')}, effective_from,
               approved_by FROM ({GL_ACTIVE})""",
)
def gl_mappings_active(spark, sf):
    return cost.gl_mappings_active(v.gl_code_mapping(spark, sf), AS_OF)


@query(
    "gl_chargeback",
    f"""SELECT coalesce(gl_code, 'UNALLOCATED') AS gl_code, coalesce(business_line, 'Unassigned') AS business_line,
               {r('sum(total * coalesce(allocation_pct, 100) / 100)', 'allocated_credits')},
               {r('sum(total * coalesce(allocation_pct, 100) / 100 * price)', 'allocated_cost')}
        FROM (SELECT warehouse_name, sum(credits) AS total FROM hm GROUP BY 1)
        LEFT JOIN ({GL_ACTIVE}) USING (warehouse_name), ({PRICE_SQL} AS price) GROUP BY 1, 2""",
)
def gl_chargeback(spark, sf):
    return cost.gl_chargeback(cost.credit_totals(hm(spark, sf)), gl_mappings_active(spark, sf), credit_price(spark, sf))


@query(
    "usage_baseline_stats",
    f"""SELECT warehouse_name, {r('CAST(sum(credits_used) AS DOUBLE)', 'credits_7d')},
               {r('CAST(sum(credits_used) AS DOUBLE) / count(*)', 'avg_hourly')},
               {r('CAST(max(credits_used) AS DOUBLE)', 'peak_hourly')}, {r('CAST(min(credits_used) AS DOUBLE)', 'min_hourly')},
               {r('stddev_samp(CAST(credits_used AS DOUBLE)) / NULLIF(CAST(sum(credits_used) AS DOUBLE) / count(*), 0)', 'coefficient_of_variation')}
        FROM metering WHERE {_since(7)} GROUP BY 1""",
)
def usage_baseline_stats(spark, sf):
    return cost.usage_baseline_stats(v.metering(spark, sf), AS_OF)


@query(
    "idle_ratio",
    f"""SELECT warehouse_name, count(DISTINCT date_trunc('hour', start_time)) AS active_hours, {big('168', 'total_hours')},
               {r("round((1 - count(DISTINCT date_trunc('hour', start_time)) / (7.0 * 24)) * 100, 1)", 'idle_pct')}
        FROM metering WHERE {_since(7)} GROUP BY 1""",
)
def idle_ratio(spark, sf):
    return cost.idle_ratio(v.metering(spark, sf), AS_OF)


@query(
    "rolling_cost",
    f"""SELECT warehouse_name, run_date, {r('CAST(c AS DOUBLE)', 'daily_credits')},
               {r('CAST(sum(c) OVER w AS DOUBLE) / count(*) OVER w', 'rolling_7d_avg')}
        FROM (SELECT warehouse_name, CAST(start_time AS DATE) AS run_date, sum(credits_used) AS c
              FROM metering WHERE {_since(14)} GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY warehouse_name ORDER BY run_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def rolling_cost(spark, sf):
    return cost.rolling_cost(v.metering(spark, sf), AS_OF)


@query(
    "schedule_pattern",
    f"""SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts, count(*) AS queries,
               {r('sum(total_elapsed_time) / 1000 / 60', 'total_runtime_min')},
               {r('CAST(sum(credits_used_cloud_services) AS DOUBLE)', 'credits')}
        FROM query_history WHERE {_since(7)} AND warehouse_name IS NOT NULL GROUP BY 1, 2""",
)
def schedule_pattern(spark, sf):
    return cost.schedule_pattern(v.query_history(spark, sf), AS_OF)


@query(
    "monthly_savings_report",
    f"""SELECT warehouse_name, {r('round(sum(baseline_daily_credits), 0)', 'baseline_credits')},
               {r('round(sum(actual_credits), 0)', 'actual_credits')},
               {r('round(sum(baseline_daily_credits) - sum(actual_credits), 0)', 'credits_saved')},
               concat(CAST(CAST(round(avg(savings_pct), 1) AS DECIMAL(28,1)) AS VARCHAR), '%') AS avg_savings
        FROM daily_savings WHERE day_ts >= date_trunc('month', {NOW}) GROUP BY 1""",
)
def monthly_savings_report(spark, sf):
    compared = comparison.credit_comparison(v.metering(spark, sf), v.migration_log(spark, sf))
    return cost.monthly_savings_report(comparison.daily_savings(compared), AS_OF)


USED_7D = f"SELECT warehouse_name, CAST(sum(credits_used) AS DOUBLE) AS used FROM metering WHERE {_since(7)} GROUP BY 1"


@query(
    "capture_baseline",
    f"""SELECT warehouse_name, {r('coalesce(used, 0)', 'baseline_credits_7d')}
        FROM inventory LEFT JOIN ({USED_7D}) USING (warehouse_name)""",
)
def capture_baseline(spark, sf):
    return cost.capture_baseline(v.metering(spark, sf), AS_OF, v.inventory(spark, sf))


@query(
    "refresh_baseline",
    f"""SELECT warehouse_name, action, migrated_at,
               {r("CASE WHEN action = 'MIGRATE' THEN used ELSE baseline_credits_7d END", 'baseline_credits_7d')}
        FROM migration_log LEFT JOIN ({USED_7D}) USING (warehouse_name)""",
)
def refresh_baseline(spark, sf):
    return cost.refresh_baseline(v.migration_log(spark, sf), v.metering(spark, sf), AS_OF).select(
        "warehouse_name", "action", "migrated_at", "baseline_credits_7d"
    )
