"""Acceptance checks after a migration, and rule-based data-quality checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ADAPTIVE
from ..functions.measures import count_where, fixed, ratio, seconds, total
from ..functions.times import last
from .lifecycle import latest_migrations

# Results and states the checks report and accept.
WARN_QUEUE = "WARN - consider increasing QUERY_THROUGHPUT_MULTIPLIER"
WAITING = "WAITING - no adaptive queries recorded yet (latency up to 45 min)"
STATES_BY_TYPE = {
    "STANDARD": ["STARTED", "SUSPENDED", "RESIZING"],
    "ADAPTIVE": ["ENABLED", "DISABLED"],
}


def _migrated(log: DataFrame) -> DataFrame:
    return log.filter(F.col("action") == "MIGRATE").select("warehouse_name").distinct()


def _recent_migrated(queries: DataFrame, log: DataFrame, as_of: str | datetime, hours: int, *figures: Column) -> DataFrame:
    """Aggregate the last hours per warehouse, then keep the migrated ones."""
    rows = queries.filter(last(queries, "start_time", as_of, hours=hours) & F.col("warehouse_name").isNotNull())
    return rows.groupBy("warehouse_name").agg(*figures).join(_migrated(log), "warehouse_name", "left_semi")


def validate_type(inventory: DataFrame, log: DataFrame) -> DataFrame:
    return inventory.join(_migrated(log), "warehouse_name", "left_semi").select(
        F.lit("T1_WAREHOUSE_TYPE").alias("test"),
        "warehouse_name",
        F.when(F.col("warehouse_type") == ADAPTIVE, "PASS").otherwise("FAIL").alias("result"),
        F.concat("warehouse_type", F.lit(" (state: "), "state", F.lit(")")).alias("detail"),
    )


def validate_error_rate(queries: DataFrame, log: DataFrame, as_of: str | datetime, hours: int = 6) -> DataFrame:
    share = ratio(count_where(F.col("execution_status") != "SUCCESS"), F.count(F.lit(1)))
    return _recent_migrated(queries, log, as_of, hours, share.alias("_share")).select(
        F.lit("T2_ERROR_RATE").alias("test"),
        "warehouse_name",
        F.when(F.col("_share") < 0.01, "PASS").otherwise("FAIL").alias("result"),
        F.concat(fixed(F.col("_share") * 100, 2), F.lit("% error rate")).alias("detail"),
    )


def validate_queue(queries: DataFrame, log: DataFrame, as_of: str | datetime, hours: int = 6) -> DataFrame:
    longest = F.max("queued_overload_time")
    return _recent_migrated(queries, log, as_of, hours, longest.alias("_longest")).select(
        F.lit("T3_QUEUE_TIME").alias("test"),
        "warehouse_name",
        F.when(F.col("_longest") < 30000, "PASS").otherwise(WARN_QUEUE).alias("result"),
        F.concat(fixed(seconds(F.col("_longest")), 1), F.lit("s max queue")).alias("detail"),
    )


def validate_credit_range(log: DataFrame, metering: DataFrame, as_of: str | datetime, hours: int = 6) -> DataFrame:
    """Credits of the last hours against 1.5 times the baseline of the latest migration."""
    rows = metering.filter(last(metering, "start_time", as_of, hours=hours))
    used = rows.groupBy("warehouse_name").agg(total("credits_used").alias("_used"))
    expected = F.col("baseline_credits_7d") / 7 / 24 * hours
    return (
        latest_migrations(log)
        .join(used, "warehouse_name", "left")
        .withColumn("_used", F.coalesce("_used", F.lit(0.0)))
        .select(
            F.lit("T4_CREDIT_RANGE").alias("test"),
            "warehouse_name",
            F.when(F.col("_used") <= expected * 1.5, "PASS").otherwise("WARN").alias("result"),
            F.concat(
                fixed(F.col("_used"), 2), F.lit(f" credits ({hours}h) vs "), fixed(expected, 2), F.lit(" baseline")
            ).alias("detail"),
        )
    )


def validate_adaptive_queries(queries: DataFrame, log: DataFrame, as_of: str | datetime, hours: int = 6) -> DataFrame:
    figures = [
        count_where(F.col("warehouse_size") == ADAPTIVE).alias("_adaptive"), F.count(F.lit(1)).alias("_all"),
    ]
    return _recent_migrated(queries, log, as_of, hours, *figures).select(
        F.lit("T5_ADAPTIVE_QUERIES").alias("test"),
        "warehouse_name",
        F.when(F.col("_adaptive") > 0, "PASS").otherwise(WAITING).alias("result"),
        F.concat(F.col("_adaptive").cast("string"), F.lit(" adaptive queries / "), F.col("_all").cast("string"), F.lit(" total")).alias("detail"),
    )


def validate_log(log: DataFrame) -> DataFrame:
    return log.agg(count_where(F.col("action") == "MIGRATE").alias("_n")).select(
        F.lit("T6_MIGRATION_LOG").alias("test"),
        F.when(F.col("_n") > 0, "PASS").otherwise("FAIL - no migrations recorded").alias("result"),
        F.concat(F.col("_n").cast("string"), F.lit(" migration(s) recorded")).alias("detail"),
    )


def invariant_checks(df: DataFrame, rules: dict[str, Column | str], need_rows: str | None = None) -> DataFrame:
    """Check many rules in one pass: (test_id, result, violations).

    ``rules`` maps a test id to the condition that violates it (Column or SQL text); NULL is no violation.
    ``need_rows`` names an extra test that fails on an empty input.
    """
    conditions = {k: F.expr(v) if isinstance(v, str) else v for k, v in rules.items()}
    found = [count_where(condition).alias(test) for test, condition in conditions.items()]
    if need_rows:
        found.append(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias(need_rows))
    counts = df.agg(*found)
    return counts.unpivot([], counts.columns, "test_id", "violations").select(
        "test_id", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("result"), "violations"
    )


def metering_rules(df: DataFrame, as_of: str | datetime, days: int = 7, column: str = "hour_ts") -> dict[str, Column | str]:
    """Hourly credits: non-negative, named, and inside the look-back (one day of slack)."""
    return {
        "credits_non_negative": "credits < 0",
        "warehouse_not_null": "warehouse_name IS NULL",
        "time_range": ~last(df, column, as_of, days=days + 1),
    }


# Violation conditions of the rollup, comparison, log and score checks.
PERFORMANCE_RULES = {
    "latency_positive": "avg_latency_sec < 0",
    "p95_at_least_average": "query_count > 10 AND p95_latency_sec < avg_latency_sec",
    "query_count_positive": "query_count <= 0",
    "queue_non_negative": "avg_queue_sec < 0",
    "period_values": "period NOT IN ('PRE', 'POST')",
}
POOL_TYPE_RULES = {
    "type_values": "warehouse_type NOT IN ('ADAPTIVE', 'STANDARD')",
    "query_count_non_negative": "query_count < 0",
    "latency_non_negative": "avg_latency_sec < 0",
    "queue_non_negative": "avg_queue_sec < 0",
}
SAVINGS_RULES = {
    "baseline_not_null": "baseline_daily_credits IS NULL",
    "actual_not_null": "actual_credits IS NULL",
}
LOG_RULES = {
    "warehouse_not_null": "warehouse_name IS NULL",
    "action_not_null": "action IS NULL",
    "migrated_by_not_null": "migrated_by IS NULL",
    "migrated_at_not_null": "migrated_at IS NULL",
    "action_values": "action NOT IN ('MIGRATE', 'ROLLBACK')",
}
SCORE_RULES = {"score_not_below_0": "adaptive_score < 0", "score_not_above_100": "adaptive_score > 100"}
INVENTORY_RULES = {
    "type_values": "warehouse_type NOT IN ('STANDARD', 'ADAPTIVE')",
    "name_not_null": "warehouse_name IS NULL",
}


def allocation_rules() -> dict[str, str]:
    """Per warehouse (see ``allocation_totals``): percentages must add up to 100."""
    return {"allocation_complete": "abs(allocated_pct - 100) > 0.000001"}


def allocation_totals(active_gl: DataFrame) -> DataFrame:
    return active_gl.groupBy("warehouse_name").agg(F.sum("allocation_pct").alias("allocated_pct"))


def state_by_type_check(inventory: DataFrame) -> DataFrame:
    """States that do not belong to the pool's type; a new state only warns."""
    odd = F.lit(False)
    for kind, states in STATES_BY_TYPE.items():
        odd = odd | ((F.col("warehouse_type") == kind) & ~F.col("state").isin(states))
    return inventory.agg(count_where(odd).alias("violations")).select(
        F.lit("state_values").alias("test_id"),
        F.when(F.col("violations") == 0, "PASS").otherwise("WARN: some states unexpected (may have new state values)").alias("result"),
        "violations",
    )


def cross_view_consistency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Do two reports cover equally many warehouses?"""
    both = a.select("warehouse_name", F.lit("a").alias("_side")).unionByName(
        b.select("warehouse_name", F.lit("b").alias("_side"))
    ).distinct()
    return both.agg(
        count_where((F.col("_side") == "a") & F.col("warehouse_name").isNotNull()).alias("warehouses_a"),
        count_where((F.col("_side") == "b") & F.col("warehouse_name").isNotNull()).alias("warehouses_b"),
    ).select(
        F.when(F.col("warehouses_a") == F.col("warehouses_b"), "PASS")
        .otherwise("WARN: different warehouse counts between views (may be due to query history latency)")
        .alias("result"),
        "warehouses_a",
        "warehouses_b",
    )
