"""SLA breach detection and reports.

The hourly figures depend only on (warehouse, hour). They are aggregated first; SLA patterns match distinct warehouse names, and
what matches meets the rolled-up hours by name: a pattern never meets a raw query.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import sla_severity
from ..functions.measures import count_where, ratio, seconds
from ..functions.patterns import matched
from ..functions.times import hour_of, last

BREACH_KEYS = ["warehouse_name", "workload_class", "breach_window", "breach_type"]
BREACH_COLUMNS = [
    "warehouse_name", "workload_class", "breach_type", "sla_threshold", "actual_value", "breach_window", "severity",
]
#: breach type -> (hourly measure, SLA column that limits it)
BREACH_TYPES = {
    "LATENCY": ("p95_sec", "max_p95_latency_sec"),
    "QUEUE": ("queue_sec", "max_queue_sec"),
    "ERROR_RATE": ("error_pct", "max_error_rate_pct"),
}


def sla_measures() -> list[Column]:
    """What the three breach types compare. A measure is NULL when its hour has no query of that kind."""
    ok = F.col("execution_status") == "SUCCESS"
    queued = F.col("queued_overload_time") > 0
    return [
        seconds(F.percentile(F.when(ok, F.col("total_elapsed_time")), F.lit(0.95))).alias("p95_sec"),
        seconds(F.avg(F.when(queued, F.col("queued_overload_time")))).alias("queue_sec"),
        (ratio(count_where(F.col("execution_status") == "FAIL"), F.count(F.lit(1))) * 100).alias("error_pct"),
    ]


def sla_hours(queries: DataFrame, as_of: str | datetime, hours: float = 2) -> DataFrame:
    """Per (warehouse, hour) measures of the look-back. It is not hour-aligned: its first hour may be partial."""
    rows = queries.filter(last(queries, "start_time", as_of, hours=hours) & F.col("warehouse_name").isNotNull())
    return rows.groupBy("warehouse_name", hour_of(rows).alias("breach_window")).agg(*sla_measures())


def breaches(hours: DataFrame, sla: DataFrame, *breach_types: str) -> DataFrame:
    """Rolled-up hours above the threshold of an active SLA whose LIKE pattern matches the warehouse.

    Any number of rules: patterns find warehouse names through an index (``functions/patterns.py``), and hours their rules by
    name. A warehouse with very many hours is the large side of that join, which adaptive execution splits.
    """
    limits = [BREACH_TYPES[t][1] for t in breach_types]
    rules = (
        sla.filter(F.col("is_active") & F.col("warehouse_pattern").isNotNull())
        .select("workload_class", "warehouse_pattern", sla_severity().alias("severity"), *[F.col(c).cast("double").alias(c) for c in limits])
        .distinct()
    )
    of_warehouse = matched(hours, "warehouse_name", rules, "warehouse_pattern")

    def breach(kind: str) -> Column:
        measure, limit = F.col(BREACH_TYPES[kind][0]), F.col(BREACH_TYPES[kind][1])
        found = F.struct(F.lit(kind).alias("breach_type"), limit.alias("sla_threshold"), measure.cast("double").alias("actual_value"))
        return F.when(measure > limit, found)

    judged = F.inline(F.array_compact(F.array(*[breach(kind) for kind in breach_types])))
    found = hours.join(of_warehouse, "warehouse_name").select("warehouse_name", "breach_window", "workload_class", "severity", judged)
    return found.select(BREACH_COLUMNS).distinct()  # two patterns of one class may both match


def sla_latency_breaches(queries: DataFrame, sla: DataFrame, as_of: str | datetime, hours: float = 2) -> DataFrame:
    """p95 of successful queries above the limit."""
    return breaches(sla_hours(queries, as_of, hours), sla, "LATENCY")


def sla_queue_breaches(queries: DataFrame, sla: DataFrame, as_of: str | datetime, hours: float = 2) -> DataFrame:
    """Mean queue time of the queued queries, whatever their outcome, above the limit."""
    return breaches(sla_hours(queries, as_of, hours), sla, "QUEUE")


def sla_error_rate_breaches(queries: DataFrame, sla: DataFrame, as_of: str | datetime, hours: float = 2) -> DataFrame:
    """Share of failed queries above the limit."""
    return breaches(sla_hours(queries, as_of, hours), sla, "ERROR_RATE")


def detect_sla_breaches(queries: DataFrame, sla: DataFrame, as_of: str | datetime, hours: float = 2) -> DataFrame:
    """The scheduled detection: latency and queue breaches from one rollup."""
    return breaches(sla_hours(queries, as_of, hours), sla, "LATENCY", "QUEUE")


def sla_definitions(sla: DataFrame) -> DataFrame:
    """All definitions; inactive ones are shown as such."""
    return sla.select(
        "workload_class", "warehouse_pattern", "max_p95_latency_sec", "max_queue_sec", "max_error_rate_pct",
        "priority", "escalation_contact", "is_active",
    ).orderBy("priority", "workload_class")


def recent_breaches(breach_log: DataFrame, as_of: str | datetime, days: int = 30, n: int = 50) -> DataFrame:
    return (
        breach_log.filter(last(breach_log, "detected_at", as_of, days=days))
        .orderBy(F.desc("detected_at"), *BREACH_KEYS)
        .limit(n)
        .select(
            "detected_at", "warehouse_name", "workload_class", "breach_type", "sla_threshold", "actual_value",
            "severity", "acknowledged",
        )
    )


def breach_counts(breach_rows: DataFrame) -> DataFrame:
    return breach_rows.agg(
        count_where(F.col("severity") == "CRITICAL").alias("critical_breaches"),
        count_where(F.col("severity") == "HIGH").alias("high_breaches"),
        F.count(F.lit(1)).alias("total_breaches"),
        count_where(~F.col("acknowledged")).alias("unacknowledged"),
    )
