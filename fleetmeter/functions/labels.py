"""Classifications. Every chain keeps the "everything else, NULL included" branch of the rule it states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and size names as the telemetry and the reports spell them.
ADAPTIVE = "ADAPTIVE"
STANDARD = "STANDARD"
COMPLEX_SIZES = ("X-Large", "2X-Large", "3X-Large", "4X-Large")
UNSUPPORTED_SIZES = ("5X-Large", "6X-Large")
SUSPEND_EVENTS = ("SUSPEND_WAREHOUSE", "SUSPEND_WAREHOUSE_SUCCEEDED")
RESUME_EVENTS = ("RESUME_WAREHOUSE", "RESUME_WAREHOUSE_SUCCEEDED")


def pool_type(size: str | Column = "warehouse_size") -> Column:
    """A query ran on an adaptive pool exactly when its recorded size says so."""
    size = F.col(size) if isinstance(size, str) else size
    return F.when(size == ADAPTIVE, ADAPTIVE).otherwise(STANDARD)


def period(start: str | Column, change: str | Column) -> Column:
    """PRE before the change, POST from the change on."""
    start = F.col(start) if isinstance(start, str) else start
    change = F.col(change) if isinstance(change, str) else change
    return F.when(start >= change, "POST").otherwise("PRE")


def load_window(start: str | Column) -> Column:
    """WEEKEND, PEAK (weekdays 09:00 to 17:59) or OFF_PEAK."""
    start = F.col(start) if isinstance(start, str) else start
    return (
        F.when(F.dayofweek(start).isin(1, 7), "WEEKEND")
        .when(F.hour(start).between(9, 17), "PEAK")
        .otherwise("OFF_PEAK")
    )


def sla_severity(priority: str | Column = "priority") -> Column:
    priority = F.col(priority) if isinstance(priority, str) else priority
    return F.when(priority == 1, "CRITICAL").when(priority == 2, "HIGH").when(priority == 3, "MEDIUM").otherwise("LOW")


def recommendation_band(score: str | Column) -> Column:
    """A NULL score (no usage, or a single metered hour) falls to KEEP STANDARD."""
    score = F.col(score) if isinstance(score, str) else score
    return (
        F.when(score >= 80, "MIGRATE NOW")
        .when(score >= 60, "STRONG CANDIDATE")
        .when(score >= 40, "EVALUATE")
        .otherwise("KEEP STANDARD")
    )


def health_status(usage_ratio: Column) -> Column:
    """A NULL ratio (no baseline) counts as HEALTHY."""
    return F.when(usage_ratio > 1.5, "WARNING").when(usage_ratio > 1.2, "REVIEW").otherwise("HEALTHY")


def is_multi_cluster(max_clusters: str | Column = "max_clusters") -> Column:
    """True when the value is all digits and above 1; never NULL."""
    text = F.trim((F.col(max_clusters) if isinstance(max_clusters, str) else max_clusters).cast("string"))
    return F.coalesce(text.rlike("^[0-9]+$") & (text.try_cast("long") > 1), F.lit(False))


def matches_any(column: str | Column, patterns: list[str]) -> Column:
    """Case-sensitive LIKE against any of ``patterns``; NULL counts as no match."""
    column = F.col(column) if isinstance(column, str) else column
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | column.like(pattern)
    return F.coalesce(hit, F.lit(False))


def first_match(column: str | Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first rule whose LIKE patterns match."""
    label = F.lit(default)
    for name, patterns in reversed(rules):
        label = F.when(matches_any(column, patterns), name).otherwise(label)
    return label
