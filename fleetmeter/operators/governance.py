"""Audit trail, change requests, calendar and region reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from ..functions.intervals import with_cover
from ..functions.measures import count_where
from ..functions.times import instant
from ..sources import seeds

# Request states and the moves a request may make.
INITIAL_STATUS = "PENDING"
LEGAL_MOVES = {
    "PENDING": ["APPROVED", "REJECTED"],
    "APPROVED": ["EXECUTED"],
    "EXECUTED": ["ROLLED_BACK"],
}


def _field(df: DataFrame, column: str, name: str) -> Column:
    """A top-level text field of a JSON column, stored as VARIANT or as a string."""
    if isinstance(df.schema[column].dataType, VariantType):
        return F.variant_get(F.col(column), f"$.{name}", "string")
    return F.get_json_object(column, f"$.{name}")


def audit_recent(audit: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` entries; the JSON is parsed only for those."""
    newest = audit.orderBy(F.desc("event_timestamp"), F.desc("event_id")).limit(n)
    return newest.select(
        "event_timestamp", "username", "role_name", "event_type", "warehouse_name",
        _field(audit, "event_detail", "section").alias("detail"),
    )


def audit_kpis(audit: DataFrame) -> DataFrame:
    """Counts of the whole trail; pass ``audit_recent`` for those of its newest entries."""
    return audit.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("username").alias("unique_users"),
        count_where(F.col("event_type") == "SIMULATION").alias("simulations"),
    )


def requests_recent(requests: DataFrame, n: int = 30) -> DataFrame:
    return (
        requests.orderBy(F.desc("created_at"), F.desc("request_id"))
        .limit(n)
        .select(
            "request_id", "created_at", "requested_by", "warehouse_name", "status", "estimated_savings",
            "justification", "reviewed_by", "review_notes",
        )
    )


def request_status_counts(requests: DataFrame) -> DataFrame:
    """Counts of all requests; pass ``requests_recent`` for those of the newest."""
    status = F.col("status")
    return requests.agg(
        count_where(status == "PENDING").alias("pending"),
        count_where(status == "APPROVED").alias("approved"),
        count_where(status == "EXECUTED").alias("executed"),
        count_where(status == "REJECTED").alias("rejected"),
    )


def is_legal_move(previous: Column, status: Column) -> Column:
    legal = F.lit(False)
    for state, targets in LEGAL_MOVES.items():
        legal = legal | ((previous == state) & status.isin(targets))
    return F.coalesce(legal, F.lit(False))


def request_transitions(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Current state of every request after its status events, with the count of illegal moves.

    ``requests`` has one row per request; ``events`` has request_id, event_id, event_time, status, actor, notes. An
    illegal move is applied, as an unguarded update would, and counted. A request's few moves are ordered and folded in
    one partitioning by request.
    """
    moves = Window.partitionBy("request_id").orderBy("event_time", "event_id")
    before = F.coalesce("_before", F.lit(INITIAL_STATUS))
    state = (
        events.withColumn("_before", F.lag("status").over(moves))
        .groupBy("request_id")
        .agg(*state_measures("_status"), count_where(~is_legal_move(before, F.col("status"))).alias("illegal_moves"))
    )
    return (
        requests.select("request_id", "warehouse_name", "created_at", "requested_by")
        .join(state, "request_id", "left")
        .select(
            "request_id", "warehouse_name", "created_at", "requested_by",
            F.coalesce("_status", F.lit(INITIAL_STATUS)).alias("status"),
            "reviewed_by", "reviewed_at", "review_notes", "executed_at", "rollback_at",
            F.coalesce("illegal_moves", F.lit(0)).alias("illegal_moves"),
        )
    )


def state_measures(status: str) -> list[Column]:
    """A request's state from its events, by maxima: the order in which they arrive doesn't matter."""
    reviewed = F.col("status").isin("APPROVED", "REJECTED")
    review = F.max(F.when(reviewed, F.struct("event_time", "event_id", "actor", "notes")))

    def newest(which: str) -> Column:
        return F.max(F.when(F.col("status") == which, F.col("event_time")))

    return [
        F.max(F.struct("event_time", "event_id", "status")).getField("status").alias(status),
        review.getField("actor").alias("reviewed_by"),
        review.getField("event_time").alias("reviewed_at"),
        review.getField("notes").alias("review_notes"),
        newest("EXECUTED").alias("executed_at"),
        newest("ROLLED_BACK").alias("rollback_at"),
    ]


def with_calendar_windows(rows: DataFrame, day: str, calendar: DataFrame) -> DataFrame:
    """``rows`` with ``_windows`` and ``_first``: how many calendar windows cover the row's day and warehouse, and the first by name.

    A window is for the listed warehouses, or for everyone (``ALL``, or no list).
    """
    everyone = F.upper(F.trim("affected_warehouses")) == "ALL"
    listed = F.when(~everyone, F.transform(F.split("affected_warehouses", ","), lambda name: F.trim(name)))
    windows = calendar.select("event_name", "start_date", "end_date", listed.alias("_listed"))
    return with_cover(rows, windows, "warehouse_name", "_listed", F.to_date(day), "start_date", "end_date", "event_name")


def active_blackouts(calendar: DataFrame, as_of: str | datetime) -> DataFrame:
    return (
        calendar.filter((F.col("event_type") == "BLACKOUT") & (F.col("end_date") >= F.lit(instant(as_of).date())))
        .select("event_name", "start_date", "end_date", "notes")
        .orderBy("start_date", "event_name")
    )


def blackout_violations(requests: DataFrame, calendar: DataFrame) -> DataFrame:
    """Requests executed on a blackout day that covers their warehouse: a row each, with the number of windows and the
    first by name."""
    executed = requests.filter(F.col("executed_at").isNotNull()).select("request_id", "warehouse_name", "executed_at")
    blackouts = calendar.filter(F.col("event_type") == "BLACKOUT")
    return (
        with_calendar_windows(executed, "executed_at", blackouts)
        .filter(F.col("_windows") > 0)
        .select(
            "request_id", "warehouse_name", "executed_at", F.col("_windows").alias("blackout_windows"), F.col("_first").alias("first_window")
        )
    )


def calendar_upcoming(calendar: DataFrame, as_of: str | datetime) -> DataFrame:
    return (
        calendar.filter(F.col("end_date") >= F.lit(instant(as_of).date()))
        .select("event_name", "event_type", "start_date", "end_date", "expected_spike_factor", "notes")
        .orderBy("start_date", "event_name")
    )


def calendar_all(calendar: DataFrame) -> DataFrame:
    return calendar.select(
        "event_name", "event_type", "start_date", "end_date", "affected_warehouses", "expected_spike_factor",
        "suppress_anomaly", "notes",
    ).orderBy("start_date", "event_name")


def region_matrix(spark: SparkSession, regions: DataFrame | None = None) -> DataFrame:
    """Support matrix by cloud and region; the known regions where no table is deployed."""
    table = seeds.region_support(spark) if regions is None else regions
    return table.select("cloud_provider", "region", "region_display", "adaptive_ga", "adaptive_preview").orderBy(
        "cloud_provider", "region"
    )


def region_support(accounts: DataFrame, regions: DataFrame, empty_matches: bool = True) -> DataFrame:
    """Availability per account (columns ``account``, ``region`` such as CLOUD_PART_OF_NAME).

    A region matches when either name contains the other, dashes ignored; the first by name decides. Distinct regions
    are matched, not accounts, and the cloud is an equality key of that join. An account without a region part matches
    every region of its cloud unless ``empty_matches`` is off.
    """
    cloud = F.split_part("region", F.lit("_"), F.lit(1))
    rest = F.substring("region", F.length(cloud) + 2, F.length("region"))
    seen = accounts.select("region").distinct().select(
        "region",
        cloud.alias("cloud_provider"),
        F.translate(F.lower(rest), "_-", "").alias("_plain"),
    )
    known = regions.select(
        "cloud_provider",
        F.col("region").alias("_region"),
        F.translate("region", "-", "").alias("_known"),
        "adaptive_ga",
        "adaptive_preview",
    )
    contains = F.contains("_plain", "_known") | F.contains("_known", "_plain")
    if not empty_matches:
        contains = contains & (F.col("_plain") != "")
    best = (
        seen.join(known, "cloud_provider")
        .filter(contains)
        .groupBy("region")
        .agg(F.min(F.struct("_region", "adaptive_ga", "adaptive_preview")).alias("_match"))
    )
    status = (
        F.when(F.col("_match.adaptive_ga"), "GA").when(F.col("_match.adaptive_preview"), "PREVIEW").otherwise("UNAVAILABLE")
    )
    return accounts.join(best, "region", "left").select(
        "account", "region", cloud.alias("cloud"), F.col("_match._region").alias("matched_region"), status.alias("status")
    )
