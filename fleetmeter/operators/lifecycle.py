"""Migration log operators: records, health, rollback decisions. One plan decides for every warehouse."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ADAPTIVE, STANDARD, health_status
from ..functions.measures import fixed, ratio, rounded, total
from ..functions.times import instant, last
from .cost import capture_baseline

DEFAULT_REASON = "Manual rollback requested"


def latest_migrations(log: DataFrame, exclude_rolled_back: bool = False) -> DataFrame:
    """Newest MIGRATE row per warehouse, as an aggregate: no warehouse's log is collected or sorted in one task."""
    newest = (
        log.groupBy("warehouse_name")
        .agg(
            F.max(
                F.when(F.col("action") == "MIGRATE", F.struct("migrated_at", "baseline_credits_7d"))
            ).alias("_migrate"),
            F.max(F.when(F.col("action") == "ROLLBACK", F.col("migrated_at"))).alias("_rollback"),
        )
        .filter(F.col("_migrate").isNotNull())
    )
    if exclude_rolled_back:
        newest = newest.filter(F.col("_rollback").isNull() | (F.col("_rollback") < F.col("_migrate.migrated_at")))
    return newest.select("warehouse_name", "_migrate.migrated_at", "_migrate.baseline_credits_7d")


def health_check(log: DataFrame, metering: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    rows = metering.filter(last(metering, "start_time", as_of, days=days))
    used = rows.groupBy("warehouse_name").agg(total("credits_used").alias("_current"))
    current = F.coalesce("_current", F.lit(0.0))
    change = ratio(current, F.col("baseline_credits_7d"))
    today = F.lit(instant(as_of).date())
    return (
        latest_migrations(log)
        .join(used, "warehouse_name", "left")
        .select(
            "warehouse_name",
            F.datediff(today, F.to_date("migrated_at")).cast("double").alias("days_since_migration"),
            "baseline_credits_7d",
            current.alias("current_credits_7d"),
            rounded((change - 1) * 100, 1).alias("credit_change_pct"),
            health_status(change).alias("status"),
        )
    )


def conditional_rollback(
    log: DataFrame, metering: DataFrame, as_of: str | datetime, threshold_pct: float = 50.0, hours: int = 6
) -> DataFrame:
    """ROLLBACK where the hourly rate is strictly more than ``threshold_pct`` above baseline, else NO ACTION.

    No baseline gives a NULL change and NO ACTION. Recording the rollback is ``rollback_record`` + an append.
    """
    rows = metering.filter(last(metering, "start_time", as_of, hours=hours))
    used = rows.groupBy("warehouse_name").agg(total("credits_used").alias("_current"))
    hourly = F.coalesce("_current", F.lit(0.0)) / hours
    change = (ratio(hourly, F.col("baseline_credits_7d") / 7 / 24) - 1) * 100
    shown = fixed(F.col("_change"), 1)
    return (
        latest_migrations(log)
        .join(used, "warehouse_name", "left")
        .withColumn("_change", change)
        .select(
            "warehouse_name",
            (F.col("baseline_credits_7d") / 7 / 24).alias("baseline_hourly"),
            hourly.alias("current_hourly"),
            rounded("_change", 1).alias("credit_change_pct"),
            F.when(F.col("_change") > threshold_pct, "ROLLBACK").otherwise("NO ACTION").alias("decision"),
            F.when(
                F.col("_change") > threshold_pct,
                F.concat(F.lit("ROLLED BACK: Credits were "), shown, F.lit("% above baseline")),
            )
            .otherwise(
                F.concat(
                    F.lit("NO ACTION: Credits at "), shown, F.lit(f"% vs baseline (threshold: {threshold_pct:g}%)")
                )
            )
            .alias("message"),
        )
    )


def migrate_record(names: DataFrame, metering: DataFrame, as_of: str | datetime, by: str | None = None) -> DataFrame:
    """Log rows for migrating ``names``, each with its baseline. The id is set on append."""
    return capture_baseline(metering, as_of, names).select(
        "warehouse_name",
        F.lit("MIGRATE").alias("action"),
        F.lit(STANDARD).alias("previous_type"),
        F.lit(ADAPTIVE).alias("new_type"),
        F.lit(by).cast("string").alias("migrated_by"),
        F.lit(instant(as_of).isoformat(sep=" ")).cast("timestamp_ntz").alias("migrated_at"),
        "baseline_credits_7d",
        F.concat(F.lit("Baseline: "), fixed(F.col("baseline_credits_7d"), 2), F.lit(" credits over 7 days")).alias("notes"),
    )


def rollback_record(
    names: DataFrame, as_of: str | datetime, reason: str = DEFAULT_REASON, by: str | None = None
) -> DataFrame:
    """Log rows for reverting ``names``; a ``reason`` column of ``names`` wins over the argument."""
    note = F.col("reason") if "reason" in names.columns else F.lit(reason)
    return names.select(
        "warehouse_name",
        F.lit("ROLLBACK").alias("action"),
        F.lit(ADAPTIVE).alias("previous_type"),
        F.lit(STANDARD).alias("new_type"),
        F.lit(by).cast("string").alias("migrated_by"),
        F.lit(instant(as_of).isoformat(sep=" ")).cast("timestamp_ntz").alias("migrated_at"),
        F.lit(None).cast("double").alias("baseline_credits_7d"),
        note.alias("notes"),
    )


def migration_history(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("migrated_at"), "warehouse_name", "action")
