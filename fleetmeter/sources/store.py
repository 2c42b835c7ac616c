"""Stored hourly tables: incremental refresh, upsert, append, retention.

A table is a folder of Parquet files partitioned by ``day`` (the date of ``hour_ts``) and sorted by hour and
warehouse inside, so look-backs prune whole days and row groups. Plain Parquet has no MERGE: an upsert rewrites only the
days it touches, staged beside the table and swapped in by a publication that the next writer can finish
(``publication.py``). One writer per table is assumed, as with the scheduled refresh. Checkpoint files of finished
runs go away with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from ..functions.times import HOUR, instant, moment
from ..operators.rollups import (
    event_measures, events_by_hour, metering_by_hour, metering_measures, queries_by_hour, query_measures, with_cost_center,
)
from ..session import shared_dir
from . import publication, schemas
from .readers import read_or_empty

EPOCH = datetime(2020, 1, 1)
LATENESS = timedelta(hours=2)
HORIZON = timedelta(days=30)
RETENTION_DAYS = 31


@dataclass(frozen=True)
class HourlyTable:
    """One stored rollup: schema, merge keys, source time column, and the aggregate (and its measures) that feed it."""

    name: str
    schema: StructType
    keys: tuple[str, ...]
    time_column: str
    aggregate: Callable[[DataFrame], DataFrame]
    measures: Callable[[], list[Column]]

    @property
    def stored_schema(self) -> StructType:
        return StructType([*self.schema.fields, StructField("day", DateType())])


METERING = HourlyTable(
    "hourly_metering", schemas.HOURLY_METERING, ("warehouse_name", "hour_ts"), "start_time", metering_by_hour,
    metering_measures,
)
QUERIES = HourlyTable(
    "hourly_queries", schemas.HOURLY_QUERIES, ("warehouse_name", "hour_ts"), "start_time", queries_by_hour,
    query_measures,
)
EVENTS = HourlyTable(
    "hourly_events", schemas.HOURLY_EVENTS, ("warehouse_name", "hour_ts", "event_name"), "timestamp", events_by_hour,
    event_measures,
)
TABLES = (METERING, QUERIES, EVENTS)


def load(spark: SparkSession, path: str, table: HourlyTable, since: datetime | None = None) -> DataFrame:
    """The stored rows without the partition column; ``since`` prunes whole days first."""
    stored = read_or_empty(spark, path, table.stored_schema)
    if since is not None:
        stored = stored.filter((F.col("day") >= F.lit(since.date())) & (F.col("hour_ts") >= moment(stored, "hour_ts", since)))
    return stored.drop("day")


def watermark(spark: SparkSession, path: str, table: HourlyTable) -> datetime:
    """The newest stored hour, or the epoch. One scalar reaches the driver; only the newest day's files are read."""
    days = stored_days(spark, path)
    if not days:
        return EPOCH
    stored, newest = read_or_empty(spark, path, table.stored_schema), max(days)
    return stored.filter(F.col("day") == F.lit(newest)).agg(F.max("hour_ts")).first()[0]


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """The days a table has a folder for, by listing them."""
    return publication.days_in(publication.Folder(spark, path))


def window_start(mark: datetime, as_of: str | datetime) -> datetime:
    """First hour to re-read: two hours before the watermark, at most 30 days back, always a full hour.

    An unaligned 30-day cap would overwrite a stored full hour by a partial one.
    """
    cap = (instant(as_of) - HORIZON).replace(minute=0, second=0, microsecond=0)
    if instant(as_of) - HORIZON > cap:
        cap += HOUR
    return max(mark - LATENESS, cap)


def incremental_window(source: DataFrame, column: str, mark: datetime, as_of: str | datetime) -> DataFrame:
    """Source rows to re-aggregate. The bound is a full hour, so it applies to the raw time and reaches the scan."""
    start = window_start(mark, as_of)
    return source.filter(
        (F.col(column) >= moment(source, column, start)) & (F.col(column) <= moment(source, column, instant(as_of)))
    )


def stamped(rows: DataFrame, table: HourlyTable, loaded_at: str | datetime) -> DataFrame:
    """``rows`` in the table's stored layout; columns they lack become NULL."""
    at = F.lit(instant(loaded_at).isoformat(sep=" "))
    columns = []
    for f in table.schema.fields:
        value = at if f.name == "_loaded_at" else F.col(f.name) if f.name in rows.columns else F.lit(None)
        columns.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*columns, F.to_date("hour_ts").alias("day"))


def merge_upsert(
    spark: SparkSession, path: str, table: HourlyTable, updates: DataFrame, since: datetime, loaded_at: str | datetime
) -> None:
    """Replace rows with equal keys, add the others, leave the rest. All updates lie at or after ``since``.

    Only days that have an update are read and rewritten.
    """
    shared_dir(spark)
    publication.recover(spark, path)
    new = stamped(updates, table, loaded_at)
    kept = (
        read_or_empty(spark, path, table.stored_schema)
        .filter(F.col("day") >= F.lit(since.date()))
        .join(new.select("day").distinct(), "day", "left_semi")
        .join(new.select(*table.keys), list(table.keys), "left_anti")
        .select(new.columns)
    )
    # the checkpoint is written to the shared folder: ordering the rows by range samples them, and reads them there
    publication.publish(spark, path, _ordered(kept.unionByName(new).checkpoint(eager=True)))


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("day", "hour_ts", "warehouse_name").sortWithinPartitions("day", "hour_ts", "warehouse_name")


def merge_insert_only(
    spark: SparkSession, path: str, schema: StructType, updates: DataFrame, keys: list[str], day_of: str | None = None
) -> None:
    """Append the updates whose keys are new. A stored row is never changed, so the first verdict stands.

    With ``day_of``, one of the keys, the table is partitioned by that column's date and only the days from the oldest
    update on are read.
    """
    found = updates.dropDuplicates(keys)
    if day_of is None:
        fresh = found.join(read_or_empty(spark, path, schema).select(*keys), keys, "left_anti")
        append(path, fresh, schema)
        return
    shared_dir(spark)
    found = found.withColumn("day", F.to_date(day_of)).checkpoint(eager=True)
    oldest, newest = found.agg(F.min("day"), F.max("day")).first()
    if oldest is None:
        return
    stored = read_or_empty(spark, path, StructType([*schema.fields, StructField("day", DateType())]))
    same = stored.filter(F.col("day").between(F.lit(oldest), F.lit(newest))).select("day", *keys)
    append(path, found.join(same, ["day", *keys], "left_anti"), schema, day=F.col("day"))


def append(
    path: str, rows: DataFrame, schema: StructType, defaults: dict[str, Column] | None = None, day: Column | None = None
) -> None:
    """Append records; columns they lack take ``defaults`` or NULL. ``day`` partitions the table by date."""
    extra = defaults or {}
    columns = []
    for f in schema.fields:
        value = F.col(f.name) if f.name in rows.columns else extra.get(f.name, F.lit(None))
        columns.append(value.cast(f.dataType).alias(f.name))
    if day is None:
        rows.select(columns).write.mode("append").parquet(path)
    else:
        rows.select(*columns, day.alias("day")).write.mode("append").partitionBy("day").parquet(path)


def append_event(path: str, rows: DataFrame, schema: StructType, at: str | datetime, by: str) -> None:
    """Append audit, request, migration, calendar or cost-allocation records with generated id, time and author."""
    now, today = F.lit(instant(at).isoformat(sep=" ")), F.lit(instant(at).date())
    stamps = {
        **{c: F.uuid() for c in ("event_id", "request_id", "migration_id", "calendar_id", "mapping_id", "breach_id")},
        **{c: now for c in ("event_timestamp", "created_at", "migrated_at", "detected_at")},
        **{c: F.lit(by) for c in ("username", "requested_by", "migrated_by", "created_by")},
        "status": F.lit("PENDING"),
        "acknowledged": F.lit(False),
        "is_active": F.lit(True),
        "suppress_anomaly": F.lit(True),
        "expected_spike_factor": F.lit(2.0),
        "allocation_pct": F.lit(100.0),
        "effective_from": today,
        "effective_to": F.lit("9999-12-31"),
        "max_queue_sec": F.lit(0.0),
        "max_error_rate_pct": F.lit(1.0),
        "priority": F.lit(3),
    }
    append(path, rows, schema, stamps)


def seed_if_empty(spark: SparkSession, path: str, schema: StructType, rows: DataFrame) -> bool:
    """Write the starting rows when the table has none; says whether it did."""
    if not read_or_empty(spark, path, schema).isEmpty():
        return False
    append(path, rows, schema)
    return True


def retention_cutoff(as_of: str | datetime, days: int = RETENTION_DAYS) -> datetime:
    return instant(as_of) - timedelta(days=days)


def retained(rows: DataFrame, as_of: str | datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows young enough to stay."""
    return rows.filter(F.col("hour_ts") >= moment(rows, "hour_ts", retention_cutoff(as_of, days)))


def retention_prune(
    spark: SparkSession, path: str, table: HourlyTable, as_of: str | datetime, days: int = RETENTION_DAYS
) -> list[date]:
    """Drop whole expired days and rewrite the boundary day. Returns the days dropped.

    The days come from a listing; the boundary day is rewritten like an upsert, and all of it is published at once.
    """
    shared_dir(spark)
    publication.recover(spark, path)
    cutoff = retention_cutoff(as_of, days)
    found = stored_days(spark, path)
    expired, left = [d for d in found if d < cutoff.date()], None
    if cutoff.date() in found:
        stored = read_or_empty(spark, path, table.stored_schema)
        left = retained(stored.filter(F.col("day") == F.lit(cutoff.date())), as_of, days).checkpoint(eager=True)
        if left.isEmpty():
            expired, left = [*expired, cutoff.date()], None
        else:
            left = _ordered(left.select([f.name for f in table.stored_schema.fields]))
    publication.publish(spark, path, left, expired)
    return expired


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def refresh(
    spark: SparkSession,
    path: str,
    table: HourlyTable,
    source: DataFrame,
    as_of: str | datetime,
    tags: DataFrame | None = None,
    rebuild_from: datetime | None = None,
) -> datetime:
    """One scheduled run for one table: re-read the open window, aggregate, upsert, prune. Returns the window start.

    Running it twice leaves the same rows, and a run after one that was killed finishes or undoes what that one left.
    Metering takes ``tags`` for its cost centre. ``rebuild_from`` widens the window, for example for very late rows.
    """
    publication.recover(spark, path)
    mark = watermark(spark, path, table)
    if rebuild_from is not None:
        mark = min(mark, rebuild_from + LATENESS)
    start = window_start(mark, as_of)
    window = incremental_window(source, table.time_column, mark, as_of)
    # a NULL name would never match its stored row, so a second run would store it twice
    updates = table.aggregate(window.filter(F.col("warehouse_name").isNotNull()))
    if tags is not None:
        updates = with_cost_center(updates, tags)
    merge_upsert(spark, path, table, updates, start, as_of)
    retention_prune(spark, path, table, as_of)
    return start
