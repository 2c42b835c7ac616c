"""Continuous versions of the hourly refresh, SLA detection, spend alerts and request state.

Batch and stream share their aggregates. Event time is TIMESTAMP (watermarks do not accept TIMESTAMP_NTZ). A window of
hour ``h`` closes when an event two hours past its end has been seen: the hours a scheduled run would re-read stay open.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..functions.measures import count_where
from ..operators.governance import INITIAL_STATUS, is_legal_move
from ..operators.lifecycle import latest_migrations
from ..operators.rollups import with_cost_center
from ..operators.sla import BREACH_KEYS, breaches, sla_measures
from ..sources import schemas, store
from ..sources.segments import SegmentLog
from ..sources.store import HourlyTable

LATENESS = "2 hours"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, not on the executor heap; a provider set for the session wins."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        dict(spark.sparkContext.getConf().getAll()).get("spark.sql.streaming.stateStore.providerClass", ROCKSDB),
    )


def timed(source: DataFrame, column: str) -> DataFrame:
    return source.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, LATENESS)


def by_hour(source: DataFrame, column: str, measures: list[Column], *keys: str) -> DataFrame:
    """Hourly windows of ``source``; state holds each open (warehouse, hour) as a whole."""
    return (
        timed(source, column)
        .filter(F.col("warehouse_name").isNotNull())
        .groupBy("warehouse_name", F.window(column, "1 hour").alias("_window"), *keys)
        .agg(*measures)
        .withColumn("hour_ts", F.col("_window.start"))
        .drop("_window")
    )


def start(writer: DataStreamWriter, checkpoint: str, once: bool = True):
    """Start a query; ``once`` processes what is available and stops, for a scheduler that starts it hourly."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 hour")).start()


def stream_hourly(
    source: DataFrame, table: HourlyTable, path: str, tags: DataFrame | None = None, prune_days: int | None = None
) -> DataStreamWriter:
    """Keep a stored hourly table up to date: changed hours are upserted after every micro-batch.

    A replayed batch upserts the same rows again. Metering takes ``tags`` for its cost centre, read anew for each batch.
    With ``prune_days`` rows that much older than the newest stored hour go after a batch.
    """
    use_disk_state(source.sparkSession)
    extra = [k for k in table.keys if k not in ("warehouse_name", "hour_ts")]
    hours = by_hour(source, table.time_column, table.measures(), *extra)

    def upsert(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("hour_ts", F.col("hour_ts").cast("timestamp_ntz")).persist()
        try:
            oldest = rows.agg(F.min("hour_ts")).first()[0]
            if oldest is not None:
                now = datetime.now(timezone.utc).replace(tzinfo=None)
                hours = rows if tags is None else with_cost_center(rows, tags)
                store.merge_upsert(batch.sparkSession, path, table, hours, oldest, now)
                if prune_days is not None:
                    mark = store.watermark(batch.sparkSession, path, table)
                    store.retention_prune(batch.sparkSession, path, table, mark, prune_days)
        finally:
            rows.unpersist()

    return hours.writeStream.outputMode("update").foreachBatch(upsert)


def stream_sla(queries: DataFrame, sla: DataFrame, path: str) -> DataStreamWriter:
    """Judge every hour once, when it has closed, and append its breaches; no partial hour is ever judged."""
    use_disk_state(queries.sparkSession)
    hours = by_hour(queries, "start_time", sla_measures()).withColumnRenamed("hour_ts", "breach_window")

    def record(batch: DataFrame, _: int) -> None:
        # names and hours are both read from the batch
        closed = batch.withColumn("breach_window", F.col("breach_window").cast("timestamp_ntz")).persist()
        try:
            # hours close in a batch without input, whose size counts as 0: only kept rows have a size by which joins are chosen
            if closed.count() == 0:
                return
            found = breaches(closed, sla, "LATENCY", "QUEUE").select(
                "*", F.current_timestamp().alias("detected_at"), F.lit(False).alias("acknowledged")
            )
            store.merge_insert_only(batch.sparkSession, path, schemas.SLA_BREACHES, found, BREACH_KEYS, "breach_window")
        finally:
            closed.unpersist()

    return hours.writeStream.outputMode("append").foreachBatch(record)


def spike_alerts(
    metering: DataFrame, log: DataFrame, hours: int = 4, factor: float = 1.5, exclude_rolled_back: bool = False
) -> DataFrame:
    """Sliding windows of ``hours`` that cost more than ``factor`` times the baseline, one per hour and warehouse."""
    baseline = latest_migrations(log, exclude_rolled_back).select(
        "warehouse_name", (F.col("baseline_credits_7d") / 7 / 24).alias("baseline_hourly")
    )
    return (
        timed(metering, "start_time")
        .groupBy("warehouse_name", F.window("start_time", f"{hours} hours", "1 hour").alias("_window"))
        .agg(F.sum("credits_used").cast("double").alias("recent_credits"))
        # windows close in a batch without input, whose size counts as 0: unless told to merge, Spark would broadcast all of them
        .join(baseline.hint("merge"), "warehouse_name")
        .withColumn("alert_threshold", F.col("baseline_hourly") * hours * factor)
        .filter(F.col("recent_credits") > F.col("alert_threshold"))
        .select(
            "warehouse_name",
            F.col("_window.end").alias("window_end"),
            "baseline_hourly",
            "recent_credits",
            "alert_threshold",
        )
    )


def stream_spike_alert(metering: DataFrame, log: DataFrame, path: str, hours: int = 4, factor: float = 1.5) -> DataStreamWriter:
    """Append an alert row when a window has closed; the file sink writes each row exactly once."""
    use_disk_state(metering.sparkSession)
    return spike_alerts(metering, log, hours, factor).writeStream.outputMode("append").format("parquet").option("path", path)


def _state_rows(moves: DataFrame, batch: int) -> DataFrame:
    """A row per request of some status events: maxima and a sum, its first and last move, and illegal moves between these."""
    status, order = F.col("status"), Window.partitionBy("request_id").orderBy("event_time", "event_id")
    move = F.struct("event_time", "event_id", "status")

    def newest(which: str) -> Column:
        return F.max(F.when(status == which, F.col("event_time")))

    before = F.lag("status", 1).over(order)
    follows = F.row_number().over(order) > 1
    review = F.when(status.isin("APPROVED", "REJECTED"), F.struct("event_time", "event_id", "actor", "notes"))
    marked = moves.withColumn("_illegal", follows & ~is_legal_move(before, status))
    return marked.groupBy("request_id").agg(
        F.min(move).alias("first"), F.max(move).alias("last"), F.max(review).alias("review"),
        newest("EXECUTED").alias("executed_at"), newest("ROLLED_BACK").alias("rollback_at"),
        count_where(F.col("_illegal")).alias("illegal_moves"), F.lit(batch).cast("long").alias("batch"),
    )


def request_state_schema(events: DataFrame) -> StructType:
    """The layout of the stored states, which depends on the events' types only."""
    return _state_rows(events.sparkSession.createDataFrame([], events.schema), 0).schema


def folded(states: DataFrame) -> DataFrame:
    """States of several batches as one row a request; where two batches meet, the move between them is judged."""
    earlier = Window.partitionBy("request_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("last").over(earlier)
    joint = before.isNotNull() & ~is_legal_move(before["status"], F.col("first.status"))
    return (
        states.withColumn("illegal_moves", F.col("illegal_moves") + F.coalesce(joint, F.lit(False)).cast("long"))
        .groupBy("request_id")
        .agg(
            F.min_by("first", "batch").alias("first"), *[F.max(c).alias(c) for c in ("last", "review", "executed_at", "rollback_at")],
            F.sum("illegal_moves").alias("illegal_moves"), F.min("batch").alias("batch"),
        )
        .select(states.columns)
    )


def stream_request_state(events: DataFrame, path: str) -> DataStreamWriter:
    """Keep request states as a log of segments: a micro-batch writes one row for each request it moves, and reads nothing.

    Readers fold the segments by maxima (``current_states``). Segments of FANOUT batches are folded into one of the next tier,
    and so on, so a row is rewritten once a tier and a reader meets FANOUT segments of a tier at most. The state a request had
    before a batch gives its first move's predecessor, so illegal moves are counted as the batch form does while events come in
    order. A replayed batch writes its segment anew, or nothing if that was folded already.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        log = SegmentLog(batch.sparkSession, path)
        if not log.holds(batch_id):
            log.write(_state_rows(batch, batch_id), 0, batch_id, batch_id)
            log.compact(folded)

    return events.writeStream.foreachBatch(append)


def current_states(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A row per request: status, review, times and the number of illegal moves, the first one of a request included."""
    state = folded(SegmentLog(spark, path).read(schema))
    first_illegal = ~is_legal_move(F.lit(INITIAL_STATUS), F.col("first.status"))
    return state.select(
        "request_id", F.col("last.status").alias("status"), F.col("review.actor").alias("reviewed_by"),
        F.col("review.event_time").alias("reviewed_at"), F.col("review.notes").alias("review_notes"), "executed_at", "rollback_at",
        (F.col("illegal_moves") + F.coalesce(first_illegal, F.lit(False)).cast("long")).alias("illegal_moves"),
    )
