"""Streaming jobs over the given tables: each drains what is there, then returns the table it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import schemas, seeds, store
from ..sources.readers import read_or_empty
from ..streaming import jobs
from ..operators import sla
from . import views as v
from .anomaly_jobs import LATENCY, QUEUE, breach_sql
from .cost_jobs import HQ_COLUMNS
from .governance_jobs import TRANSITIONS
from .registry import query, r
from .store_jobs import FIRST_RUN, TAGGED_HOURS, finished, new_folder
from .views import AS_OF

#: The watermark after every event: hours ending at or before it have closed.
MARK = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"

def event_stream(spark, sf) -> DataFrame:
    schema = v.events(spark, sf).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def drain(spark, writer, name: str) -> None:
    checkpoint = new_folder(spark, f"{name}-checkpoint")
    jobs.start(writer, checkpoint).awaitTermination()
    store.delete_folder(spark, checkpoint)


def kept_hourly(spark, sf, table, columns, tags=None) -> DataFrame:
    path = new_folder(spark, f"stream-{table.name}")
    source = event_stream(spark, sf).select(v.spark_columns(columns))
    drain(spark, jobs.stream_hourly(source, table, path, tags, store.RETENTION_DAYS), table.name)
    return finished(spark, store.load(spark, path, table).drop("_loaded_at"), path)


@query("stream_hourly_metering", TAGGED_HOURS)
def stream_hourly_metering(spark, sf):
    return kept_hourly(spark, sf, store.METERING, v.METERING, v.tag_references(spark, sf))


@query("stream_hourly_queries", f"SELECT {HQ_COLUMNS} FROM hq")
def stream_hourly_queries(spark, sf):
    return kept_hourly(spark, sf, store.QUERIES, v.QUERY_HISTORY)


@query(
    "stream_hourly_events",
    "SELECT warehouse_name, hour_ts, event_name, event_count FROM he WHERE event_name <> 'CONVERT_WAREHOUSE'",
)
def stream_hourly_events(spark, sf):
    return kept_hourly(spark, sf, store.EVENTS, v.EVENT_ROWS)


LATE_MARK = f"""(SELECT date_trunc('hour', max(ts)) - INTERVAL 2 HOUR FROM events
                 WHERE ts <= TIMESTAMP '{FIRST_RUN}' AND event_id % 10 <> 0)"""


@query(
    "late_data",
    f"""SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts, {r('CAST(sum(credits_used) AS DOUBLE)', 'credits')}
        FROM (SELECT {v.sql_columns(v.METERING)} FROM events WHERE event_id % 10 <> 0 OR ts >= {LATE_MARK}) GROUP BY 1, 2""",
)
def late_data(spark, sf):
    """Every tenth row arrives after the first run: those behind its watermark are not read again."""
    source = v.events(spark, sf)
    path = new_folder(spark, "late")
    early = source.filter((F.col("ts") <= F.lit(FIRST_RUN).cast("timestamp_ntz")) & (F.col("event_id") % 10 != 0))
    for rows, as_of in ((early, FIRST_RUN), (source, AS_OF)):
        store.refresh(spark, path, store.METERING, rows.select(v.spark_columns(v.METERING)), as_of)
    return finished(spark, store.load(spark, path, store.METERING).select("warehouse_name", "hour_ts", "credits"), path)


CLOSED = f"date_trunc('hour', start_time) + INTERVAL 1 HOUR <= {MARK}"


@query("stream_sla", breach_sql(*LATENCY, window=CLOSED) + " UNION ALL " + breach_sql(*QUEUE, window=CLOSED))
def stream_sla(spark, sf):
    path = new_folder(spark, "stream-sla")
    queries = event_stream(spark, sf).select(v.spark_columns(v.QUERY_HISTORY))
    drain(spark, jobs.stream_sla(queries, seeds.workload_sla(spark), path), "sla")
    return finished(spark, read_or_empty(spark, path, schemas.SLA_BREACHES).select(sla.BREACH_COLUMNS), path)


def spike_sql(hours: int, factor: float) -> str:
    limit = f"baseline_credits_7d / 7 / 24 * {hours} * {factor}"
    return f"""SELECT warehouse_name, window_end, {r('baseline_credits_7d / 7 / 24', 'baseline_hourly')}, {r('used', 'recent_credits')},
               {r(limit, 'alert_threshold')}
        FROM latest_migration JOIN (
          SELECT warehouse_name, hour_ts + to_hours(ahead) AS window_end, CAST(sum(c) AS DOUBLE) AS used
          FROM (SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts, sum(credits_used) AS c FROM metering GROUP BY 1, 2),
               (SELECT unnest(range(1, {hours + 1})) AS ahead) GROUP BY 1, 2) USING (warehouse_name)
        WHERE used > {limit} AND window_end <= {MARK}"""


def spike_stream(spark, sf, hours: int, factor: float) -> DataFrame:
    path = new_folder(spark, f"stream-alerts-{hours}")
    metering = event_stream(spark, sf).select(v.spark_columns(v.METERING))
    drain(spark, jobs.stream_spike_alert(metering, v.migration_log(spark, sf), path, hours, factor), "alerts")
    alerts = "warehouse_name STRING, window_end TIMESTAMP, baseline_hourly DOUBLE, recent_credits DOUBLE, alert_threshold DOUBLE"
    return finished(spark, spark.read.schema(alerts).parquet(path), path)


@query("stream_spike_alert", spike_sql(4, 1.5))
def stream_spike_alert(spark, sf):
    return spike_stream(spark, sf, 4, 1.5)


@query("stream_critical_spike_alert", spike_sql(6, 2.0))
def stream_critical_spike_alert(spark, sf):
    return spike_stream(spark, sf, 6, 2.0)


@query(
    "stream_request_state",
    f"""SELECT request_id, status, reviewed_by, reviewed_at, review_notes, executed_at, rollback_at, illegal_moves FROM ({TRANSITIONS})
        WHERE request_id IN (SELECT request_id FROM request_events)""",
)
def stream_request_state(spark, sf):
    path = new_folder(spark, "stream-requests")
    events = v.request_events_of(event_stream(spark, sf))
    drain(spark, jobs.stream_request_state(events, path), "requests")
    return finished(spark, jobs.current_states(spark, path, jobs.request_state_schema(events)), path)
