"""Jobs over the stored tables. Each writes under the shared folder and returns the resulting table."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.times import instant, moment
from ..operators import anomaly, comparison, lifecycle, rollups, sla
from ..session import shared_dir
from ..sources import schemas, seeds, store
from ..sources.readers import read_or_empty, resolve_source
from . import views as v
from .anomaly_jobs import LATENCY, QUEUE, breach_sql
from .cost_jobs import HQ_COLUMNS, NOW, hm
from .performance_jobs import queries_of
from .registry import query, r
from .views import AS_OF

#: The first of two refresh runs; at this time the later events have not arrived yet.
FIRST_RUN = "2024-01-15 10:40:00"


def new_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/fleetmeter/{name}-{uuid.uuid4().hex}"


def finished(spark, df, *folders: str):
    """The rows as they are now, and the folders they were read from deleted."""
    shared_dir(spark)
    kept = df.checkpoint(eager=True)
    for folder in folders:
        store.delete_folder(spark, folder)
    return kept


def arrived(df, column: str, as_of: str):
    return df.filter(F.col(column) <= F.lit(as_of).cast(df.schema[column].dataType))


def refreshed(spark, sf, table, source, tags=None):
    """The table after two increments."""
    path = new_folder(spark, table.name)
    for as_of in (FIRST_RUN, AS_OF):
        store.refresh(spark, path, table, arrived(source, table.time_column, as_of), as_of, tags)
    return finished(spark, store.load(spark, path, table).drop("_loaded_at"), path)


TAGGED_HOURS = f"""SELECT warehouse_name, hour_ts, {r('credits')}, tag_cost_center
        FROM hm LEFT JOIN (SELECT object_name AS warehouse_name, max(tag_value) AS tag_cost_center FROM tag_references
                           WHERE domain = 'WAREHOUSE' AND tag_name = 'COST_CENTER' GROUP BY 1) USING (warehouse_name)"""


@query("merge_upsert", TAGGED_HOURS)
def merge_upsert(spark, sf):
    """Two incremental refreshes give what one full computation gives."""
    return refreshed(spark, sf, store.METERING, v.metering(spark, sf), v.tag_references(spark, sf))


@query("merge_upsert_queries", f"SELECT {HQ_COLUMNS} FROM hq")
def merge_upsert_queries(spark, sf):
    return refreshed(spark, sf, store.QUERIES, v.query_history(spark, sf))


@query("merge_upsert_events", "SELECT warehouse_name, hour_ts, event_name, event_count FROM he")
def merge_upsert_events(spark, sf):
    return refreshed(spark, sf, store.EVENTS, v.events_history(spark, sf))


@query("source_resolver_staged", f"SELECT warehouse_name, hour_ts, {r('credits')} FROM hm WHERE hour_ts >= {NOW} - INTERVAL 14 DAY")
def source_resolver_staged(spark, sf):
    """A deployed hourly table answers instead of the raw scan, restricted to the look-back."""
    path = new_folder(spark, "staged")
    store.refresh(spark, path, store.METERING, v.metering(spark, sf), AS_OF)
    view = f"fleetmeter_staged_{uuid.uuid4().hex}"
    store.load(spark, path, store.METERING).createOrReplaceTempView(view)
    since = instant(AS_OF) - timedelta(days=14)
    found = resolve_source(
        spark, view, lambda: hm(spark, sf), lambda staged: staged.filter(F.col("hour_ts") >= moment(staged, "hour_ts", since)),
    )
    kept = finished(spark, found.select("warehouse_name", "hour_ts", "credits"), path)
    spark.catalog.dropTempView(view)
    return kept


def deployed(spark, sf, table, source):
    """A stored hourly table of the newest 30 days, and its folder."""
    path = new_folder(spark, table.name)
    store.refresh(spark, path, table, source, AS_OF)
    return store.load(spark, path, table), path


@query("staged_credit_comparison", like="credit_comparison")
def staged_credit_comparison(spark, sf):
    """Whole hours from the stored table, raw rows for the hours of changes; the same rows as from raw ones alone."""
    metering = v.metering(spark, sf)
    stored, path = deployed(spark, sf, store.METERING, metering)
    return finished(spark, comparison.credit_comparison(metering, v.migration_log(spark, sf), stored=stored), path)


@query("staged_daily_savings", like="daily_savings")
def staged_daily_savings(spark, sf):
    metering = v.metering(spark, sf)
    stored, path = deployed(spark, sf, store.METERING, metering)
    compared = comparison.credit_comparison(metering, v.migration_log(spark, sf), stored=stored)
    return finished(spark, comparison.daily_savings(compared), path)


@query("staged_before_after", like="before_after")
def staged_before_after(spark, sf):
    metering = v.metering(spark, sf)
    stored, path = deployed(spark, sf, store.METERING, metering)
    return finished(spark, comparison.before_after(metering, v.events_history(spark, sf), stored=stored), path)


@query("staged_performance_comparison", like="performance_comparison")
def staged_performance_comparison(spark, sf):
    queries = queries_of(spark, sf)
    stored, path = deployed(spark, sf, store.QUERIES, queries)
    return finished(spark, comparison.performance_comparison(queries, v.migration_log(spark, sf), stored=stored), path)


@query("staged_latency_regression_alert", like="latency_regression_alert")
def staged_latency_regression_alert(spark, sf):
    queries = queries_of(spark, sf)
    stored, path = deployed(spark, sf, store.QUERIES, queries)
    found = anomaly.latency_regression_alert(queries, v.migration_log(spark, sf), AS_OF, hours=48, stored=stored)
    return finished(spark, found, path)


@query(
    "incremental_window",
    f"""SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts, {r('CAST(sum(credits_used) AS DOUBLE)', 'credits')}
        FROM metering
        WHERE start_time >= (SELECT date_trunc('hour', max(start_time)) - INTERVAL 2 HOUR FROM metering
                             WHERE start_time <= TIMESTAMP '{FIRST_RUN}') GROUP BY 1, 2""",
)
def incremental_window(spark, sf):
    """What the second run re-aggregates: from two hours before the newest stored hour on."""
    source = v.metering(spark, sf)
    path = new_folder(spark, "window")
    store.refresh(spark, path, store.METERING, arrived(source, "start_time", FIRST_RUN), FIRST_RUN)
    mark = store.watermark(spark, path, store.METERING)
    store.delete_folder(spark, path)
    return rollups.metering_by_hour(store.incremental_window(source, "start_time", mark, AS_OF))


@query(
    "retention_prune",
    f"SELECT warehouse_name, hour_ts, {r('credits')} FROM hm WHERE hour_ts >= TIMESTAMP '2024-02-20 05:30:00' - INTERVAL 31 DAY",
)
def retention_prune(spark, sf):
    """A later run drops expired days and the expired hours of the boundary day."""
    path = new_folder(spark, "prune")
    store.refresh(spark, path, store.METERING, v.metering(spark, sf), AS_OF)
    store.retention_prune(spark, path, store.METERING, "2024-02-20 05:30:00")
    return finished(spark, store.load(spark, path, store.METERING).select("warehouse_name", "hour_ts", "credits"), path)


@query(
    "staging_row_counts",
    """SELECT 'HOURLY_METERING' AS table_name, count(*) AS rows FROM hm
       UNION ALL SELECT 'HOURLY_QUERIES', count(*) FROM hq UNION ALL SELECT 'WAREHOUSE_EVENTS_AGG', count(*) FROM he""",
)
def staging_row_counts(spark, sf):
    """Rows of the stored tables after a refresh."""
    sources = {"HOURLY_METERING": (store.METERING, v.metering), "HOURLY_QUERIES": (store.QUERIES, v.query_history),
               "WAREHOUSE_EVENTS_AGG": (store.EVENTS, v.events_history)}
    stored, paths = {}, []
    for name, (table, source) in sources.items():
        path = new_folder(spark, table.name)
        store.refresh(spark, path, table, source(spark, sf), AS_OF)
        stored[name] = store.load(spark, path, table)
        paths.append(path)
    return finished(spark, rollups.row_counts(stored), *paths)


WHOLE_HOURS = 30 * 24


def breach_rows(queries, as_of, detected_at):
    found = sla.detect_sla_breaches(queries, seeds.workload_sla(queries.sparkSession), as_of, WHOLE_HOURS)
    return found.withColumn("detected_at", F.lit(detected_at).cast("timestamp_ntz")).withColumn("acknowledged", F.lit(False))


@query("merge_insert_only", breach_sql(*LATENCY) + " UNION ALL " + breach_sql(*QUEUE))
def merge_insert_only(spark, sf):
    """Two detections into one breach table: a breach found by both is stored once.

    The first run ends on a full hour, so no hour is judged while partial.
    """
    path = new_folder(spark, "breaches")
    queries = v.query_history(spark, sf)
    first = "2024-01-15 10:00:00"
    for as_of, rows in ((first, queries.filter(F.col("start_time") < F.lit(first).cast("timestamp_ntz"))), (AS_OF, queries)):
        store.merge_insert_only(
            spark, path, schemas.SLA_BREACHES, breach_rows(rows, as_of, as_of), sla.BREACH_KEYS, "breach_window"
        )
    return finished(spark, read_or_empty(spark, path, schemas.SLA_BREACHES).select(sla.BREACH_COLUMNS), path)


@query(
    "append_event",
    f"""SELECT warehouse_name, action, new_type, migrated_by, migrated_at, {r('baseline_credits_7d')} FROM (
          SELECT warehouse_name, action, new_type, migrated_by, migrated_at, baseline_credits_7d FROM migration_log
          UNION ALL SELECT warehouse_name, 'ROLLBACK', 'STANDARD', 'auto', {NOW}, NULL FROM latest_migration)""",
)
def append_event(spark, sf):
    """The migration log with one more entry per migrated warehouse."""
    path = new_folder(spark, "log")
    log = v.migration_log(spark, sf)
    store.append_event(path, log, schemas.MIGRATION_LOG, AS_OF, "admin")
    rolled_back = lifecycle.rollback_record(lifecycle.latest_migrations(log).select("warehouse_name"), AS_OF)
    store.append_event(path, rolled_back.drop("migrated_at", "migrated_by"), schemas.MIGRATION_LOG, AS_OF, "auto")
    columns = ["warehouse_name", "action", "new_type", "migrated_by", "migrated_at", "baseline_credits_7d"]
    return finished(spark, read_or_empty(spark, path, schemas.MIGRATION_LOG).select(columns), path)


def appended(spark, name, rows, schema, columns):
    """The records of a new table after one append, with the values that the append gives them."""
    path = new_folder(spark, name)
    store.append_event(path, rows, schema, AS_OF, "admin")
    return finished(spark, read_or_empty(spark, path, schema).select(columns), path)


@query(
    "append_audit",
    f"SELECT {NOW} AS event_timestamp, 'admin' AS username, role_name, event_type, warehouse_name FROM audit_log",
)
def append_audit(spark, sf):
    rows = v.audit_log(spark, sf).select("role_name", "event_type", "warehouse_name")
    return appended(spark, "audit", rows, schemas.AUDIT_LOG, ["event_timestamp", "username", "role_name", "event_type", "warehouse_name"])


@query(
    "append_request",
    f"""SELECT {NOW} AS created_at, 'admin' AS requested_by, warehouse_name, 'ADAPTIVE' AS target_type, 'PENDING' AS status
        FROM inventory WHERE warehouse_type = 'STANDARD'""",
)
def append_request(spark, sf):
    names = v.inventory(spark, sf).filter("warehouse_type = 'STANDARD'")
    rows = names.select("warehouse_name", F.lit("ADAPTIVE").alias("target_type"))
    columns = ["created_at", "requested_by", "warehouse_name", "target_type", "status"]
    return appended(spark, "requests", rows, schemas.MIGRATION_REQUESTS, columns)


@query(
    "append_gl_mapping",
    f"""SELECT warehouse_name, gl_code, {r('100.0', 'allocation_pct')}, DATE '2024-01-31' AS effective_from,
               DATE '9999-12-31' AS effective_to, 'admin' AS created_by FROM gl_code_mapping""",
)
def append_gl_mapping(spark, sf):
    rows = v.gl_code_mapping(spark, sf).select("warehouse_name", "gl_code")
    columns = ["warehouse_name", "gl_code", "allocation_pct", "effective_from", "effective_to", "created_by"]
    return appended(spark, "gl", rows, schemas.GL_CODE_MAPPING, columns)


@query(
    "append_calendar",
    f"""SELECT 'Usage of ' || warehouse_name AS event_name, 'AUDIT_WINDOW' AS event_type, min(CAST(start_time AS DATE)) AS start_date,
               max(CAST(start_time AS DATE)) AS end_date, warehouse_name AS affected_warehouses, {r('2.0', 'expected_spike_factor')},
               TRUE AS suppress_anomaly, 'admin' AS created_by FROM metering GROUP BY warehouse_name""",
)
def append_calendar(spark, sf):
    """A window over each warehouse's days of usage."""
    rows = v.metering(spark, sf).groupBy(F.col("warehouse_name").alias("affected_warehouses")).agg(
        F.min(F.to_date("start_time")).alias("start_date"), F.max(F.to_date("start_time")).alias("end_date")
    )
    rows = rows.select("*", F.concat(F.lit("Usage of "), "affected_warehouses").alias("event_name"), F.lit("AUDIT_WINDOW").alias("event_type"))
    columns = [
        "event_name", "event_type", "start_date", "end_date", "affected_warehouses", "expected_spike_factor", "suppress_anomaly", "created_by",
    ]
    return appended(spark, "calendar", rows, schemas.REGULATORY_CALENDAR, columns)


@query(
    "seed_if_empty",
    f"""SELECT workload_class, warehouse_pattern, {r('max_p95_latency_sec')}, {r('max_queue_sec')} FROM sla_catalogue""",
)
def seed_if_empty(spark, sf):
    """The second seeding finds rows and writes nothing."""
    path = new_folder(spark, "seed")
    rows = v.sla_catalogue(spark, sf)
    for _ in range(2):
        store.seed_if_empty(spark, path, schemas.WORKLOAD_SLA, rows)
    columns = ["workload_class", "warehouse_pattern", "max_p95_latency_sec", "max_queue_sec"]
    return finished(spark, read_or_empty(spark, path, schemas.WORKLOAD_SLA).select(columns), path)
