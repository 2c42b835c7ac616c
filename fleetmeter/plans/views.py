"""The given tables seen as warehouse telemetry.

Every view exists twice: as a DataFrame and as SQL for the reference check. Projections share one expression text
(both engines read it the same way; ``{TS}`` is the name of the timestamp-without-zone literal), the rest is
written out in each. No view drops rows: every event, order and customer reaches the operators.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import inventory_normalise

#: "Now" for everything built on ``events`` (its last event is on 2024-01-30).
AS_OF = "2024-01-31 00:00:00"
#: "Now" for the order-based metering, whose days span 1995 to 2001.
ORDERS_AS_OF = "2001-08-02 00:00:00"
ORDERS_DAYS = 3000


def wh(user: str = "user_id") -> str:
    """Warehouse name of a user; every 40th name matches two SLA patterns, MISC matches none."""
    return (
        f"concat(CASE {user} % 8 WHEN 0 THEN 'TRADING' WHEN 1 THEN 'RISK' WHEN 2 THEN 'REG' WHEN 3 THEN 'CLIENT' "
        f"WHEN 4 THEN 'ETL' WHEN 5 THEN 'ANALYTICS' WHEN 6 THEN 'ADHOC' ELSE 'MISC' END, '_WH_', {user}, "
        f"CASE WHEN {user} % 40 = 0 THEN '_RISK' ELSE '' END)"
    )


def _by_mod(value: str, modulus: int, results: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(results))
    return f"CASE {value} % {modulus} {whens} END"


def _migrated(offset_days: int = 0) -> str:
    """Migration time of a user, in the middle of an hour."""
    return _by_mod("user_id", 5, [f"{{TS}} '2024-01-{16 + offset_days + d} 00:30:00'" for d in range(5)])


SIZE = _by_mod("user_id", 6, ["'X-Small'", "'Medium'", "'Large'", "'X-Large'", "'2X-Large'", "'5X-Large'"])
CREDITS = "CAST(value AS DECIMAL(18,2))"

METERING = {"warehouse_name": wh(), "start_time": "ts", "credits_used": CREDITS}

QUERY_HISTORY = {
    "query_id": "concat('q', event_id)",
    "query_text": "props",
    "warehouse_name": f"CASE WHEN event_id % 101 = 0 THEN NULL ELSE {wh()} END",
    "warehouse_size": f"CASE WHEN user_id % 3 = 0 AND ts >= {_migrated()} THEN 'ADAPTIVE' ELSE {SIZE} END",
    "user_name": "concat('u', event_id % 17)",
    "query_tag": "CASE event_type WHEN 'view' THEN 'etl_pipeline' WHEN 'click' THEN 'cortex_agent' "
    "WHEN 'signup' THEN 'ml_scoring' WHEN 'purchase' THEN 'dashboard' END",
    "start_time": "ts",
    "end_time": "ts + INTERVAL 5 MINUTE",
    "execution_status": "CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END",
    "error_code": "CASE WHEN event_type = 'error' THEN concat('100', event_id % 4) END",
    "error_message": "CASE WHEN event_type = 'error' THEN concat('E100', event_id % 4) END",
    "total_elapsed_time": "CAST(round(value * 1000) AS BIGINT)",
    "execution_time": "CAST(round(value * 900) AS BIGINT)",
    "compilation_time": "event_id % 40",
    "queued_overload_time": "CASE WHEN event_id % 5 = 0 THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END",
    "queued_provisioning_time": "event_id % 50",
    "credits_used_cloud_services": "CAST(value / 100 AS DECIMAL(18,4))",
}

LOAD_HISTORY = {
    "warehouse_name": wh(),
    "start_time": "ts",
    "avg_running": "value / 50",
    "avg_queued_load": "CASE WHEN event_id % 5 = 0 THEN value / 200 ELSE CAST(0 AS DOUBLE) END",
    "avg_blocked": "CAST(0 AS DOUBLE)",
}

EVENT_ROWS = {
    "warehouse_name": wh(),
    "timestamp": "ts",
    "event_name": "CASE event_type WHEN 'click' THEN 'SUSPEND_WAREHOUSE' WHEN 'error' THEN 'SUSPEND_WAREHOUSE_SUCCEEDED' "
    "WHEN 'view' THEN 'RESUME_WAREHOUSE' WHEN 'signup' THEN 'SCALE_UP_CLUSTER' ELSE 'RESIZE' END",
    "event_reason": "'POLICY'",
}

CONVERSION_ROWS = {
    "warehouse_name": wh(),
    "timestamp": _migrated(),
    "event_name": "'CONVERT_WAREHOUSE'",
    "event_reason": "'CONVERT_TO_ADAPTIVE'",
}

INVENTORY = {
    "name": wh(),
    "type": "CASE WHEN user_id % 3 = 0 THEN 'ADAPTIVE' ELSE 'STANDARD' END",
    "state": "CASE WHEN user_id % 3 = 0 THEN 'ENABLED' WHEN user_id % 37 = 1 THEN 'RESUMING' ELSE 'SUSPENDED' END",
    "size": SIZE,
    "generation": "CASE WHEN user_id % 2 = 0 THEN '1' ELSE '2' END",
    "max_query_performance_level": "CASE WHEN user_id % 3 = 0 THEN 'XLARGE' ELSE '' END",
    "query_throughput_multiplier": "CASE WHEN user_id % 3 = 0 THEN '2' ELSE '' END",
    "max_cluster_count": _by_mod("user_id", 4, ["'3'", "'1'", "'n/a'", "NULL"]),
    "auto_suspend": "'300'",
    "resource_monitor": "CASE WHEN user_id % 6 < 2 THEN 'RM1' ELSE '' END",
}
#: Pools without any usage.
UNUSED = [
    ("IDLE_WH_1", "STANDARD", "SUSPENDED", "Medium", "1", "", "", "1", "300", ""),
    ("IDLE_WH_2", "STANDARD", "SUSPENDED", "5X-Large", "2", "", "", "2", "300", "RM1"),
]

AUDIT_LOG = {
    "event_id": "concat('a', lpad(CAST(event_id AS {STR}), 12, '0'))",
    "event_timestamp": "ts",
    "username": "concat('u', event_id % 17)",
    "role_name": "concat('role', event_id % 3)",
    "session_id": "event_id % 1000",
    "event_type": "CASE event_type WHEN 'click' THEN 'VIEW' WHEN 'view' THEN 'SIMULATION' WHEN 'purchase' THEN "
    "'MIGRATION_REQUEST' WHEN 'signup' THEN 'EXPORT' ELSE 'APPROVAL' END",
    "event_detail": "concat('{{\"section\":\"', event_type, '\"}}')",
    "warehouse_name": wh(),
}

STATUS_PATH = _by_mod("event_id", 5, ["'PENDING'", "'APPROVED'", "'REJECTED'", "'EXECUTED'", "'ROLLED_BACK'"])
REQUESTS = {
    "request_id": "concat('r', lpad(CAST(event_id AS {STR}), 12, '0'))",
    "created_at": "ts",
    "requested_by": "concat('u', event_id % 17)",
    "warehouse_name": wh(),
    "estimated_savings": "value",
    "justification": "props",
    "status": STATUS_PATH,
    "reviewed_by": "CASE WHEN event_id % 5 IN (1, 2, 3) THEN concat('m', event_id % 7) END",
    "review_notes": "CASE WHEN event_id % 5 IN (1, 2, 3) THEN concat('note ', event_id % 11) END",
    "executed_at": "CASE WHEN event_id % 5 IN (3, 4) THEN ts + INTERVAL 25 HOUR END",
}

SLA_BREACHES = {
    "detected_at": "ts",
    "warehouse_name": wh(),
    "workload_class": "concat('CLASS_', user_id % 8)",
    "breach_type": _by_mod("event_id", 3, ["'LATENCY'", "'QUEUE'", "'ERROR_RATE'"]),
    "sla_threshold": "value / 2",
    "actual_value": "value",
    "breach_window": "ts",
    "severity": _by_mod("event_id", 4, ["'CRITICAL'", "'HIGH'", "'MEDIUM'", "'LOW'"]),
    "acknowledged": "event_id % 3 = 0",
}

ORDERS_METERING = {
    "warehouse_name": "concat('ORD_', o_custkey % 24)",
    "start_time": "o_orderdate",
    "credits_used": "CAST(o_totalprice AS DECIMAL(18,2))",
}

ACCOUNTS = {
    "account": "c_name",
    "region": _by_mod(
        "c_custkey", 6,
        ["'AWS_US_WEST_2'", "'AZURE_WESTEUROPE'", "'GCP_US_EAST4'", "'AWS_SA_EAST_1'", "'UNKNOWN'", "'AWS'"],
    ),
}

CALENDAR = {
    "event_name": "concat('Window ', o_custkey)",
    "event_type": _by_mod(
        "o_custkey", 6,
        ["'MONTH_END'", "'QUARTER_END'", "'YEAR_END'", "'REGULATORY_FILING'", "'AUDIT_WINDOW'", "'BLACKOUT'"],
    ),
    "start_date": "DATE '2023-12-25' + CAST(o_custkey * 7 % 45 AS INT)",
    "end_date": "DATE '2023-12-25' + CAST(o_custkey * 7 % 45 + o_custkey % 4 AS INT)",
    "affected_warehouses": f"CASE WHEN o_custkey % 300 = 17 THEN 'ALL' ELSE concat({wh('o_custkey')}, ', ', {wh('(o_custkey % 97)')}) END",
    "expected_spike_factor": "1 + o_custkey % 5 * CAST(0.5 AS DOUBLE)",
    "suppress_anomaly": "o_custkey % 3 <> 0",
    "notes": "concat(n_orders, ' orders')",
}

SLA_CATALOGUE = {
    "workload_class": "concat('CLASS_', class_no)",
    "warehouse_pattern": "concat('%_', class_no, '%')",
    "max_p95_latency_sec": "max_value",
    "max_queue_sec": "max_value / 10",
    "max_error_rate_pct": "1 + class_no % 4 * CAST(0.5 AS DOUBLE)",
    "priority": "CAST(1 + class_no % 4 AS INT)",
    "escalation_contact": "CASE WHEN class_no % 4 <> 3 THEN concat('team', class_no, '@firm.com') END",
    "is_active": "class_no % 9 <> 0",
}


def spark_columns(columns: dict[str, str]) -> list:
    return [F.expr(e.format(TS="TIMESTAMP_NTZ", STR="STRING")).alias(n) for n, e in columns.items()]


def sql_columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{e.format(TS='TIMESTAMP', STR='VARCHAR')} AS {n}" for n, e in columns.items())


#: Columns of the given tables that the views read; a declared schema saves the inference job.
GIVEN = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("user_id").distinct()


def metering(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(spark_columns(METERING))


def query_history(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(spark_columns(QUERY_HISTORY))


def load_history(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(spark_columns(LOAD_HISTORY))


def events_history(spark: SparkSession, sf: str) -> DataFrame:
    converted = _users(spark, sf).filter("user_id % 3 = 0").select(spark_columns(CONVERSION_ROWS))
    return events(spark, sf).select(spark_columns(EVENT_ROWS)).unionByName(converted)


def raw_inventory(spark: SparkSession, sf: str) -> DataFrame:
    used = _users(spark, sf).select(spark_columns(INVENTORY))
    return used.unionByName(spark.createDataFrame(UNUSED, ", ".join(f"{c} STRING" for c in INVENTORY)))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory_normalise(raw_inventory(spark, sf))


def migration_log(spark: SparkSession, sf: str) -> DataFrame:
    """One MIGRATE per third user, a second one three days later and a ROLLBACK after that for some."""
    first, second, undone = (F.expr(_migrated(d).format(TS="TIMESTAMP_NTZ")) for d in (0, 3, 4))

    def week_before(change):
        return F.sum(
            F.when((F.col("ts") >= change - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < change), F.expr(CREDITS))
            .otherwise(F.lit(0).cast("decimal(18,2)"))
        ).cast("double")

    def entry(action, at, baseline, when):
        old, new = ("STANDARD", "ADAPTIVE") if action == "MIGRATE" else ("ADAPTIVE", "STANDARD")
        return F.when(
            F.expr(when),
            F.struct(
                F.lit(action).alias("action"),
                F.lit(old).alias("previous_type"),
                F.lit(new).alias("new_type"),
                at.alias("migrated_at"),
                baseline.cast("double").alias("baseline_credits_7d"),
            ),
        )

    return (
        events(spark, sf)
        .filter("user_id % 3 = 0")
        .groupBy("user_id")
        .agg(week_before(first).alias("_b1"), week_before(second).alias("_b2"))
        .select(
            F.expr(wh()).alias("warehouse_name"),
            F.lit("admin").alias("migrated_by"),
            F.expr(SIZE).alias("previous_size"),
            F.inline(
                F.array_compact(
                    F.array(
                        entry("MIGRATE", first, F.col("_b1"), "true"),
                        entry("MIGRATE", second, F.col("_b2"), "user_id % 15 = 0"),
                        entry("ROLLBACK", undone, F.lit(None), "user_id % 30 = 0"),
                    )
                )
            ),
        )
    )


def tag_references(spark: SparkSession, sf: str) -> DataFrame:
    """Cost centres (two for some pools), a second tag, and tags of other objects."""
    users = _users(spark, sf)

    def tag(domain, name, value, when):
        return F.when(
            F.expr(when),
            F.struct(F.lit(domain).alias("domain"), F.lit(name).alias("tag_name"), F.expr(value).alias("tag_value")),
        )

    return users.select(
        F.expr(wh()).alias("object_name"),
        F.inline(
            F.array_compact(
                F.array(
                    tag("WAREHOUSE", "COST_CENTER", "concat('CC-', user_id % 7)", "user_id % 4 <> 0"),
                    tag("WAREHOUSE", "COST_CENTER", "concat('CC-', user_id % 7 + 1)", "user_id % 20 = 1"),
                    tag("WAREHOUSE", "cost-centre", "CASE WHEN user_id % 2 = 0 THEN 'sales' ELSE 'tech' END", "true"),
                    tag("DATABASE", "COST_CENTER", "'CC-DB'", "user_id % 10 = 3"),
                )
            )
        ),
    )


def gl_code_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Full, split, partial and expired mappings; one user in five has none."""
    users = _users(spark, sf)

    def mapping(code, line, pct, until, when):
        return F.when(
            F.expr(when),
            F.struct(
                F.expr(code).alias("gl_code"),
                F.expr(line).alias("business_line"),
                F.lit(float(pct)).alias("allocation_pct"),
                F.lit(until).cast("date").alias("effective_to"),
            ),
        )

    code, line = "concat('4', user_id % 9)", "concat('LOB ', user_id % 3)"
    return users.select(
        F.expr(wh()).alias("warehouse_name"),
        F.expr("concat('CC-', user_id % 7)").alias("cost_center"),
        F.expr("concat('D', user_id % 4)").alias("department"),
        F.lit("2024-01-01").cast("date").alias("effective_from"),
        F.lit("cfo").alias("approved_by"),
        F.inline(
            F.array_compact(
                F.array(
                    mapping(code, line, 100, "9999-12-31", "user_id % 5 = 0"),
                    mapping(code, line, 60, "9999-12-31", "user_id % 5 = 1"),
                    mapping("'shared'", "'Shared'", 40, "9999-12-31", "user_id % 5 = 1"),
                    mapping(code, line, 50, "2024-01-31", "user_id % 5 = 2"),
                    mapping(code, line, 100, "2024-01-30", "user_id % 5 = 3"),
                )
            )
        ),
    )


def rate_sheet_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rates from usage; every third day has a zero rate."""
    day = F.to_date("ts")
    return (
        events(spark, sf)
        .groupBy(day.alias("date"))
        .agg((F.sum(F.expr(CREDITS)).cast("double") / F.count(F.lit(1))).alias("_avg"))
        .select(
            "date",
            F.lit("WAREHOUSE_METERING").alias("service_type"),
            F.lit("compute").alias("usage_type"),
            F.when(F.dayofmonth("date") % 3 == 0, F.lit(0.0)).otherwise(F.round(F.col("_avg") / 15, 2)).alias("effective_rate"),
        )
    )


def usage_in_currency_daily(spark: SparkSession, sf: str) -> DataFrame:
    return (
        events(spark, sf)
        .groupBy(F.to_date("ts").alias("usage_date"))
        .agg(F.sum(F.expr(CREDITS)).cast("double").alias("usage"))
        .select(
            "usage_date",
            F.lit("compute").alias("usage_type"),
            "usage",
            (F.col("usage") * (2 + F.dayofmonth("usage_date") % 3 * 0.25)).alias("usage_in_currency"),
        )
    )


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(spark_columns(AUDIT_LOG)).withColumn("event_detail", F.parse_json("event_detail"))


def migration_requests(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(spark_columns(REQUESTS))


def request_events(spark: SparkSession, sf: str) -> DataFrame:
    return request_events_of(events(spark, sf))


def request_events_of(source: DataFrame) -> DataFrame:
    """Status events per request; paths by number, one of them executing without approval."""

    def move(n, status, hours, actor, notes, when):
        return F.when(
            F.expr(when),
            F.struct(
                F.lit(n).alias("event_id"),
                F.lit(status).alias("status"),
                (F.col("ts") + F.expr(f"INTERVAL {hours} HOURS")).alias("event_time"),
                F.expr(actor).alias("actor"),
                F.expr(notes).alias("notes"),
            ),
        )

    reviewer, note, none = "concat('m', event_id % 7)", "concat('note ', event_id % 11)", "CAST(NULL AS STRING)"
    return source.select(
        F.expr(REQUESTS["request_id"].format(STR="STRING")).alias("request_id"),
        F.inline(
            F.array_compact(
                F.array(
                    move(1, "APPROVED", 1, reviewer, note, "event_id % 5 IN (1, 3)"),
                    move(2, "REJECTED", 1, reviewer, note, "event_id % 5 = 2"),
                    move(3, "EXECUTED", 25, "'ops'", none, "event_id % 5 IN (3, 4)"),
                    move(4, "ROLLED_BACK", 26, "'ops'", none, "event_id % 5 = 4"),
                )
            )
        ),
    )


def sla_breach_log(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(spark_columns(SLA_BREACHES))


def sla_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """SLA definitions with limits taken from the observed values."""
    return (
        events(spark, sf)
        .groupBy(F.expr("user_id % 200").alias("class_no"))
        .agg(F.max("value").alias("max_value"))
        .select(spark_columns(SLA_CATALOGUE))
    )


def regulatory_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")).select(spark_columns(CALENDAR))
    )


def orders_metering(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(spark_columns(ORDERS_METERING))


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(spark_columns(ACCOUNTS))


def regions_from_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """A support matrix with one row per (cloud, nation) that has suppliers."""
    cloud = _by_mod("s_suppkey", 3, ["'AWS'", "'AZURE'", "'GCP'"])
    return (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.expr(cloud).alias("cloud_provider"), F.lower("n_name").alias("region"), F.col("n_name").alias("region_display"))
        .agg(
            (F.max("s_suppkey") % 2 == 0).alias("adaptive_ga"), (F.min("s_suppkey") % 2 == 0).alias("adaptive_preview")
        )
    )


def _seed_sla_sql() -> str:
    from ..sources.seeds import WORKLOAD_SLA

    def text(v):
        if v is None:
            return "NULL"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return "'" + v + "'" if isinstance(v, str) else repr(v)

    rows = ", ".join("(" + ", ".join(text(v) for v in row) + ", TRUE)" for row in WORKLOAD_SLA)
    return (
        f"SELECT * FROM (VALUES {rows}) AS s(workload_class, warehouse_pattern, max_p95_latency_sec, max_queue_sec, "
        "max_error_rate_pct, priority, escalation_contact, is_active)"
    )


def _region_sql() -> str:
    from ..sources.seeds import REGION_SUPPORT

    rows = ", ".join(f"('{c}', '{r}', '{d}', {ga}, {pv})" for c, r, d, ga, pv in REGION_SUPPORT)
    return f"SELECT * FROM (VALUES {rows}) AS s(cloud_provider, region, region_display, adaptive_ga, adaptive_preview)"


def _log_sql() -> str:
    m1, m2, rb = (_migrated(d).format(TS="TIMESTAMP") for d in (0, 3, 4))

    def baseline(m):
        return (
            f"CAST(sum(CASE WHEN ts >= {m} - INTERVAL 7 DAY AND ts < {m} THEN {CREDITS} ELSE 0 END) AS DOUBLE)"
        )

    base = "'admin' AS migrated_by"
    return f"""
      SELECT {wh()} AS warehouse_name, {base}, {SIZE} AS previous_size, 'MIGRATE' AS action, 'STANDARD' AS previous_type,
             'ADAPTIVE' AS new_type, {m1} AS migrated_at, {baseline(m1)} AS baseline_credits_7d
      FROM events WHERE user_id % 3 = 0 GROUP BY user_id
      UNION ALL
      SELECT {wh()}, 'admin', {SIZE}, 'MIGRATE', 'STANDARD', 'ADAPTIVE', {m2}, {baseline(m2)}
      FROM events WHERE user_id % 15 = 0 GROUP BY user_id
      UNION ALL
      SELECT {wh()}, 'admin', {SIZE}, 'ROLLBACK', 'ADAPTIVE', 'STANDARD', {rb}, NULL
      FROM events WHERE user_id % 30 = 0 GROUP BY user_id"""


def _inventory_sql() -> str:
    renamed = {
        "name": "warehouse_name", "type": "warehouse_type", "size": "warehouse_size",
        "max_query_performance_level": "max_query_perf_level", "query_throughput_multiplier": "throughput_multiplier",
        "max_cluster_count": "max_clusters",
    }
    columns = {renamed.get(n, n): e for n, e in INVENTORY.items()}
    unused = " UNION ALL ".join("SELECT " + ", ".join(f"'{v}'" for v in row) for row in UNUSED)
    return f"SELECT {sql_columns(columns)} FROM (SELECT DISTINCT user_id FROM events) UNION ALL {unused}"


USERS = "(SELECT DISTINCT user_id FROM events)"
RID = REQUESTS["request_id"].format(STR="VARCHAR")

#: SQL of every view, in dependency order. ``hm``, ``hq``, ``he`` are the 30-day hourly rollups.
SQL_VIEWS: dict[str, str] = {
    "metering": f"SELECT {sql_columns(METERING)} FROM events",
    "query_history": f"SELECT {sql_columns(QUERY_HISTORY)} FROM events",
    "load_history": f"SELECT {sql_columns(LOAD_HISTORY)} FROM events",
    "events_history": f"SELECT {sql_columns(EVENT_ROWS)} FROM events UNION ALL "
    f"SELECT {sql_columns(CONVERSION_ROWS)} FROM {USERS} WHERE user_id % 3 = 0",
    "inventory": _inventory_sql(),
    "migration_log": _log_sql(),
    "tag_references": f"""
      SELECT {wh()} AS object_name, 'WAREHOUSE' AS domain, 'COST_CENTER' AS tag_name, concat('CC-', user_id % 7) AS tag_value
      FROM {USERS} WHERE user_id % 4 <> 0
      UNION ALL SELECT {wh()}, 'WAREHOUSE', 'COST_CENTER', concat('CC-', user_id % 7 + 1) FROM {USERS} WHERE user_id % 20 = 1
      UNION ALL SELECT {wh()}, 'WAREHOUSE', 'cost-centre', CASE WHEN user_id % 2 = 0 THEN 'sales' ELSE 'tech' END FROM {USERS}
      UNION ALL SELECT {wh()}, 'DATABASE', 'COST_CENTER', 'CC-DB' FROM {USERS} WHERE user_id % 10 = 3""",
    "gl_code_mapping": f"""
      SELECT {wh()} AS warehouse_name, concat('CC-', user_id % 7) AS cost_center, concat('D', user_id % 4) AS department,
             DATE '2024-01-01' AS effective_from, 'cfo' AS approved_by, gl_code, business_line,
             CAST(allocation_pct AS DOUBLE) AS allocation_pct, effective_to
      FROM (
        SELECT user_id, concat('4', user_id % 9) AS gl_code, concat('LOB ', user_id % 3) AS business_line,
               CASE user_id % 5 WHEN 1 THEN 60 WHEN 2 THEN 50 ELSE 100 END AS allocation_pct,
               CASE user_id % 5 WHEN 2 THEN DATE '2024-01-31' WHEN 3 THEN DATE '2024-01-30' ELSE DATE '9999-12-31' END AS effective_to
        FROM {USERS} WHERE user_id % 5 < 4
        UNION ALL SELECT user_id, 'shared', 'Shared', 40, DATE '9999-12-31' FROM {USERS} WHERE user_id % 5 = 1)""",
    "rate_sheet_daily": f"""
      SELECT CAST(ts AS DATE) AS date, 'WAREHOUSE_METERING' AS service_type, 'compute' AS usage_type,
             CASE WHEN day(CAST(ts AS DATE)) % 3 = 0 THEN 0
                  ELSE round(CAST(sum({CREDITS}) AS DOUBLE) / count(*) / 15, 2) END AS effective_rate
      FROM events GROUP BY CAST(ts AS DATE)""",
    "usage_in_currency_daily": f"""
      SELECT CAST(ts AS DATE) AS usage_date, 'compute' AS usage_type, CAST(sum({CREDITS}) AS DOUBLE) AS usage,
             CAST(sum({CREDITS}) AS DOUBLE) * (2 + day(CAST(ts AS DATE)) % 3 * 0.25) AS usage_in_currency
      FROM events GROUP BY CAST(ts AS DATE)""",
    "audit_log": f"SELECT {sql_columns(AUDIT_LOG)} FROM events",
    "migration_requests": f"SELECT {sql_columns(REQUESTS)} FROM events",
    "request_events": f"""
      SELECT {RID} AS request_id, 1 AS event_id, 'APPROVED' AS status, ts + INTERVAL 1 HOUR AS event_time,
             concat('m', event_id % 7) AS actor, concat('note ', event_id % 11) AS notes
      FROM events WHERE event_id % 5 IN (1, 3)
      UNION ALL SELECT {RID}, 2, 'REJECTED', ts + INTERVAL 1 HOUR, concat('m', event_id % 7), concat('note ', event_id % 11)
      FROM events WHERE event_id % 5 = 2
      UNION ALL SELECT {RID}, 3, 'EXECUTED', ts + INTERVAL 25 HOUR, 'ops', NULL FROM events WHERE event_id % 5 IN (3, 4)
      UNION ALL SELECT {RID}, 4, 'ROLLED_BACK', ts + INTERVAL 26 HOUR, 'ops', NULL FROM events WHERE event_id % 5 = 4""",
    "sla_breach_log": f"SELECT {sql_columns(SLA_BREACHES)} FROM events",
    "sla_catalogue": f"SELECT {sql_columns(SLA_CATALOGUE)} FROM (SELECT user_id % 200 AS class_no, max(value) AS max_value "
    "FROM events GROUP BY user_id % 200)",
    "workload_sla": _seed_sla_sql(),
    "regulatory_calendar": f"SELECT {sql_columns(CALENDAR)} FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)",
    "orders_metering": f"SELECT {sql_columns(ORDERS_METERING)} FROM orders",
    "accounts": f"SELECT {sql_columns(ACCOUNTS)} FROM customer",
    "regions": _region_sql(),
    "supplier_regions": "SELECT " + _by_mod("s_suppkey", 3, ["'AWS'", "'AZURE'", "'GCP'"]) + """ AS cloud_provider,
             lower(n_name) AS region, n_name AS region_display, max(s_suppkey) % 2 = 0 AS adaptive_ga,
             min(s_suppkey) % 2 = 0 AS adaptive_preview
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
    "hm": f"""
      SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts, CAST(sum(credits_used) AS DOUBLE) AS credits
      FROM metering WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL""",
    "hq": f"""
      SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts,
             count(*) FILTER (WHERE execution_status = 'SUCCESS') AS query_count,
             avg(total_elapsed_time) FILTER (WHERE execution_status = 'SUCCESS') AS avg_elapsed_ms,
             quantile_cont(total_elapsed_time, 0.95) FILTER (WHERE execution_status = 'SUCCESS') AS p95_elapsed_ms,
             CAST(sum(CASE WHEN execution_status = 'SUCCESS' THEN queued_overload_time ELSE 0 END) AS DOUBLE) AS total_queue_ms,
             count(*) FILTER (WHERE execution_status = 'SUCCESS' AND queued_overload_time > 0) AS queued_queries,
             count(*) FILTER (WHERE execution_status = 'FAIL') AS failed_queries,
             CAST(sum(CASE WHEN execution_status = 'FAIL' THEN total_elapsed_time ELSE 0 END) AS DOUBLE) AS total_elapsed_failed_ms,
             count(*) FILTER (WHERE execution_status = 'SUCCESS' AND warehouse_size IN ('X-Large', '2X-Large', '3X-Large', '4X-Large')) AS complex_queries,
             stddev_samp(total_elapsed_time) FILTER (WHERE execution_status = 'SUCCESS') AS latency_stddev
      FROM query_history WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND warehouse_name IS NOT NULL
      GROUP BY ALL""",
    "he": f"""
      SELECT warehouse_name, date_trunc('hour', timestamp) AS hour_ts, event_name, count(*) AS event_count
      FROM events_history WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY ALL""",
    "credit_comparison": """
      SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts,
             CASE WHEN start_time >= migration_ts THEN 'POST' ELSE 'PRE' END AS period,
             CAST(sum(credits_used) AS DOUBLE) AS credits
      FROM metering JOIN (SELECT warehouse_name, min(migrated_at) AS migration_ts FROM migration_log
                          WHERE action = 'MIGRATE' GROUP BY 1) USING (warehouse_name)
      WHERE start_time >= migration_ts - INTERVAL 14 DAY GROUP BY ALL""",
    "performance_comparison": """
      SELECT warehouse_name, CASE WHEN start_time >= migration_ts THEN 'POST' ELSE 'PRE' END AS period,
             date_trunc('hour', start_time) AS hour_ts, count(*) AS query_count,
             avg(total_elapsed_time) / 1000 AS avg_latency_sec,
             quantile_cont(total_elapsed_time, 0.95) / 1000 AS p95_latency_sec,
             avg(queued_overload_time) / 1000 AS avg_queue_sec,
             count(*) FILTER (WHERE queued_overload_time > 0) AS queued_count
      FROM query_history JOIN (SELECT warehouse_name, min(migrated_at) AS migration_ts FROM migration_log
                               WHERE action = 'MIGRATE' GROUP BY 1) USING (warehouse_name)
      WHERE start_time >= migration_ts - INTERVAL 14 DAY AND execution_status = 'SUCCESS' GROUP BY ALL""",
    "daily_savings": """
      SELECT warehouse_name, day_ts, daily AS actual_credits, baseline AS baseline_daily_credits,
             round((1 - daily / NULLIF(baseline, 0)) * 100, 1) AS savings_pct
      FROM (SELECT warehouse_name, period, date_trunc('day', hour_ts) AS day_ts,
                   CAST(sum(CAST(credits AS DECIMAL(18,2))) AS DOUBLE) AS daily FROM credit_comparison GROUP BY ALL) d
      JOIN (SELECT warehouse_name, avg(daily) AS baseline
            FROM (SELECT warehouse_name, date_trunc('day', hour_ts) AS day_ts,
                         CAST(sum(CAST(credits AS DECIMAL(18,2))) AS DOUBLE) AS daily
                  FROM credit_comparison WHERE period = 'PRE' GROUP BY ALL) GROUP BY 1) USING (warehouse_name)
      WHERE period = 'POST'""",
    "latest_migration": """
      SELECT warehouse_name, migrated_at, baseline_credits_7d
      FROM (SELECT *, row_number() OVER (PARTITION BY warehouse_name ORDER BY migrated_at DESC) AS rn
            FROM migration_log WHERE action = 'MIGRATE') WHERE rn = 1""",
    "idle": """
      SELECT warehouse_name, sum(credits) AS total_credits,
             sum(CASE WHEN coalesce(query_count, 0) = 0 THEN credits ELSE 0 END) AS idle_credits,
             count(DISTINCT hour_ts) AS total_hours, count(*) FILTER (WHERE coalesce(query_count, 0) = 0) AS idle_hours
      FROM hm LEFT JOIN (SELECT warehouse_name, hour_ts, query_count FROM hq) USING (warehouse_name, hour_ts)
      GROUP BY 1 HAVING sum(credits) > 0""",
    "anomalies_base": """
      SELECT warehouse_name, date_trunc('day', hour_ts) AS day_ts, sum(CAST(credits AS DECIMAL(20,6))) AS daily
      FROM hm GROUP BY ALL""",
}


def anomaly_sql(base: str) -> str:
    """Classified days of a (warehouse_name, day_ts, daily DECIMAL) relation."""
    return f"""
      SELECT warehouse_name, day_ts, CAST(daily AS DOUBLE) AS x, CAST(s AS DOUBLE) / n AS expected, sd,
             date_diff('day', CAST(day_ts AS DATE), last_day(CAST(day_ts AS DATE))) <= 1 AS is_month_end,
             dayofweek(day_ts) IN (0, 6) AS is_weekend, month(day_ts) IN (3, 6, 9, 12) AS quarter_month
      FROM (SELECT *, count(daily) OVER w AS n, sum(daily) OVER w AS s, stddev_samp(CAST(daily AS DOUBLE)) OVER w AS sd
            FROM {base}
            WINDOW w AS (PARTITION BY warehouse_name ORDER BY day_ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
      WHERE n >= 3"""


SQL_VIEWS["anomalies"] = f"""
      SELECT *, CASE WHEN x < expected * 0.2 AND expected > 1 AND NOT is_weekend THEN 'DROP'
                     WHEN x > expected * 2 AND is_month_end THEN 'EXPECTED_BATCH'
                     WHEN x > expected * 2 THEN 'SPIKE' END AS anomaly_type
      FROM ({anomaly_sql('anomalies_base')})"""


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, directly or through another view."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in SQL_VIEWS.items() if name in needed)
    if not ctes:
        return sql
    return f"WITH {ctes}\n{sql}"
