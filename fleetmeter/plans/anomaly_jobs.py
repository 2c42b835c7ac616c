"""Anomaly, alert and SLA jobs."""

from __future__ import annotations

from ..operators import anomaly, sla
from ..operators.rollups import hourly_metering
from ..sources import seeds
from . import views as v
from .cost_jobs import NOW, hm
from .performance_jobs import queries_of
from .registry import query, r
from .views import AS_OF, ORDERS_AS_OF, ORDERS_DAYS, anomaly_sql

ANOMALY_COLUMNS = f"""warehouse_name, day_ts, {r('round_even(x, 2)', 'daily_credits')},
    {r('round_even(expected, 2)', 'expected_credits')}, {r('sd', 'rolling_std')},
    {r('CASE WHEN sd = 0 THEN 0 ELSE round_even((x - expected) / sd, 2) END', 'z_score')},
    CAST(day(day_ts) AS BIGINT) AS day_of_month, CAST(day(last_day(CAST(day_ts AS DATE))) AS BIGINT) AS days_in_month,
    is_month_end, is_month_end AND quarter_month AS is_quarter_end, is_weekend, anomaly_type"""


def found(spark, sf):
    return anomaly.credit_anomalies(hm(spark, sf))


@query("credit_anomalies", f"SELECT {ANOMALY_COLUMNS} FROM anomalies WHERE anomaly_type IS NOT NULL")
def credit_anomalies(spark, sf):
    return found(spark, sf)


ORDER_DAYS = """(SELECT warehouse_name, date_trunc('day', start_time) AS day_ts, CAST(sum(credits_used) AS DECIMAL(20,6)) AS daily
                 FROM orders_metering GROUP BY ALL)"""


@query(
    "credit_anomalies_orders",
    f"""SELECT {ANOMALY_COLUMNS} FROM (
          SELECT *, CASE WHEN x < expected * 0.2 AND expected > 1 AND NOT is_weekend THEN 'DROP'
                         WHEN x > expected * 2 AND is_month_end THEN 'EXPECTED_BATCH'
                         WHEN x > expected * 2 THEN 'SPIKE' END AS anomaly_type
          FROM ({anomaly_sql(ORDER_DAYS)})) WHERE anomaly_type IS NOT NULL""",
)
def credit_anomalies_orders(spark, sf):
    """Seven years of days: month ends, quarter ends and weekends all occur."""
    return anomaly.credit_anomalies(hourly_metering(v.orders_metering(spark, sf), ORDERS_AS_OF, ORDERS_DAYS))


@query(
    "anomaly_counts",
    """SELECT count(*) FILTER (WHERE anomaly_type = 'SPIKE') AS unexpected_spikes,
              count(*) FILTER (WHERE anomaly_type = 'DROP') AS unexpected_drops,
              count(*) FILTER (WHERE anomaly_type = 'EXPECTED_BATCH') AS expected_batch_spikes,
              count(DISTINCT warehouse_name) AS warehouses_affected
       FROM anomalies WHERE anomaly_type IS NOT NULL""",
)
def anomaly_counts(spark, sf):
    return anomaly.anomaly_counts(found(spark, sf))


COVERED = """EXISTS (SELECT 1 FROM regulatory_calendar c
                     WHERE c.suppress_anomaly AND CAST(a.day_ts AS DATE) BETWEEN c.start_date AND c.end_date
                       AND (c.affected_warehouses = 'ALL'
                            OR list_contains(string_split(c.affected_warehouses, ', '), a.warehouse_name)))"""


@query(
    "calendar_suppression",
    f"""SELECT {ANOMALY_COLUMNS}, {COVERED} AS suppressed FROM anomalies a WHERE anomaly_type IS NOT NULL""",
)
def calendar_suppression(spark, sf):
    return anomaly.calendar_suppression(found(spark, sf), v.regulatory_calendar(spark, sf))


def _alert_sql(hours: int, factor: float) -> str:
    return f"""SELECT warehouse_name, {r('baseline_credits_7d / 7 / 24', 'baseline_hourly')}, {r('used', 'recent_credits')},
                      {r(f'baseline_credits_7d / 7 / 24 * {hours} * {factor}', 'alert_threshold')}
               FROM latest_migration JOIN (SELECT warehouse_name, CAST(sum(credits_used) AS DOUBLE) AS used FROM metering
                    WHERE start_time >= {NOW} - INTERVAL {hours} HOUR GROUP BY 1) USING (warehouse_name)
               WHERE used > baseline_credits_7d / 7 / 24 * {hours} * {factor}"""


@query("credit_spike_alert", _alert_sql(4, 1.5))
def credit_spike_alert(spark, sf):
    return anomaly.credit_spike_alert(v.migration_log(spark, sf), v.metering(spark, sf), AS_OF)


@query("critical_spike_alert", _alert_sql(6, 2.0))
def critical_spike_alert(spark, sf):
    return anomaly.critical_spike_alert(v.migration_log(spark, sf), v.metering(spark, sf), AS_OF)


@query(
    "latency_regression_alert",
    f"""SELECT warehouse_name, {r('b', 'baseline_p95_sec')}, {r('l', 'lowest_p95_sec')}, recent_hours
        FROM (SELECT warehouse_name, avg(p95_latency_sec) FILTER (WHERE period = 'PRE') AS b,
                     min(p95_latency_sec) FILTER (WHERE period = 'POST' AND hour_ts >= {NOW} - INTERVAL 48 HOUR) AS l,
                     count(*) FILTER (WHERE period = 'POST' AND hour_ts >= {NOW} - INTERVAL 48 HOUR) AS recent_hours
              FROM performance_comparison GROUP BY 1) WHERE l > b * 1.25""",
)
def latency_regression_alert(spark, sf):
    """A wider look-back than the default four hours, because the events are sparse."""
    return anomaly.latency_regression_alert(queries_of(spark, sf), v.migration_log(spark, sf), AS_OF, hours=48)


SEVERITY = "CASE priority WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END"


def breach_sql(kind: str, actual: str, threshold: str, condition: str, window: str = f"start_time >= {NOW} - INTERVAL 30 DAY") -> str:
    return f"""SELECT warehouse_name, workload_class, '{kind}' AS breach_type, {r(threshold, 'sla_threshold')},
                      {r(actual, 'actual_value')}, date_trunc('hour', start_time) AS breach_window, {SEVERITY} AS severity
               FROM query_history JOIN workload_sla ON warehouse_name LIKE warehouse_pattern AND is_active
               WHERE {window} AND {condition}
               GROUP BY warehouse_name, workload_class, {threshold}, date_trunc('hour', start_time), priority
               HAVING {actual} > {threshold}"""


LATENCY = ("LATENCY", "quantile_cont(total_elapsed_time, 0.95) / 1000.0", "max_p95_latency_sec", "execution_status = 'SUCCESS'")
QUEUE = ("QUEUE", "avg(queued_overload_time) / 1000.0", "max_queue_sec", "queued_overload_time > 0")
ERRORS = (
    "ERROR_RATE", "count(*) FILTER (WHERE execution_status = 'FAIL') / count(*) * 100", "max_error_rate_pct", "TRUE",
)
WHOLE = 30 * 24


@query("sla_latency_breaches", breach_sql(*LATENCY))
def sla_latency_breaches(spark, sf):
    return sla.sla_latency_breaches(queries_of(spark, sf), seeds.workload_sla(spark), AS_OF, WHOLE)


@query("sla_queue_breaches", breach_sql(*QUEUE))
def sla_queue_breaches(spark, sf):
    return sla.sla_queue_breaches(queries_of(spark, sf), seeds.workload_sla(spark), AS_OF, WHOLE)


@query("sla_error_rate_breaches", breach_sql(*ERRORS))
def sla_error_rate_breaches(spark, sf):
    return sla.sla_error_rate_breaches(queries_of(spark, sf), seeds.workload_sla(spark), AS_OF, WHOLE)


@query("detect_sla_breaches", breach_sql(*LATENCY) + " UNION ALL " + breach_sql(*QUEUE))
def detect_sla_breaches(spark, sf):
    return sla.detect_sla_breaches(queries_of(spark, sf), seeds.workload_sla(spark), AS_OF, WHOLE)


@query(
    "sla_severity",
    f"""SELECT workload_class, priority::BIGINT AS priority, {SEVERITY} AS severity FROM sla_catalogue""",
)
def sla_severity(spark, sf):
    from ..functions.labels import sla_severity as severity

    return v.sla_catalogue(spark, sf).select("workload_class", "priority", severity().alias("severity"))


@query(
    "sla_definitions",
    f"""SELECT workload_class, warehouse_pattern, {r('max_p95_latency_sec')}, {r('max_queue_sec')}, {r('max_error_rate_pct')},
               priority::BIGINT AS priority, escalation_contact, is_active FROM sla_catalogue""",
)
def sla_definitions(spark, sf):
    return sla.sla_definitions(v.sla_catalogue(spark, sf))


RECENT_BREACHES = f"""SELECT * FROM sla_breach_log WHERE detected_at >= {NOW} - INTERVAL 30 DAY
                      ORDER BY detected_at DESC, warehouse_name, workload_class, breach_window, breach_type LIMIT 50"""


@query(
    "recent_breaches",
    f"""SELECT detected_at, warehouse_name, workload_class, breach_type, {r('sla_threshold')}, {r('actual_value')}, severity,
               acknowledged FROM ({RECENT_BREACHES})""",
)
def recent_breaches(spark, sf):
    return sla.recent_breaches(v.sla_breach_log(spark, sf), AS_OF)


@query(
    "breach_counts",
    """SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_breaches,
              count(*) FILTER (WHERE severity = 'HIGH') AS high_breaches, count(*) AS total_breaches,
              count(*) FILTER (WHERE NOT acknowledged) AS unacknowledged FROM sla_breach_log""",
)
def breach_counts(spark, sf):
    return sla.breach_counts(v.sla_breach_log(spark, sf))
