"""Checks and alerts with their own default look-backs, as of the middle of the data and of an hour.

The other registrations look back further, because the given events are sparse; here the short windows and their upper bound
are what is compared.
"""

from __future__ import annotations

import re

from ..operators import anomaly, performance, sla, validation
from ..sources import seeds
from . import governance_jobs, performance_jobs  # noqa: F401  their SQL is registered before it is narrowed here
from . import views as v
from .anomaly_jobs import LATENCY, QUEUE, _alert_sql, breach_sql
from .cost_jobs import NOW
from .performance_jobs import queries_of
from .registry import ORACLES, query

MIDDLE = "2024-01-16 12:30:00"
AT = f"TIMESTAMP '{MIDDLE}'"


def narrowed(sql: str, hours: int) -> str:
    """The SQL with its look-back replaced by ``hours`` up to MIDDLE."""
    found = re.escape(NOW) + r" - INTERVAL \d+ (?:HOUR|DAY)"
    return re.sub(rf"(start_time|hour_ts) >= {found}", rf"\1 BETWEEN {AT} - INTERVAL {hours} HOUR AND {AT}", sql)


SLA_WINDOW = f"start_time BETWEEN {AT} - INTERVAL 2 HOUR AND {AT}"


@query("sla_breaches_default", breach_sql(*LATENCY, window=SLA_WINDOW) + " UNION ALL " + breach_sql(*QUEUE, window=SLA_WINDOW))
def sla_breaches_default(spark, sf):
    return sla.detect_sla_breaches(queries_of(spark, sf), seeds.workload_sla(spark), MIDDLE)


@query("credit_spike_alert_default", narrowed(_alert_sql(4, 1.5), 4))
def credit_spike_alert_default(spark, sf):
    return anomaly.credit_spike_alert(v.migration_log(spark, sf), v.metering(spark, sf), MIDDLE)


@query("critical_spike_alert_default", narrowed(_alert_sql(6, 2.0), 6))
def critical_spike_alert_default(spark, sf):
    return anomaly.critical_spike_alert(v.migration_log(spark, sf), v.metering(spark, sf), MIDDLE)


@query("latency_regression_alert_default")
def latency_regression_alert_default(spark, sf):
    return anomaly.latency_regression_alert(queries_of(spark, sf), v.migration_log(spark, sf), MIDDLE)


@query("recent_performance_default")
def recent_performance_default(spark, sf):
    return performance.recent_performance(queries_of(spark, sf), MIDDLE)


@query("validate_error_rate_default")
def validate_error_rate_default(spark, sf):
    return validation.validate_error_rate(queries_of(spark, sf), v.migration_log(spark, sf), MIDDLE)


@query("validate_queue_default")
def validate_queue_default(spark, sf):
    return validation.validate_queue(queries_of(spark, sf), v.migration_log(spark, sf), MIDDLE)


@query("validate_credit_range_default")
def validate_credit_range_default(spark, sf):
    return validation.validate_credit_range(v.migration_log(spark, sf), v.metering(spark, sf), MIDDLE)


@query("validate_adaptive_queries_default")
def validate_adaptive_queries_default(spark, sf):
    return validation.validate_adaptive_queries(queries_of(spark, sf), v.migration_log(spark, sf), MIDDLE)


for name, hours in (
    ("latency_regression_alert", 4), ("recent_performance", 1), ("validate_error_rate", 6), ("validate_queue", 6),
    ("validate_credit_range", 6), ("validate_adaptive_queries", 6),
):
    ORACLES[f"{name}_default"] = narrowed(ORACLES[name], hours)
