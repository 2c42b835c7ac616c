"""All registered queries."""

from __future__ import annotations

from . import anomaly_jobs, cost_jobs, default_jobs, governance_jobs, performance_jobs, store_jobs, stream_jobs
from .registry import ORACLES, QUERIES, Query

MODULES = (cost_jobs, performance_jobs, anomaly_jobs, governance_jobs, store_jobs, stream_jobs, default_jobs)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
