"""Performance and before/after jobs."""

from __future__ import annotations

from ..operators import comparison, performance
from . import views as v
from .cost_jobs import HQ_COLUMNS, NOW, _since, he, hq
from .registry import big, query, r
from .views import AS_OF

TYPE = "CASE WHEN warehouse_size = 'ADAPTIVE' THEN 'ADAPTIVE' ELSE 'STANDARD' END"
PERF_SQL = f"""SELECT {HQ_COLUMNS}, {r('avg_elapsed_ms / 1000', 'avg_latency_sec')},
                      {r('p95_elapsed_ms / 1000', 'p95_latency_sec')}, {r('total_queue_ms / 1000', 'total_queue_sec')} FROM hq"""


def queries_of(spark, sf):
    return v.query_history(spark, sf)


@query("query_performance", PERF_SQL)
def query_performance(spark, sf):
    return performance.query_performance(hq(spark, sf))


@query(
    "performance_kpis",
    f"""SELECT {r('avg(avg_elapsed_ms / 1000)', 'avg_latency_sec')}, {r('avg(p95_elapsed_ms / 1000)', 'p95_latency_sec')},
               {big('sum(query_count)', 'total_queries')}, {big('sum(queued_queries)', 'total_queued')} FROM hq""",
)
def performance_kpis(spark, sf):
    return performance.performance_kpis(query_performance(spark, sf))


@query(
    "performance_kpis_weighted",
    f"""SELECT {r('sum(avg_elapsed_ms / 1000 * query_count) / sum(query_count) FILTER (WHERE avg_elapsed_ms IS NOT NULL)', 'avg_latency_sec')},
               {r('sum(p95_elapsed_ms / 1000 * query_count) / sum(query_count) FILTER (WHERE p95_elapsed_ms IS NOT NULL)', 'p95_latency_sec')},
               {big('sum(query_count)', 'total_queries')}, {big('sum(queued_queries)', 'total_queued')} FROM hq""",
)
def performance_kpis_weighted(spark, sf):
    return performance.performance_kpis(query_performance(spark, sf), weighted=True)


@query(
    "performance_by_pool_type",
    f"""SELECT CAST(end_time AS DATE) AS query_date, warehouse_name, {TYPE} AS warehouse_type, count(*) AS query_count,
               {r('avg(total_elapsed_time) / 1000', 'avg_latency_sec')}, {r('avg(execution_time) / 1000', 'avg_exec_sec')},
               {r('avg(queued_overload_time) / 1000', 'avg_queue_sec')},
               {r('avg(queued_provisioning_time) / 1000', 'avg_provisioning_sec')}
        FROM query_history WHERE {_since(14)} AND warehouse_name IS NOT NULL GROUP BY 1, 2, 3""",
)
def performance_by_pool_type(spark, sf):
    return performance.performance_by_pool_type(queries_of(spark, sf), AS_OF)


@query(
    "adaptive_vs_standard",
    f"""SELECT CAST(end_time AS DATE) AS ds, warehouse_name, {TYPE} AS warehouse_type,
               {r('avg(total_elapsed_time)', 'avg_query_time_ms')}, {r('avg(execution_time)', 'avg_exec_time_ms')},
               {r('avg(queued_overload_time)', 'avg_queued_overload_time_ms')},
               {r('avg(queued_provisioning_time)', 'avg_queued_provisioning_time_ms')}, count(*) AS query_count
        FROM query_history WHERE {_since(7)} AND warehouse_name IN (
          SELECT DISTINCT warehouse_name FROM query_history WHERE warehouse_size = 'ADAPTIVE' AND {_since(7)})
        GROUP BY 1, 2, 3""",
)
def adaptive_vs_standard(spark, sf):
    return performance.adaptive_vs_standard(queries_of(spark, sf), AS_OF)


@query(
    "latency_by_pool_type",
    f"""SELECT {TYPE} AS wh_type, count(*) AS total_queries, {r('round(avg(total_elapsed_time) / 1000, 2)', 'avg_latency_sec')},
               {r('round(quantile_cont(total_elapsed_time, 0.95) / 1000, 2)', 'p95_latency_sec')},
               {r('round(avg(queued_overload_time) / 1000, 2)', 'avg_queue_sec')}
        FROM query_history WHERE {_since(30)} AND execution_status = 'SUCCESS' AND warehouse_name IS NOT NULL GROUP BY 1""",
)
def latency_by_pool_type(spark, sf):
    return performance.latency_by_pool_type(queries_of(spark, sf), AS_OF, 30)


@query(
    "queue_load_analysis",
    f"""SELECT date_trunc('hour', start_time) AS hour_ts, warehouse_name, {r('avg(avg_running)', 'avg_running_queries')},
               {r('avg(avg_queued_load)', 'avg_queued_queries')}, {r('avg(avg_blocked)', 'avg_blocked_queries')}
        FROM load_history WHERE {_since(7)} GROUP BY 1, 2 HAVING avg(avg_queued_load) > 0""",
)
def queue_load_analysis(spark, sf):
    return performance.queue_load_analysis(v.load_history(spark, sf), AS_OF)


@query(
    "failure_detail",
    f"""SELECT warehouse_name, error_code, error_message, count(*) AS failed_queries,
               {r('round(sum(total_elapsed_time) / 3600000.0, 4)', 'wasted_hours')}
        FROM query_history WHERE {_since(30)} AND execution_status = 'FAIL' AND warehouse_name IS NOT NULL
        GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 20""",
)
def failure_detail(spark, sf):
    return performance.failure_detail(queries_of(spark, sf), AS_OF, 30)


@query(
    "events_summary",
    f"SELECT warehouse_name, event_name, {big('sum(event_count)', 'event_count')} FROM he GROUP BY 1, 2",
)
def events_summary(spark, sf):
    return performance.events_summary(he(spark, sf))


def _count_events(condition: str, alias: str) -> str:
    return big(f"sum(CASE WHEN {condition} THEN event_count ELSE 0 END)", alias)


@query(
    "suspend_resume",
    f"""SELECT warehouse_name,
               {_count_events("event_name IN ('SUSPEND_WAREHOUSE', 'SUSPEND_WAREHOUSE_SUCCEEDED')", 'suspends')},
               {_count_events("event_name IN ('RESUME_WAREHOUSE', 'RESUME_WAREHOUSE_SUCCEEDED')", 'resumes')},
               {_count_events("event_name ILIKE '%SCALE%'", 'scaling_events')} FROM he GROUP BY 1""",
)
def suspend_resume(spark, sf):
    return performance.suspend_resume(he(spark, sf))


@query(
    "concurrency_pattern",
    f"""SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts, {big("hour(date_trunc('hour', start_time))", 'hour_of_day')},
               count(DISTINCT user_name) AS active_users, count(*) AS queries,
               {r('avg(total_elapsed_time) / 1000', 'avg_sec')}, {r('max(queued_overload_time) / 1000', 'max_queue_sec')}
        FROM query_history WHERE {_since(30)} AND warehouse_name IS NOT NULL GROUP BY 1, 2""",
)
def concurrency_pattern(spark, sf):
    return performance.concurrency_pattern(queries_of(spark, sf), AS_OF, 30)


@query(
    "peak_offpeak",
    f"""SELECT warehouse_name, CASE WHEN dayofweek(start_time) IN (0, 6) THEN 'WEEKEND'
                                    WHEN hour(start_time) BETWEEN 9 AND 17 THEN 'PEAK' ELSE 'OFF_PEAK' END AS period,
               count(*) AS queries, {r('CAST(sum(credits_used_cloud_services) AS DOUBLE)', 'credits')},
               {r('avg(queued_overload_time) / 1000', 'avg_queue_sec')}
        FROM query_history WHERE {_since(14)} AND warehouse_name IS NOT NULL GROUP BY 1, 2""",
)
def peak_offpeak(spark, sf):
    return performance.peak_offpeak(queries_of(spark, sf), AS_OF)


@query(
    "workload_variability",
    f"""SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts, count(*) AS queries,
               {r('avg(total_elapsed_time) / 1000', 'avg_sec')}, {r('stddev_samp(total_elapsed_time) / 1000', 'stddev_sec')},
               count(*) FILTER (WHERE queued_overload_time > 0) AS queued
        FROM query_history WHERE {_since(30)} AND warehouse_name IS NOT NULL GROUP BY 1, 2""",
)
def workload_variability(spark, sf):
    return performance.workload_variability(queries_of(spark, sf), AS_OF, 30)


AGENT = "(query_tag LIKE '%cortex%' OR query_tag LIKE '%agent%')"


@query(
    "tag_share",
    f"""SELECT warehouse_name, count(*) AS total_queries, count(*) FILTER (WHERE {AGENT}) AS agent_queries,
               {r(f'round(count(*) FILTER (WHERE {AGENT}) / count(*) * 100, 1)', 'agent_pct')}
        FROM query_history WHERE {_since(30)} AND warehouse_name IS NOT NULL GROUP BY 1""",
)
def tag_share(spark, sf):
    return performance.tag_share(queries_of(spark, sf), AS_OF, days=30)


@query(
    "workload_classes",
    f"""SELECT warehouse_name, CASE WHEN {AGENT} THEN 'AGENT' WHEN query_tag LIKE '%ml%' OR query_tag LIKE '%scoring%' THEN 'ML_BATCH'
                                    ELSE 'OTHER' END AS workload_type,
               count(*) AS queries, {r('avg(total_elapsed_time) / 1000', 'avg_latency_sec')},
               {r('quantile_cont(total_elapsed_time, 0.95) / 1000', 'p95_sec')},
               {r('sum(queued_overload_time) / 1000', 'total_queue_sec')}
        FROM query_history WHERE {_since(30)} AND warehouse_name IS NOT NULL GROUP BY 1, 2""",
)
def workload_classes(spark, sf):
    return performance.workload_classes(queries_of(spark, sf), AS_OF, 30)


@query(
    "pipeline_duration",
    f"""SELECT warehouse_name, CAST(start_time AS DATE) AS run_date, min(start_time) AS pipeline_start,
               max(end_time) AS pipeline_end, date_diff('minute', min(start_time), max(end_time)) AS duration_min
        FROM query_history WHERE {_since(14)} AND query_tag LIKE '%etl_pipeline%' AND warehouse_name IS NOT NULL GROUP BY 1, 2""",
)
def pipeline_duration(spark, sf):
    return performance.pipeline_duration(queries_of(spark, sf), AS_OF)


@query(
    "slow_queries",
    f"""SELECT query_id, substr(query_text, 1, 100) AS query_preview, {r('total_elapsed_time / 1000', 'elapsed_sec')},
               {r('compilation_time / 1000', 'compile_sec')}, {r('execution_time / 1000', 'exec_sec')}
        FROM (SELECT * FROM query_history WHERE {_since(30)} AND warehouse_name IS NOT NULL
              ORDER BY total_elapsed_time DESC, query_id LIMIT 20)""",
)
def slow_queries(spark, sf):
    return performance.slow_queries(queries_of(spark, sf), AS_OF, days=30)


@query(
    "recent_performance",
    f"""SELECT warehouse_name, count(*) AS queries, {r('avg(total_elapsed_time) / 1000', 'avg_sec')},
               {r('max(queued_overload_time) / 1000', 'max_queue_sec')}
        FROM query_history WHERE start_time >= {NOW} - INTERVAL 24 HOUR AND warehouse_name IS NOT NULL GROUP BY 1""",
)
def recent_performance(spark, sf):
    return performance.recent_performance(queries_of(spark, sf), AS_OF, hours=24)


@query(
    "perf_summary",
    f"""SELECT warehouse_name, {r('avg(p95_elapsed_ms) / 1000', 'p95_sec')}, {r('avg(total_queue_ms) / 1000', 'queue_sec')}
        FROM hq GROUP BY 1""",
)
def perf_summary(spark, sf):
    return performance.perf_summary(hq(spark, sf))


# Before / after


def compared_credits(spark, sf):
    return comparison.credit_comparison(v.metering(spark, sf), v.migration_log(spark, sf))


def compared_performance(spark, sf):
    return comparison.performance_comparison(queries_of(spark, sf), v.migration_log(spark, sf))


def savings(spark, sf):
    return comparison.daily_savings(compared_credits(spark, sf))


def converted(spark, sf):
    return comparison.before_after(v.metering(spark, sf), v.events_history(spark, sf))


@query(
    "migration_dates",
    "SELECT warehouse_name, min(migrated_at) AS migration_ts FROM migration_log WHERE action = 'MIGRATE' GROUP BY 1",
)
def migration_dates(spark, sf):
    return comparison.migration_dates(v.migration_log(spark, sf))


CONVERSIONS = """SELECT warehouse_name, min(timestamp) AS migration_date FROM events_history
                 WHERE event_name = 'CONVERT_WAREHOUSE' AND event_reason = 'CONVERT_TO_ADAPTIVE' GROUP BY 1"""


@query("conversion_dates", CONVERSIONS)
def conversion_dates(spark, sf):
    return comparison.conversion_dates(v.events_history(spark, sf))


@query("credit_comparison", f"SELECT warehouse_name, hour_ts, period, {r('credits')} FROM credit_comparison")
def credit_comparison(spark, sf):
    return compared_credits(spark, sf)


@query(
    "performance_comparison",
    f"""SELECT warehouse_name, period, hour_ts, query_count, {r('avg_latency_sec')}, {r('p95_latency_sec')},
               {r('avg_queue_sec')}, queued_count FROM performance_comparison""",
)
def performance_comparison(spark, sf):
    return compared_performance(spark, sf)


@query(
    "daily_savings",
    f"""SELECT warehouse_name, day_ts, {r('actual_credits')}, {r('baseline_daily_credits')}, {r('savings_pct')}
        FROM daily_savings""",
)
def daily_savings(spark, sf):
    return savings(spark, sf)


BEFORE_AFTER = f"""
  SELECT warehouse_name, round(pre_c, 2) AS pre_credits_30d, round(coalesce(post_c, 0), 2) AS post_credits_30d,
         round(pre_c / NULLIF(pre_days, 0), 2) AS pre_daily_avg, round(coalesce(post_c, 0) / NULLIF(post_days, 0), 2) AS post_daily_avg,
         round((pre_c - coalesce(post_c, 0)) / NULLIF(pre_c, 0) * 100, 1) AS savings_pct
  FROM (SELECT warehouse_name, CAST(sum(credits_used) AS DOUBLE) AS pre_c, count(DISTINCT CAST(start_time AS DATE)) AS pre_days
        FROM ({CONVERSIONS}) JOIN metering USING (warehouse_name)
        WHERE start_time BETWEEN migration_date - INTERVAL 30 DAY AND migration_date GROUP BY 1)
  LEFT JOIN (SELECT warehouse_name, CAST(sum(credits_used) AS DOUBLE) AS post_c, count(DISTINCT CAST(start_time AS DATE)) AS post_days
        FROM ({CONVERSIONS}) JOIN metering USING (warehouse_name)
        WHERE start_time BETWEEN migration_date AND migration_date + INTERVAL 30 DAY GROUP BY 1) USING (warehouse_name)"""


@query(
    "before_after",
    f"""SELECT warehouse_name, {r('pre_credits_30d')}, {r('post_credits_30d')}, {r('pre_daily_avg')}, {r('post_daily_avg')},
               {r('savings_pct')} FROM ({BEFORE_AFTER})""",
)
def before_after(spark, sf):
    return converted(spark, sf)


@query(
    "before_after_kpis",
    f"SELECT {r('avg(savings_pct)', 'avg_savings_pct')}, count(*) AS warehouses_migrated FROM ({BEFORE_AFTER})",
)
def before_after_kpis(spark, sf):
    return comparison.before_after_kpis(converted(spark, sf))


@query(
    "before_after_long",
    f"""SELECT warehouse_name, 'PRE_DAILY_AVG' AS period, {r('pre_daily_avg', 'credits')} FROM ({BEFORE_AFTER})
        UNION ALL SELECT warehouse_name, 'POST_DAILY_AVG', {r('post_daily_avg', 'credits')} FROM ({BEFORE_AFTER})""",
)
def before_after_long(spark, sf):
    return comparison.before_after_long(converted(spark, sf))


def _side(column: str, condition: str) -> str:
    return f"avg({column}) FILTER (WHERE {condition}) / 1000"


PRE = f"start_time BETWEEN {NOW} - INTERVAL 10 DAY AND {NOW} - INTERVAL 3 DAY"
POST = f"start_time >= {NOW} - INTERVAL 3 DAY"


@query(
    "latency_before_after",
    f"""SELECT warehouse_name, {r('round(a, 2)', 'pre_avg_latency_sec')}, {r('round(b, 2)', 'post_avg_latency_sec')},
               {r('round((1 - b / NULLIF(a, 0)) * 100, 1)', 'latency_improvement_pct')},
               {r('round(c, 2)', 'pre_avg_queue_sec')}, {r('round(d, 2)', 'post_avg_queue_sec')},
               {r('round((1 - d / NULLIF(c, 0)) * 100, 1)', 'queue_reduction_pct')}
        FROM (SELECT warehouse_name, {_side('total_elapsed_time', PRE)} AS a, {_side('total_elapsed_time', POST)} AS b,
                     {_side('queued_overload_time', PRE)} AS c, {_side('queued_overload_time', POST)} AS d
              FROM query_history WHERE {_since(10)} AND warehouse_name IS NOT NULL GROUP BY 1)""",
)
def latency_before_after(spark, sf):
    return comparison.latency_before_after(queries_of(spark, sf), AS_OF)


@query(
    "query_volume_before_after",
    f"""SELECT warehouse_name, CASE WHEN start_time < first_at THEN 'PRE' ELSE 'POST' END AS period, count(*) AS query_count,
               {r('CAST(sum(credits_used_cloud_services) AS DOUBLE)', 'cloud_credits')}
        FROM query_history LEFT JOIN (SELECT warehouse_name, min(migrated_at) AS first_at FROM migration_log GROUP BY 1)
             USING (warehouse_name)
        WHERE {_since(30)} AND warehouse_name IS NOT NULL GROUP BY 1, 2""",
)
def query_volume_before_after(spark, sf):
    return comparison.query_volume_before_after(queries_of(spark, sf), v.migration_log(spark, sf), AS_OF, 30)
