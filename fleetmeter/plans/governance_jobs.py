"""Assessment, scenario, lifecycle, governance and validation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import recommendation_band
from ..operators import assessment, governance, lifecycle, validation
from ..sources import seeds
from . import views as v
from .cost_jobs import NOW, PRICE_SQL, USED_7D, _since, credit_price, hm, hq
from .performance_jobs import compared_credits, compared_performance, queries_of, savings
from .registry import big, query, r
from .views import AS_OF

DAYS = 30
HOURS = DAYS * 24


# Assessment


def _score(cv: str, active: str, queued: str, credits: str, hours: float) -> str:
    def cap(x: str, limit: int) -> str:
        return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE least(CAST({x} AS DOUBLE), {limit}) END"

    return (
        f"({cap(f'{cv} * 40', 40)} + {cap(f'(1 - {active} / {float(hours)}::DOUBLE) * 30', 30)} + "
        f"{cap(f'{queued} / NULLIF({active}, 0) * 5', 20)} + {cap(f'{credits} / 100', 10)})"
    )


BAND = "CASE WHEN {s} >= 80 THEN 'MIGRATE NOW' WHEN {s} >= 60 THEN 'STRONG CANDIDATE' WHEN {s} >= 40 THEN 'EVALUATE' ELSE 'KEEP STANDARD' END"

USAGE = f"""SELECT warehouse_name, count(*) AS active_hours, sum(credits) AS total_credits,
                   CASE WHEN avg(credits) > 0 THEN stddev_samp(credits) / avg(credits) ELSE 0 END AS credit_cv,
                   sum(queued) AS queued
            FROM hm LEFT JOIN (SELECT warehouse_name, date_trunc('hour', start_time) AS hour_ts,
                                      count(*) FILTER (WHERE queued_overload_time > 0) AS queued
                               FROM query_history WHERE {_since(30)} AND warehouse_name IS NOT NULL AND execution_status = 'SUCCESS'
                               GROUP BY 1, 2) USING (warehouse_name, hour_ts) GROUP BY 1"""


@query(
    "assessment_sql",
    f"""SELECT warehouse_name, warehouse_type, warehouse_size, active_hours, {big(str(HOURS), 'total_hours')},
               {r(f'round(active_hours / {float(HOURS)}::DOUBLE * 100, 1)', 'utilization_pct')},
               {r('round(total_credits, 2)', 'total_credits')}, {r('round(credit_cv, 3)', 'variability_score')},
               {big('coalesce(queued, 0)', 'total_queued_queries')}, {r('round(score, 1)', 'adaptive_score')},
               {BAND.format(s='score')} AS recommendation
        FROM (SELECT *, {_score('credit_cv', 'active_hours', 'coalesce(queued, 0)', 'total_credits', HOURS)} AS score
              FROM (SELECT warehouse_name, warehouse_type, warehouse_size FROM inventory WHERE warehouse_type = 'STANDARD')
              LEFT JOIN ({USAGE}) USING (warehouse_name))""",
)
def assessment_sql(spark, sf):
    return assessment.assessment_sql(v.inventory(spark, sf), v.metering(spark, sf), queries_of(spark, sf), AS_OF, DAYS)


@query(
    "score_components",
    f"""SELECT warehouse_name, {r('least(credit_cv * 40, 40.0) + 0 * credit_cv', 'variability_component')},
               {r(f'least((1 - active_hours / {float(HOURS)}::DOUBLE) * 30, 30)', 'idle_component')},
               {r('least(coalesce(queued, 0) / active_hours * 5, 20)', 'queue_component')},
               {r('least(total_credits / 100, 10)', 'credit_component')} FROM ({USAGE})""",
)
def score_components(spark, sf):
    stats = assessment.usage_stats(v.metering(spark, sf), queries_of(spark, sf), AS_OF, DAYS)
    parts = assessment.score_components(
        F.col("credit_cv"), F.col("active_hours"), F.coalesce("total_queued_queries", F.lit(0)), F.col("total_credits"), HOURS
    )
    return stats.select("warehouse_name", *parts)


@query(
    "recommendation_band",
    f"""SELECT warehouse_name, {BAND.format(s='score')} AS recommendation
        FROM (SELECT warehouse_name, {_score('credit_cv', 'active_hours', 'coalesce(queued, 0)', 'total_credits', HOURS)} AS score
              FROM ({USAGE}))""",
)
def band(spark, sf):
    stats = assessment.usage_stats(v.metering(spark, sf), queries_of(spark, sf), AS_OF, DAYS)
    score = assessment.readiness_score(
        F.col("credit_cv"), F.col("active_hours"), F.coalesce("total_queued_queries", F.lit(0)), F.col("total_credits"), HOURS
    )
    return stats.select("warehouse_name", recommendation_band(score).alias("recommendation"))


SCORES = f"""
  SELECT *, round_even({_score('variability', 'active_hours', 'queued_queries', 'total_credits', HOURS)}, 1) AS adaptive_score
  FROM (SELECT warehouse_name, active_hours, avg_credits, std_credits, total_credits,
               coalesce(queued_queries, 0) AS queued_queries, coalesce(complex_queries, 0) AS complex_queries,
               coalesce(total_queries, 0) AS total_queries, coalesce(latency_stddev, 0) AS latency_stddev,
               coalesce(round_even(std_credits / NULLIF(avg_credits, 0), 3), 0) AS variability
        FROM (SELECT warehouse_name, count(DISTINCT hour_ts) AS active_hours, avg(credits) AS avg_credits,
                     coalesce(stddev_samp(credits), 0) AS std_credits, sum(credits) AS total_credits
              FROM hm WHERE warehouse_name NOT IN (SELECT warehouse_name FROM inventory
                    WHERE warehouse_type = 'ADAPTIVE' OR warehouse_size IN ('5X-Large', '6X-Large')) GROUP BY 1)
        LEFT JOIN (SELECT warehouse_name, sum(queued_queries) AS queued_queries, sum(complex_queries) AS complex_queries,
                          sum(query_count) AS total_queries, avg(latency_stddev) AS latency_stddev FROM hq GROUP BY 1)
             USING (warehouse_name))"""
SCORE_COLUMNS = f"""warehouse_name, active_hours, {r('avg_credits')}, {r('std_credits')}, {r('total_credits')},
    {big('queued_queries')}, {big('complex_queries')}, {big('total_queries')}, {r('latency_stddev')}, {r('variability')},
    {r('adaptive_score')}"""
MULTI = "coalesce(regexp_full_match(max_clusters, '[0-9]+') AND TRY_CAST(max_clusters AS BIGINT) > 1, FALSE)"


@query("assessment_scores", f"SELECT {SCORE_COLUMNS} FROM ({SCORES})")
def assessment_scores(spark, sf):
    return assessment.assessment_scores(hm(spark, sf), hq(spark, sf), DAYS, v.inventory(spark, sf))


@query(
    "assessment_enriched",
    f"""SELECT {SCORE_COLUMNS}, coalesce(warehouse_type, 'UNKNOWN') AS warehouse_type,
               coalesce(warehouse_size, '') AS warehouse_size, CASE WHEN {MULTI} THEN 'Yes' ELSE 'No' END AS multi_cluster
        FROM ({SCORES}) LEFT JOIN inventory USING (warehouse_name)""",
)
def assessment_enriched(spark, sf):
    return assessment.assessment_enriched(assessment_scores(spark, sf), v.inventory(spark, sf))


@query(
    "assessment_windowless",
    f"""SELECT warehouse_name, active_hours, {r('round(total, 2)', 'total_credits_14d')}, {r('round(cv, 3)', 'variability')},
               queued_queries, {r(f"round({_score('cv', 'active_hours', 'queued_queries', 'total', HOURS)}, 1)", 'adaptive_score')}
        FROM (SELECT warehouse_name, count(*) AS active_hours, sum(credits) AS total,
                     CASE WHEN avg(credits) > 0 THEN stddev_samp(credits) / avg(credits) ELSE 0 END AS cv,
                     coalesce(any_value(queued), 0) AS queued_queries
              FROM hm LEFT JOIN (SELECT warehouse_name, count(*) FILTER (WHERE queued_overload_time > 0) AS queued
                                 FROM query_history WHERE {_since(30)} AND warehouse_name IS NOT NULL GROUP BY 1)
                   USING (warehouse_name) GROUP BY 1)""",
)
def assessment_windowless(spark, sf):
    return assessment.assessment_windowless(v.metering(spark, sf), queries_of(spark, sf), AS_OF, DAYS)


@query(
    "fleet_kpis",
    f"""SELECT count(*) AS total_warehouses, count(*) FILTER (WHERE warehouse_type = 'ADAPTIVE') AS adaptive,
               count(*) FILTER (WHERE warehouse_type <> 'ADAPTIVE') AS standard, count(*) FILTER (WHERE {MULTI}) AS multi_cluster,
               {r("round_even(count(*) FILTER (WHERE warehouse_type = 'ADAPTIVE') / count(*) * 100, 1)", 'adoption_pct')}
        FROM inventory""",
)
def fleet_kpis(spark, sf):
    return assessment.fleet_kpis(v.inventory(spark, sf))


@query("multi_cluster", f"SELECT warehouse_name, max_clusters FROM inventory WHERE {MULTI}")
def multi_cluster(spark, sf):
    return assessment.multi_cluster(v.inventory(spark, sf))


SCENARIO = "CASE WHEN utilization_pct < 30 THEN 'Optimistic (35%)' WHEN utilization_pct < 60 THEN 'Moderate (25%)' ELSE 'Conservative (15%)' END"
FACTOR = "CASE WHEN utilization_pct < 30 THEN 0.65 WHEN utilization_pct < 60 THEN 0.75 ELSE 0.85 END::DOUBLE"
STATS = f"""
  SELECT *, total_credits - idle_credits AS active_credits,
         (total_credits - idle_credits) * 0.10::DOUBLE * (clusters - 1) AS overhead
  FROM (SELECT warehouse_name, any_value(warehouse_size) AS warehouse_size,
               any_value(CASE WHEN {MULTI} THEN CAST(max_clusters AS BIGINT) ELSE 1 END) AS clusters,
               sum(credits) AS total_credits, count(*) AS active_hours,
               count(*) / {float(HOURS)}::DOUBLE * 100 AS utilization_pct,
               coalesce(sum(query_count), 0) AS total_queries, coalesce(any_value(avg_ms), 0) / 1000 AS avg_latency_sec,
               coalesce(any_value(queued), 0) AS queued_queries,
               CASE WHEN any_value(observed) THEN
                 sum(CASE WHEN hour_ts < {NOW} - INTERVAL 2 HOUR AND coalesce(query_count, 0) = 0 THEN credits ELSE 0 END)
                 ELSE sum(credits) * 0.3::DOUBLE END AS idle_credits
        FROM hm JOIN (SELECT * FROM inventory WHERE warehouse_type <> 'ADAPTIVE') USING (warehouse_name)
        LEFT JOIN (SELECT warehouse_name, hour_ts, query_count FROM hq) USING (warehouse_name, hour_ts)
        LEFT JOIN (SELECT warehouse_name, TRUE AS observed, avg(avg_elapsed_ms) AS avg_ms, sum(queued_queries) AS queued
                   FROM hq GROUP BY 1) USING (warehouse_name)
        GROUP BY 1)"""


def scenario_inputs(spark, sf):
    return hm(spark, sf), hq(spark, sf), v.inventory(spark, sf), AS_OF, DAYS


@query(
    "scenario_projection",
    f"""SELECT warehouse_name, scenario, {r('total_credits', 'current_credits')}, {r('p', 'projected_credits')},
               {r('total_credits - p', 'credits_saved')},
               {r('CASE WHEN total_credits <> 0 THEN (total_credits - p) / total_credits * 100 ELSE 0 END', 'savings_pct')},
               {r(f'(total_credits - p) * ({PRICE_SQL}) * 365 / {DAYS}', 'annual_savings_usd')}, scenario = {SCENARIO} AS is_default
        FROM (SELECT *, greatest(active_credits * factor - overhead, 0) AS p
              FROM ({STATS}), (VALUES ('Conservative (15%)', 0.85::DOUBLE), ('Moderate (25%)', 0.75::DOUBLE),
                                      ('Optimistic (35%)', 0.65::DOUBLE), ('Aggressive (45%)', 0.55::DOUBLE)) f(scenario, factor))""",
)
def scenario_projection(spark, sf):
    return assessment.scenario_projection(*scenario_inputs(spark, sf), price=credit_price(spark, sf))


@query(
    "scenario_default",
    f"SELECT warehouse_name, {r('utilization_pct')}, {SCENARIO} AS scenario FROM ({STATS})",
)
def scenario_default(spark, sf):
    return assessment.scenario_stats(*scenario_inputs(spark, sf)).select(
        "warehouse_name", "utilization_pct", assessment.scenario_default(F.col("utilization_pct")).alias("scenario")
    )


HOURLY = f"""SELECT warehouse_name, hour_ts, credits AS actual,
                    CASE WHEN o.observed IS NULL OR coalesce(query_count, 0) > 0 THEN credits * {FACTOR} ELSE 0 END AS projected
             FROM hm JOIN ({STATS}) s USING (warehouse_name)
             LEFT JOIN (SELECT warehouse_name, hour_ts, query_count FROM hq) USING (warehouse_name, hour_ts)
             LEFT JOIN (SELECT DISTINCT warehouse_name, TRUE AS observed FROM hq) o USING (warehouse_name)"""


@query(
    "scenario_hourly",
    f"""SELECT warehouse_name, hour_ts, 'Gen1' AS type, {r('actual', 'credits')} FROM ({HOURLY})
        UNION ALL SELECT warehouse_name, hour_ts, 'Adaptive', {r('projected', 'credits')} FROM ({HOURLY})""",
)
def scenario_hourly(spark, sf):
    return assessment.scenario_hourly(*scenario_inputs(spark, sf))


FINDINGS = f"""SELECT *, CASE WHEN total_credits <> 0 THEN
                   (total_credits - greatest(active_credits * {FACTOR} - overhead, 0)) / total_credits * 100 ELSE 0 END AS saved
               FROM ({STATS})"""
RULES = [
    ("IDLE_ELIMINATED", "idle_credits > total_credits * 0.2", "idle_credits"),
    ("QUEUE_ELIMINATED", "queued_queries > 0", "CAST(queued_queries AS DOUBLE)"),
    ("MULTI_CLUSTER_REMOVED", "clusters > 1", "CAST(clusters AS DOUBLE)"),
    ("LOW_UTILIZATION", "utilization_pct < 50", "utilization_pct"),
    ("COST_REDUCTION", "saved > 20", "saved"),
    ("QUEUED_LATENCY_IMPROVES", "queued_queries > 0 AND avg_latency_sec > 0", "avg_latency_sec"),
    ("UNSUPPORTED_SIZE", "warehouse_size IN ('5X-Large', '6X-Large')", "CAST(NULL AS DOUBLE)"),
    (
        "STEADY_WORKLOAD",
        "NOT (idle_credits > total_credits * 0.2 OR queued_queries > 0 OR clusters > 1 OR utilization_pct < 50 "
        "OR saved > 20 OR coalesce(warehouse_size, '') IN ('5X-Large', '6X-Large'))",
        "CAST(NULL AS DOUBLE)",
    ),
]


@query(
    "scenario_findings",
    " UNION ALL ".join(
        f"SELECT warehouse_name, '{name}' AS finding, {r(value, 'value')} FROM ({FINDINGS}) WHERE {rule}"
        for name, rule, value in RULES
    ),
)
def scenario_findings(spark, sf):
    return assessment.scenario_findings(*scenario_inputs(spark, sf))


def _plan_sql(where: str) -> str:
    return f"""SELECT 'SUMMARY' AS row_kind, count(*) AS total_warehouses, 'WAREHOUSE_TYPE' AS property_to_update,
                      'ADAPTIVE' AS property_value_to_set, 'dry-run' AS mode, NULL AS name, NULL AS warehouse_size,
                      NULL AS max_query_performance_level, NULL AS query_throughput_multiplier
               FROM inventory WHERE {where}
               UNION ALL
               SELECT 'WAREHOUSE', NULL, NULL, NULL, NULL, warehouse_name, warehouse_size, max_query_perf_level,
                      throughput_multiplier FROM inventory WHERE {where}"""


@query("bulk_plan", _plan_sql("warehouse_type = 'STANDARD' AND regexp_full_match(warehouse_name, 'ANALYTICS_.*')"))
def bulk_plan(spark, sf):
    return assessment.bulk_plan(v.inventory(spark, sf), {"WAREHOUSE_TYPE": "STANDARD", "name": "ANALYTICS_.*"})


@query(
    "bulk_plan_by_tag",
    _plan_sql(
        "warehouse_type = 'STANDARD' AND warehouse_name IN (SELECT object_name FROM tag_references "
        "WHERE tag_name = 'cost-centre' AND tag_value = 'sales')"
    ),
)
def bulk_plan_by_tag(spark, sf):
    return assessment.bulk_plan(
        v.inventory(spark, sf), {"WAREHOUSE_TYPE": "STANDARD"}, {"cost-centre": "sales"}, v.tag_references(spark, sf)
    )


@query(
    "guardrail_coverage",
    f"""SELECT count(*) FILTER (WHERE trim(resource_monitor) <> '') AS with_resource_monitor,
               count(*) FILTER (WHERE trim(max_query_perf_level) <> '') AS perf_level_tuned,
               count(*) FILTER (WHERE {MULTI}) AS multi_cluster FROM inventory""",
)
def guardrail_coverage(spark, sf):
    return assessment.guardrail_coverage(v.inventory(spark, sf))


PLAIN = "replace(replace(lower(substr(a.region, length(split_part(a.region, '_', 1)) + 2)), '_', ''), '-', '')"


@query(
    "region_support",
    f"""SELECT account, region, cloud, matched_region,
               CASE WHEN ga THEN 'GA' WHEN preview THEN 'PREVIEW' ELSE 'UNAVAILABLE' END AS status
        FROM (SELECT a.account, a.region, split_part(a.region, '_', 1) AS cloud, min(s.region) AS matched_region,
                     arg_min(s.adaptive_ga, s.region) AS ga, arg_min(s.adaptive_preview, s.region) AS preview
              FROM accounts a LEFT JOIN regions s ON s.cloud_provider = split_part(a.region, '_', 1)
                   AND (contains({PLAIN}, replace(s.region, '-', '')) OR contains(replace(s.region, '-', ''), {PLAIN}))
              GROUP BY 1, 2, 3)""",
)
def region_support(spark, sf):
    return governance.region_support(v.accounts(spark, sf), seeds.region_support(spark))


@query("region_matrix", "SELECT cloud_provider, region, region_display, adaptive_ga, adaptive_preview FROM supplier_regions")
def region_matrix(spark, sf):
    return governance.region_matrix(spark, v.regions_from_suppliers(spark, sf))


# Governance

AUDIT_RECENT = "SELECT * FROM audit_log ORDER BY event_timestamp DESC, event_id DESC LIMIT 100"


@query(
    "audit_recent",
    f"""SELECT event_timestamp, username, role_name, event_type, warehouse_name,
               json_extract_string(event_detail, '$.section') AS detail FROM ({AUDIT_RECENT})""",
)
def audit_recent(spark, sf):
    return governance.audit_recent(v.audit_log(spark, sf))


@query(
    "audit_kpis",
    f"""SELECT count(*) AS total_events, count(DISTINCT username) AS unique_users,
               count(*) FILTER (WHERE event_type = 'SIMULATION') AS simulations FROM audit_log""",
)
def audit_kpis(spark, sf):
    return governance.audit_kpis(v.audit_log(spark, sf))


REQUESTS_RECENT = "SELECT * FROM migration_requests ORDER BY created_at DESC, request_id DESC LIMIT 30"


@query(
    "requests_recent",
    f"""SELECT request_id, created_at, requested_by, warehouse_name, status, {r('estimated_savings')}, justification,
               reviewed_by, review_notes FROM ({REQUESTS_RECENT})""",
)
def requests_recent(spark, sf):
    return governance.requests_recent(v.migration_requests(spark, sf))


STATUS_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s.upper()}') AS {s}" for s in ("pending", "approved", "executed", "rejected"))


@query("request_status_counts", f"SELECT {STATUS_COUNTS} FROM migration_requests")
def request_status_counts(spark, sf):
    return governance.request_status_counts(v.migration_requests(spark, sf))


TRANSITIONS = """
  SELECT request_id, warehouse_name, created_at, requested_by, coalesce(s, 'PENDING') AS status, reviewed_by, reviewed_at,
         review_notes, executed_at, rollback_at, coalesce(illegal, 0) AS illegal_moves
  FROM (SELECT request_id, warehouse_name, created_at, requested_by FROM migration_requests)
  LEFT JOIN (
    SELECT request_id, arg_max(status, event_time) AS s,
           arg_max(actor, event_time) FILTER (WHERE status IN ('APPROVED', 'REJECTED')) AS reviewed_by,
           max(event_time) FILTER (WHERE status IN ('APPROVED', 'REJECTED')) AS reviewed_at,
           arg_max(notes, event_time) FILTER (WHERE status IN ('APPROVED', 'REJECTED')) AS review_notes,
           max(event_time) FILTER (WHERE status = 'EXECUTED') AS executed_at,
           max(event_time) FILTER (WHERE status = 'ROLLED_BACK') AS rollback_at,
           count(*) FILTER (WHERE NOT ((before = 'PENDING' AND status IN ('APPROVED', 'REJECTED'))
                                       OR (before = 'APPROVED' AND status = 'EXECUTED')
                                       OR (before = 'EXECUTED' AND status = 'ROLLED_BACK'))) AS illegal
    FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY request_id ORDER BY event_time, event_id), 'PENDING') AS before
          FROM request_events) GROUP BY 1) USING (request_id)"""


@query("request_transitions", TRANSITIONS)
def request_transitions(spark, sf):
    return governance.request_transitions(v.migration_requests(spark, sf), v.request_events(spark, sf))


@query(
    "active_blackouts",
    """SELECT event_name, start_date, end_date, notes FROM regulatory_calendar
       WHERE event_type = 'BLACKOUT' AND end_date >= DATE '2024-01-31'""",
)
def active_blackouts(spark, sf):
    return governance.active_blackouts(v.regulatory_calendar(spark, sf), AS_OF)


@query(
    "blackout_violations",
    """SELECT request_id, any_value(warehouse_name) AS warehouse_name, any_value(executed_at) AS executed_at,
              count(*) AS blackout_windows, min(event_name) AS first_window
       FROM migration_requests JOIN regulatory_calendar
         ON CAST(executed_at AS DATE) BETWEEN start_date AND end_date AND event_type = 'BLACKOUT'
        AND (affected_warehouses = 'ALL' OR list_contains(string_split(affected_warehouses, ', '), warehouse_name))
       GROUP BY request_id""",
)
def blackout_violations(spark, sf):
    return governance.blackout_violations(v.migration_requests(spark, sf), v.regulatory_calendar(spark, sf))


@query(
    "calendar_upcoming",
    f"""SELECT event_name, event_type, start_date, end_date, {r('expected_spike_factor')}, notes FROM regulatory_calendar
        WHERE end_date >= DATE '2024-01-31'""",
)
def calendar_upcoming(spark, sf):
    return governance.calendar_upcoming(v.regulatory_calendar(spark, sf), AS_OF)


@query(
    "calendar_all",
    f"""SELECT event_name, event_type, start_date, end_date, affected_warehouses, {r('expected_spike_factor')},
               suppress_anomaly, notes FROM regulatory_calendar""",
)
def calendar_all(spark, sf):
    return governance.calendar_all(v.regulatory_calendar(spark, sf))


# Lifecycle

HEALTH = "coalesce(used, 0) / NULLIF(baseline_credits_7d, 0)"


@query(
    "health_check",
    f"""SELECT warehouse_name, {r("CAST(date_diff('day', CAST(migrated_at AS DATE), DATE '2024-01-31') AS DOUBLE)", 'days_since_migration')},
               {r('baseline_credits_7d')}, {r('coalesce(used, 0)', 'current_credits_7d')},
               {r(f'round(({HEALTH} - 1) * 100, 1)', 'credit_change_pct')},
               CASE WHEN {HEALTH} > 1.5 THEN 'WARNING' WHEN {HEALTH} > 1.2 THEN 'REVIEW' ELSE 'HEALTHY' END AS status
        FROM latest_migration LEFT JOIN ({USED_7D}) USING (warehouse_name)""",
)
def health_check(spark, sf):
    return lifecycle.health_check(v.migration_log(spark, sf), v.metering(spark, sf), AS_OF)


ROLLBACK = f"""SELECT warehouse_name, baseline_credits_7d / 7 / 24 AS base, coalesce(used, 0) / 6 AS now_hourly,
                      (coalesce(used, 0) / 6 / NULLIF(baseline_credits_7d / 7 / 24, 0) - 1) * 100 AS change
               FROM latest_migration LEFT JOIN (SELECT warehouse_name, CAST(sum(credits_used) AS DOUBLE) AS used FROM metering
                    WHERE start_time >= {NOW} - INTERVAL 6 HOUR GROUP BY 1) USING (warehouse_name)"""
SHOWN = "CAST(CAST(round(change, 1) AS DECIMAL(28,1)) AS VARCHAR)"


@query(
    "conditional_rollback",
    f"""SELECT warehouse_name, {r('base', 'baseline_hourly')}, {r('now_hourly', 'current_hourly')},
               {r('round(change, 1)', 'credit_change_pct')}, CASE WHEN change > 50 THEN 'ROLLBACK' ELSE 'NO ACTION' END AS decision,
               CASE WHEN change > 50 THEN 'ROLLED BACK: Credits were ' || {SHOWN} || '% above baseline'
                    ELSE 'NO ACTION: Credits at ' || {SHOWN} || '% vs baseline (threshold: 50%)' END AS message
        FROM ({ROLLBACK})""",
)
def conditional_rollback(spark, sf):
    return lifecycle.conditional_rollback(v.migration_log(spark, sf), v.metering(spark, sf), AS_OF)


@query(
    "migrate_record",
    f"""SELECT warehouse_name, 'MIGRATE' AS action, 'STANDARD' AS previous_type, 'ADAPTIVE' AS new_type, 'admin' AS migrated_by,
               {NOW} AS migrated_at, {r('coalesce(used, 0)', 'baseline_credits_7d')},
               concat('Baseline: ', CAST(CAST(round(coalesce(used, 0), 2) AS DECIMAL(28,2)) AS VARCHAR), ' credits over 7 days') AS notes
        FROM inventory LEFT JOIN ({USED_7D}) USING (warehouse_name) WHERE warehouse_type = 'STANDARD'""",
)
def migrate_record(spark, sf):
    names = v.inventory(spark, sf).filter("warehouse_type = 'STANDARD'")
    return lifecycle.migrate_record(names, v.metering(spark, sf), AS_OF, by="admin")


@query(
    "rollback_record",
    f"""SELECT warehouse_name, 'ROLLBACK' AS action, 'ADAPTIVE' AS previous_type, 'STANDARD' AS new_type, 'admin' AS migrated_by,
               {NOW} AS migrated_at, CAST(NULL AS DOUBLE) AS baseline_credits_7d,
               'Auto-rollback: credits ' || {SHOWN} || '% above baseline' AS notes
        FROM ({ROLLBACK}) WHERE change > 50""",
)
def rollback_record(spark, sf):
    """The log rows that follow from the rollback decisions."""
    decided = conditional_rollback(spark, sf).filter("decision = 'ROLLBACK'").select(
        "warehouse_name",
        F.concat(
            F.lit("Auto-rollback: credits "), F.regexp_extract("message", r"(-?[0-9.]+% above baseline)", 1)
        ).alias("reason"),
    )
    return lifecycle.rollback_record(decided, AS_OF, by="admin")


@query(
    "migration_history",
    f"""SELECT warehouse_name, action, previous_type, new_type, previous_size, migrated_by, migrated_at, {r('baseline_credits_7d')}
        FROM migration_log""",
)
def migration_history(spark, sf):
    return lifecycle.migration_history(v.migration_log(spark, sf))


# Validation

MIGRATED = "warehouse_name IN (SELECT warehouse_name FROM migration_log WHERE action = 'MIGRATE')"
#: A wider look-back than the default six hours, because the events are sparse.
RECENT_HOURS = 240
RECENT = f"start_time >= {NOW} - INTERVAL {RECENT_HOURS} HOUR"


@query(
    "validate_type",
    f"""SELECT 'T1_WAREHOUSE_TYPE' AS test, warehouse_name, CASE WHEN warehouse_type = 'ADAPTIVE' THEN 'PASS' ELSE 'FAIL' END AS result,
               warehouse_type || ' (state: ' || state || ')' AS detail FROM inventory WHERE {MIGRATED}""",
)
def validate_type(spark, sf):
    return validation.validate_type(v.inventory(spark, sf), v.migration_log(spark, sf))


BAD_SHARE = "count(*) FILTER (WHERE execution_status <> 'SUCCESS') / count(*)"


@query(
    "validate_error_rate",
    f"""SELECT 'T2_ERROR_RATE' AS test, warehouse_name, CASE WHEN {BAD_SHARE} < 0.01 THEN 'PASS' ELSE 'FAIL' END AS result,
               CAST(CAST(round({BAD_SHARE} * 100, 2) AS DECIMAL(28,2)) AS VARCHAR) || '% error rate' AS detail
        FROM query_history WHERE {MIGRATED} AND {RECENT} GROUP BY warehouse_name""",
)
def validate_error_rate(spark, sf):
    return validation.validate_error_rate(queries_of(spark, sf), v.migration_log(spark, sf), AS_OF, RECENT_HOURS)


@query(
    "validate_queue",
    f"""SELECT 'T3_QUEUE_TIME' AS test, warehouse_name,
               CASE WHEN max(queued_overload_time) < 30000 THEN 'PASS' ELSE '{validation.WARN_QUEUE}' END AS result,
               CAST(CAST(round(max(queued_overload_time) / 1000, 1) AS DECIMAL(28,1)) AS VARCHAR) || 's max queue' AS detail
        FROM query_history WHERE {MIGRATED} AND {RECENT} GROUP BY warehouse_name""",
)
def validate_queue(spark, sf):
    return validation.validate_queue(queries_of(spark, sf), v.migration_log(spark, sf), AS_OF, RECENT_HOURS)


@query(
    "validate_credit_range",
    f"""SELECT 'T4_CREDIT_RANGE' AS test, warehouse_name,
               CASE WHEN coalesce(used, 0) <= baseline_credits_7d / 7 / 24 * 6 * 1.5 THEN 'PASS' ELSE 'WARN' END AS result,
               CAST(CAST(round(coalesce(used, 0), 2) AS DECIMAL(28,2)) AS VARCHAR) || ' credits (6h) vs ' ||
               CAST(CAST(round(baseline_credits_7d / 7 / 24 * 6, 2) AS DECIMAL(28,2)) AS VARCHAR) || ' baseline' AS detail
        FROM latest_migration LEFT JOIN (SELECT warehouse_name, CAST(sum(credits_used) AS DOUBLE) AS used FROM metering
             WHERE start_time >= {NOW} - INTERVAL 6 HOUR GROUP BY 1) USING (warehouse_name)""",
)
def validate_credit_range(spark, sf):
    return validation.validate_credit_range(v.migration_log(spark, sf), v.metering(spark, sf), AS_OF)


@query(
    "validate_adaptive_queries",
    f"""SELECT 'T5_ADAPTIVE_QUERIES' AS test, warehouse_name,
               CASE WHEN count(*) FILTER (WHERE warehouse_size = 'ADAPTIVE') > 0 THEN 'PASS' ELSE '{validation.WAITING}' END AS result,
               count(*) FILTER (WHERE warehouse_size = 'ADAPTIVE') || ' adaptive queries / ' || count(*) || ' total' AS detail
        FROM query_history WHERE {MIGRATED} AND {RECENT} GROUP BY warehouse_name""",
)
def validate_adaptive_queries(spark, sf):
    return validation.validate_adaptive_queries(queries_of(spark, sf), v.migration_log(spark, sf), AS_OF, RECENT_HOURS)


@query(
    "validate_log",
    """SELECT 'T6_MIGRATION_LOG' AS test, CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL - no migrations recorded' END AS result,
              count(*) || ' migration(s) recorded' AS detail FROM migration_log WHERE action = 'MIGRATE'""",
)
def validate_log(spark, sf):
    return validation.validate_log(v.migration_log(spark, sf))


def _checks(relation: str, rules: dict[str, str], need_rows: str | None = None) -> str:
    parts = [
        f"SELECT '{test}' AS test_id, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS result, count(*) AS violations "
        f"FROM {relation} WHERE {rule}"
        for test, rule in rules.items()
    ]
    if need_rows:
        parts.append(
            f"SELECT '{need_rows}', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM {relation}"
        )
    return " UNION ALL ".join(parts)


METERING_SQL_RULES = {
    "credits_non_negative": "credits < 0",
    "warehouse_not_null": "warehouse_name IS NULL",
    "time_range": f"NOT hour_ts BETWEEN {NOW} - INTERVAL 31 DAY AND {NOW}",
}


@query("invariant_checks", _checks("hm", METERING_SQL_RULES, "returns_data"))
def invariant_checks(spark, sf):
    hours = hm(spark, sf)
    return validation.invariant_checks(hours, validation.metering_rules(hours, AS_OF, DAYS), "returns_data")


@query("invariant_checks_performance", _checks("performance_comparison", validation.PERFORMANCE_RULES, "has_data"))
def invariant_checks_performance(spark, sf):
    return validation.invariant_checks(compared_performance(spark, sf), validation.PERFORMANCE_RULES, "has_data")


@query("invariant_checks_savings", _checks("daily_savings", validation.SAVINGS_RULES))
def invariant_checks_savings(spark, sf):
    return validation.invariant_checks(savings(spark, sf), validation.SAVINGS_RULES)


@query("invariant_checks_log", _checks("migration_log", validation.LOG_RULES))
def invariant_checks_log(spark, sf):
    return validation.invariant_checks(v.migration_log(spark, sf), validation.LOG_RULES)


@query("invariant_checks_scores", _checks(f"({SCORES})", validation.SCORE_RULES, "returns_data"))
def invariant_checks_scores(spark, sf):
    return validation.invariant_checks(assessment_scores(spark, sf), validation.SCORE_RULES, "returns_data")


@query("invariant_checks_inventory", _checks("inventory", validation.INVENTORY_RULES, "returns_data"))
def invariant_checks_inventory(spark, sf):
    return validation.invariant_checks(v.inventory(spark, sf), validation.INVENTORY_RULES, "returns_data")


@query(
    "invariant_checks_allocation",
    _checks(
        "(SELECT warehouse_name, sum(allocation_pct) AS allocated_pct FROM gl_code_mapping "
        "WHERE effective_to >= DATE '2024-01-31' GROUP BY 1)",
        validation.allocation_rules(),
    ),
)
def invariant_checks_allocation(spark, sf):
    active = v.gl_code_mapping(spark, sf).filter("effective_to >= DATE '2024-01-31'")
    return validation.invariant_checks(validation.allocation_totals(active), validation.allocation_rules())


@query(
    "state_by_type_check",
    """SELECT 'state_values' AS test_id, CASE WHEN count(*) = 0 THEN 'PASS'
                  ELSE 'WARN: some states unexpected (may have new state values)' END AS result, count(*) AS violations
       FROM inventory WHERE (warehouse_type = 'STANDARD' AND state NOT IN ('STARTED', 'SUSPENDED', 'RESIZING'))
                         OR (warehouse_type = 'ADAPTIVE' AND state NOT IN ('ENABLED', 'DISABLED'))""",
)
def state_by_type_check(spark, sf):
    return validation.state_by_type_check(v.inventory(spark, sf))


@query(
    "cross_view_consistency",
    """SELECT CASE WHEN a = b THEN 'PASS' ELSE 'WARN: different warehouse counts between views (may be due to query history latency)' END AS result,
              a AS warehouses_a, b AS warehouses_b
       FROM (SELECT (SELECT count(DISTINCT warehouse_name) FROM credit_comparison) AS a,
                    (SELECT count(DISTINCT warehouse_name) FROM performance_comparison) AS b)""",
)
def cross_view_consistency(spark, sf):
    return validation.cross_view_consistency(compared_credits(spark, sf), compared_performance(spark, sf))
