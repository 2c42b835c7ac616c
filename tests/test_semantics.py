"""Hand-written unit tables for the semantics that are easy to get wrong."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fleetmeter.operators import anomaly, assessment, comparison, cost, governance, lifecycle, performance, rollups, sla, validation
from fleetmeter.sources import readers, seeds

M = "warehouse_name STRING, start_time TIMESTAMP_NTZ, credits_used DECIMAL(18,2)"
HM = "warehouse_name STRING, hour_ts TIMESTAMP_NTZ, credits DOUBLE"
LOG = "warehouse_name STRING, action STRING, migrated_at TIMESTAMP_NTZ, baseline_credits_7d DOUBLE"
Q = (
    "query_id STRING, warehouse_name STRING, warehouse_size STRING, query_tag STRING, start_time TIMESTAMP_NTZ, "
    "end_time TIMESTAMP_NTZ, execution_status STRING, total_elapsed_time BIGINT, queued_overload_time BIGINT"
)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def days(frame, values, start=1, name="W", month="2024-01"):
    return frame([(name, f"{month}-{start + i:02d} 05:00:00", float(v)) for i, v in enumerate(values)], HM)


def D(text):
    from decimal import Decimal

    return Decimal(text)


# Anomalies


def test_anomaly_needs_three_previous_days(frame):
    assert anomaly.credit_anomalies(days(frame, [10, 10, 100], 8)).count() == 0
    assert rows(anomaly.credit_anomalies(days(frame, [10, 10, 10, 100], 8)), "anomaly_type") == [("SPIKE",)]


def test_anomaly_window_is_the_seven_previous_observed_days(frame):
    """The first day (1000) is outside the window of the ninth, and missing days do not count."""
    hm = frame(
        [("W", f"2024-01-{d:02d} 00:00:00", c) for d, c in
         [(1, 1000.0), (2, 10.0), (3, 10.0), (4, 10.0), (5, 10.0), (9, 10.0), (10, 10.0), (11, 10.0), (16, 21.0)]], HM)
    found = anomaly.credit_anomalies(hm).filter("day_ts = '2024-01-16 00:00:00'").first()
    assert (found.anomaly_type, found.expected_credits) == ("SPIKE", 10.0)


def test_anomaly_threshold_is_strict_and_zero_deviation_gives_zero_score(frame):
    assert anomaly.credit_anomalies(days(frame, [10, 10, 10, 20], 8)).count() == 0
    assert rows(anomaly.credit_anomalies(days(frame, [10, 10, 10, 30], 8)), "z_score") == [(0.0,)]


def test_drop_is_ignored_on_weekends_and_for_tiny_means(frame):
    assert anomaly.credit_anomalies(days(frame, [10, 10, 10, 1], 3)).count() == 0  # 2024-01-06 is a Saturday
    assert rows(anomaly.credit_anomalies(days(frame, [10, 10, 10, 1], 8)), "anomaly_type") == [("DROP",)]
    assert anomaly.credit_anomalies(days(frame, [1, 1, 1, 0.1], 8)).count() == 0


@pytest.mark.parametrize("start,kind", [(24, "SPIKE"), (25, "EXPECTED_BATCH"), (26, "EXPECTED_BATCH")])
def test_month_end_is_the_last_two_days_of_a_leap_february(frame, start, kind):
    found = anomaly.credit_anomalies(days(frame, [10, 10, 10, 50], start, month="2024-02"))
    assert rows(found, "anomaly_type", "is_quarter_end") == [(kind, False)]


def test_labels_do_not_depend_on_row_order(frame):
    values = [3, 9, 4, 40, 2, 7, 7, 1, 90, 5]
    a = anomaly.credit_anomalies(days(frame, values, 3))
    shuffled = days(frame, values, 3).orderBy(F.desc("credits")).repartition(3)
    assert rows(a, "day_ts", "anomaly_type") == rows(anomaly.credit_anomalies(shuffled), "day_ts", "anomaly_type")


def test_calendar_suppresses_listed_and_all(frame):
    hm = days(frame, [10, 10, 10, 50], 8, "A").unionByName(days(frame, [10, 10, 10, 50], 8, "B"))
    found = anomaly.credit_anomalies(hm)
    ddl = "event_name STRING, event_type STRING, start_date DATE, end_date DATE, affected_warehouses STRING, suppress_anomaly BOOLEAN"
    listed = frame([("x", "AUDIT_WINDOW", "2024-01-11", "2024-01-11", "Z, A", True)], ddl)
    everyone = frame([("x", "AUDIT_WINDOW", "2023-01-01", "2024-12-31", "ALL", True)], ddl)
    marked_only = frame([("x", "AUDIT_WINDOW", "2024-01-11", "2024-01-11", "ALL", False)], ddl)
    assert rows(anomaly.calendar_suppression(found, listed), "warehouse_name", "suppressed") == [("A", True), ("B", False)]
    assert rows(anomaly.calendar_suppression(found, listed, drop=True), "warehouse_name") == [("B",)]
    assert anomaly.calendar_suppression(found, everyone, drop=True).count() == 0
    assert anomaly.calendar_suppression(found, marked_only, drop=True).count() == 2


def test_calendar_suppresses_anomalies_of_any_age(frame):
    """Windows over several months, and anomalies of ninety days and more ago."""
    ddl = "event_name STRING, event_type STRING, start_date DATE, end_date DATE, affected_warehouses STRING, suppress_anomaly BOOLEAN"
    calendar = frame(
        [("q", "AUDIT_WINDOW", "2023-11-01", "2024-01-31", "ALL", True), ("y", "AUDIT_WINDOW", "2019-05-31", "2019-06-01", "B", True)], ddl)
    found = frame(
        [("A", "2023-10-31 00:00:00"), ("A", "2023-11-15 00:00:00"), ("A", "2024-01-31 00:00:00"), ("A", "2024-02-01 00:00:00"),
         ("B", "2019-06-01 00:00:00"), ("A", "2019-06-01 00:00:00"), (None, "2023-12-01 00:00:00")], "warehouse_name STRING, day_ts TIMESTAMP_NTZ")
    marked = anomaly.calendar_suppression(found, calendar)
    got = sorted((str(r.day_ts)[:10], str(r.warehouse_name), r.suppressed) for r in marked.collect())
    assert got == [
        ("2019-06-01", "A", False), ("2019-06-01", "B", True), ("2023-10-31", "A", False), ("2023-11-15", "A", True),
        ("2023-12-01", "None", True), ("2024-01-31", "A", True), ("2024-02-01", "A", False),
    ]


# Lifecycle


def test_latest_migration_wins_and_rollback_can_exclude(frame):
    log = frame(
        [("A", "MIGRATE", "2024-01-01 00:00:00", 7.0), ("A", "MIGRATE", "2024-01-05 00:00:00", 14.0),
         ("A", "ROLLBACK", "2024-01-06 00:00:00", None), ("B", "ROLLBACK", "2024-01-02 00:00:00", None)], LOG)
    assert rows(lifecycle.latest_migrations(log), "warehouse_name", "baseline_credits_7d") == [("A", 14.0)]
    assert lifecycle.latest_migrations(log, exclude_rolled_back=True).count() == 0


def test_alert_does_not_double_with_two_migrations(frame):
    log = frame([("A", "MIGRATE", f"2024-01-0{d} 00:00:00", 168.0) for d in (1, 2)], LOG)
    spend = frame([("A", "2024-01-10 10:30:00", D("5.00"))], M)
    assert anomaly.credit_spike_alert(log, spend, "2024-01-10 12:00:00").count() == 0
    more = frame([("A", "2024-01-10 10:30:00", D("6.01"))], M)
    assert rows(anomaly.credit_spike_alert(log, more, "2024-01-10 12:00:00"), "recent_credits", "alert_threshold") == [(6.01, 6.0)]


@pytest.mark.parametrize(
    "spent,threshold,decision",
    [("9.00", 50.0, "NO ACTION"), ("9.01", 50.0, "ROLLBACK"), (None, -100.0, "NO ACTION"), ("0.01", -100.0, "ROLLBACK")],
)
def test_rollback_threshold_is_strict(frame, spent, threshold, decision):
    log = frame([("A", "MIGRATE", "2024-01-01 00:00:00", 168.0)], LOG)
    spend = frame([] if spent is None else [("A", "2024-01-10 11:00:00", D(spent))], M)
    got = lifecycle.conditional_rollback(log, spend, "2024-01-10 12:00:00", threshold, 6).first()
    assert got.decision == decision


def test_zero_baseline_means_no_action_and_healthy(frame):
    log = frame([("A", "MIGRATE", "2024-01-01 00:00:00", 0.0)], LOG)
    spend = frame([("A", "2024-01-10 11:00:00", D("9.99"))], M)
    got = lifecycle.conditional_rollback(log, spend, "2024-01-10 12:00:00").first()
    assert (got.decision, got.credit_change_pct, got.message) == ("NO ACTION", None, None)
    assert lifecycle.health_check(log, spend, "2024-01-10 12:00:00").first().status == "HEALTHY"


def test_days_since_migration_counts_dates(frame):
    log = frame([("A", "MIGRATE", "2024-01-09 23:59:00", 10.0)], LOG)
    got = lifecycle.health_check(log, frame([], M), "2024-01-10 00:01:00").first()
    assert (got.days_since_migration, got.current_credits_7d, got.status) == (1.0, 0.0, "HEALTHY")


def test_records_carry_defaults(frame):
    names = frame([("A",), ("B",)], "warehouse_name STRING")
    spend = frame([("A", "2024-01-09 11:00:00", D("3.50")), ("A", "2024-01-01 11:00:00", D("9.00"))], M)
    assert rows(lifecycle.migrate_record(names, spend, "2024-01-10 12:00:00"), "warehouse_name", "baseline_credits_7d", "notes") == [
        ("A", 3.5, "Baseline: 3.50 credits over 7 days"), ("B", 0.0, "Baseline: 0.00 credits over 7 days")]
    assert rows(lifecycle.rollback_record(names, "2024-01-10"), "notes")[0] == ("Manual rollback requested",)


# Before / after


def test_change_inside_an_hour_gives_two_rows(frame):
    log = frame([("A", "MIGRATE", "2024-01-16 00:30:00", 1.0)], LOG)
    spend = frame([("A", "2024-01-16 00:10:00", D("1.00")), ("A", "2024-01-16 00:30:00", D("2.00")),
                   ("A", "2024-01-02 00:29:59", D("50.00"))], M)
    assert rows(comparison.credit_comparison(spend, log), "period", "credits") == [("POST", 2.0), ("PRE", 1.0)]


def test_row_at_conversion_counts_on_both_sides(frame):
    events = frame([("A", "2024-01-10 00:00:00", "CONVERT_WAREHOUSE", "CONVERT_TO_ADAPTIVE")],
                   "warehouse_name STRING, timestamp TIMESTAMP_NTZ, event_name STRING, event_reason STRING")
    spend = frame([("A", "2024-01-09 00:00:00", D("10.00")), ("A", "2024-01-10 00:00:00", D("4.00"))], M)
    got = comparison.before_after(spend, events).first()
    assert (got.pre_credits_30d, got.post_credits_30d, got.pre_daily_avg, got.post_daily_avg, got.savings_pct) == (14.0, 4.0, 7.0, 4.0, 71.4)


def test_no_usage_after_conversion(frame):
    events = frame([("A", "2024-01-10 00:00:00", "CONVERT_WAREHOUSE", "CONVERT_TO_ADAPTIVE")],
                   "warehouse_name STRING, timestamp TIMESTAMP_NTZ, event_name STRING, event_reason STRING")
    got = comparison.before_after(frame([("A", "2024-01-09 00:00:00", D("10.00"))], M), events).first()
    assert (got.post_credits_30d, got.post_daily_avg, got.savings_pct) == (0.0, None, 100.0)


# Cost


def test_two_tags_do_not_double_credits(frame):
    spend = frame([("A", "2024-01-10 00:00:00", D("2.00"))], M)
    tags = frame([("A", "WAREHOUSE", "COST_CENTER", "X"), ("A", "WAREHOUSE", "COST_CENTER", "Y"),
                  ("A", "WAREHOUSE", "OTHER", "Z")], "object_name STRING, domain STRING, tag_name STRING, tag_value STRING")
    as_of = "2024-01-11 00:00:00"
    assert rows(rollups.tagged_hourly_metering(spend, tags, as_of), "credits", "tag_cost_center") == [(2.0, "Y")]
    assert rows(cost.tag_attribution(spend, tags, as_of), "cost_center", "total_credits", "estimated_cost_usd") == [("Y", 2.0, 6.0)]
    each = cost.tag_attribution(spend, tags.unionByName(tags.limit(1)), as_of, every_tag=True)
    assert rows(each, "cost_center", "total_credits") == [("X", 4.0), ("Y", 2.0)]
    old = tags.withColumnRenamed("domain", "object_type")
    assert rows(cost.tag_attribution(spend, old, as_of), "cost_center") == [("Y",)]


def test_credit_price_fallbacks(frame):
    rate_ddl = "date DATE, service_type STRING, usage_type STRING, effective_rate DOUBLE"
    money_ddl = "usage_date DATE, usage_type STRING, usage DOUBLE, usage_in_currency DOUBLE"
    rates = frame([("2024-01-09", "WAREHOUSE_METERING", "compute", 0.0), ("2024-01-08", "WAREHOUSE_METERING", "compute", 2.5),
                   ("2024-01-07", "WAREHOUSE_METERING", "compute", 9.0), ("2024-01-09", "STORAGE", "compute", 7.0)], rate_ddl)
    money = frame([("2024-01-09", "compute", 3.0, 10.0), ("2023-01-09", "compute", 1.0, 90.0)], money_ddl)
    no_rates, no_money = frame([], rate_ddl), frame([], money_ddl)

    def price(a, b):
        return cost.credit_price(a, b, "2024-01-10 00:00:00").first()[0]

    assert price(rates, money) == 2.5
    assert price(no_rates, money) == 3.33
    assert price(no_rates, no_money) == 3.0


def test_failed_queries_do_not_make_an_hour_active(frame):
    hm = frame([("A", "2024-01-10 00:00:00", 2.0), ("A", "2024-01-10 01:00:00", 3.0)], HM)
    hq = frame([("A", "2024-01-10 00:00:00", 0)], "warehouse_name STRING, hour_ts TIMESTAMP_NTZ, query_count BIGINT")
    assert rows(cost.idle_waste(hm, hq), "total_credits", "idle_credits", "total_hours", "idle_hours") == [(5.0, 5.0, 2, 2)]


def test_chargeback_defaults_and_lost_remainder(frame):
    totals = frame([("A", 100.0), ("B", 10.0)], "warehouse_name STRING, total_credits DOUBLE")
    gl = frame([("A", "41", "L1", 50.0)], "warehouse_name STRING, gl_code STRING, business_line STRING, allocation_pct DOUBLE")
    assert rows(cost.gl_chargeback(totals, gl, 2.0), "gl_code", "business_line", "allocated_credits", "allocated_cost") == [
        ("41", "L1", 50.0, 100.0), ("UNALLOCATED", "Unassigned", 10.0, 20.0)]
    checked = validation.invariant_checks(validation.allocation_totals(gl), validation.allocation_rules())
    assert rows(checked, "result", "violations") == [("FAIL", 1)]


# Performance and SLA


def q(i, wh, start, elapsed, queued=0, status="SUCCESS", size="Medium", tag=None, end=None):
    return (f"q{i}", wh, size, tag, start, end or start, status, elapsed, queued)


def test_query_crossing_midnight_lands_on_its_end_date(frame):
    rows_ = [q(1, "A", "2024-01-09 23:59:00", 1000, end="2024-01-10 00:01:00")]
    queries = frame(rows_, Q).withColumn("execution_time", F.lit(1)).withColumn("queued_provisioning_time", F.lit(1))
    assert rows(performance.performance_by_pool_type(queries, "2024-01-10 12:00:00"), "query_date") == [(date(2024, 1, 10),)]


@pytest.mark.parametrize("values", [[7], [1, 2], [5, 5, 5, 5], list(range(0, 5000, 37)), [999, 1000, 1001, 1000000], [3] * 50 + [10] * 2])
def test_percentile_of_large_groups_is_exact(frame, values):
    import numpy as np

    from fleetmeter.functions.quantiles import percentile_of_large_groups

    df = frame([("g", v) for v in values] + [("g", None), ("empty", None)], "k STRING, v BIGINT")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = dict(percentile_of_large_groups(df, ["k"], "v", p, "p", {"n": F.count(F.lit(1))}, 100).select("k", "p").collect())
        assert got["g"] == pytest.approx(np.percentile(values, p * 100))
        assert got["empty"] is None
    counted = percentile_of_large_groups(df, ["k"], "v", 0.5, "p", {"n": F.count(F.lit(1))}, 100)
    assert rows(counted, "k", "n") == [("empty", 1), ("g", len(values) + 1)]


def test_exact_and_sketch_percentiles_agree_roughly(frame):
    queries = frame([q(i, "A", "2024-01-09 10:00:00", 1000 + i) for i in range(1000)], Q)
    exact = performance.latency_by_pool_type(queries, "2024-01-10 00:00:00").first()
    sketch = performance.latency_by_pool_type(queries, "2024-01-10 00:00:00", exact=False).first()
    assert exact.p95_latency_sec == pytest.approx(sketch.p95_latency_sec, abs=0.01)
    assert (exact.total_queries, exact.avg_latency_sec) == (sketch.total_queries, sketch.avg_latency_sec)


def test_sla_lookback_is_not_hour_aligned(frame):
    queries = frame([q(1, "X_TRADING_1", "2024-01-10 09:59:00", 9000), q(2, "X_TRADING_1", "2024-01-10 10:05:00", 9000),
                     q(3, "X_TRADING_1", "2024-01-10 11:00:00", 2000)], Q)
    found = sla.sla_latency_breaches(queries, seeds.workload_sla(queries.sparkSession), "2024-01-10 12:00:00")
    assert rows(found, "breach_window", "actual_value") == [(datetime(2024, 1, 10, 10), 9.0)]


def test_sla_warehouse_matching_two_classes_breaches_twice(frame):
    queries = frame([q(1, "TRADING_RISK", "2024-01-10 11:30:00", 40000)], Q)
    found = sla.sla_latency_breaches(queries, seeds.workload_sla(queries.sparkSession), "2024-01-10 12:00:00")
    assert rows(found, "workload_class", "severity") == [("REAL_TIME_TRADING", "CRITICAL"), ("RISK_CALCULATION", "CRITICAL")]


def test_sla_queue_counts_only_queued_queries_of_any_status(frame):
    queries = frame([q(1, "TRADING", "2024-01-10 11:30:00", 1, 600, "FAIL"), q(2, "TRADING", "2024-01-10 11:31:00", 1, 0)], Q)
    found = sla.sla_queue_breaches(queries, seeds.workload_sla(queries.sparkSession), "2024-01-10 12:00:00")
    assert rows(found, "actual_value", "sla_threshold") == [(0.6, 0.5)]


def test_inactive_sla_is_ignored(frame):
    queries = frame([q(1, "TRADING", "2024-01-10 11:30:00", 99000)], Q)
    off = seeds.workload_sla(queries.sparkSession).withColumn("is_active", F.lit(False))
    assert sla.sla_latency_breaches(queries, off, "2024-01-10 12:00:00").count() == 0


# Assessment


def test_pool_without_usage_or_with_one_hour_stays(frame):
    inventory = frame([("NONE", "STANDARD", "Small"), ("ONE", "STANDARD", "Small"), ("DONE", "ADAPTIVE", "Small")],
                      "warehouse_name STRING, warehouse_type STRING, warehouse_size STRING")
    spend = frame([("ONE", "2024-01-10 00:00:00", D("500.00"))], M)
    got = assessment.assessment_sql(inventory, spend, frame([], Q), "2024-01-11 00:00:00")
    assert rows(got, "warehouse_name", "adaptive_score", "recommendation") == [
        ("NONE", None, "KEEP STANDARD"), ("ONE", None, "KEEP STANDARD")]


def test_dashboard_score_excludes_and_fills(frame):
    hm = frame([(w, "2024-01-10 00:00:00", 5.0) for w in ("A", "BIG", "DONE")], HM)
    hq = frame([], "warehouse_name STRING, hour_ts TIMESTAMP_NTZ, query_count BIGINT, queued_queries BIGINT, complex_queries BIGINT, latency_stddev DOUBLE")
    inventory = frame([("A", "STANDARD", "Small"), ("BIG", "STANDARD", "6X-Large"), ("DONE", "ADAPTIVE", "Small")],
                      "warehouse_name STRING, warehouse_type STRING, warehouse_size STRING")
    got = assessment.assessment_scores(hm, hq, 14, inventory)
    assert rows(got, "warehouse_name", "variability", "queued_queries", "latency_stddev") == [("A", 0.0, 0, 0.0)]


def test_scenario_without_query_telemetry_assumes_idle_share(frame):
    hm = frame([("A", f"2024-01-10 {h:02d}:00:00", 10.0) for h in range(10)], HM)
    hq = frame([], "warehouse_name STRING, hour_ts TIMESTAMP_NTZ, query_count BIGINT, avg_elapsed_ms DOUBLE, queued_queries BIGINT")
    inventory = frame([("A", "STANDARD", "Small", "3")], "warehouse_name STRING, warehouse_type STRING, warehouse_size STRING, max_clusters STRING")
    got = {r.scenario: r for r in assessment.scenario_projection(hm, hq, inventory, "2024-01-11 00:00:00", 1).collect()}
    # active 70, overhead 70 * 0.1 * 2 = 14
    assert got["Conservative (15%)"].projected_credits == pytest.approx(70 * 0.85 - 14)
    assert got["Moderate (25%)"].is_default and not got["Optimistic (35%)"].is_default


def test_recent_hours_are_not_idle(frame):
    hm = frame([("A", "2024-01-10 21:00:00", 10.0), ("A", "2024-01-10 22:00:00", 10.0)], HM)
    hq = frame([("A", "2024-01-10 01:00:00", 1, 5.0, 0)], "warehouse_name STRING, hour_ts TIMESTAMP_NTZ, query_count BIGINT, avg_elapsed_ms DOUBLE, queued_queries BIGINT")
    inventory = frame([("A", "STANDARD", "Small", "1")], "warehouse_name STRING, warehouse_type STRING, warehouse_size STRING, max_clusters STRING")
    stats = assessment.scenario_stats(hm, hq, inventory, "2024-01-11 00:00:00", 1).first()
    assert (stats.idle_credits, stats.active_credits) == (10.0, 10.0)


def test_bulk_plan_matches_whole_names(frame):
    inventory = frame([("ANALYTICS_1", "STANDARD", "S", "", ""), ("MY_ANALYTICS_1", "STANDARD", "S", "", ""), ("ANALYTICS_2", "ADAPTIVE", "S", "", "")],
                      "warehouse_name STRING, warehouse_type STRING, warehouse_size STRING, max_query_perf_level STRING, throughput_multiplier STRING")
    plan = assessment.bulk_plan(inventory, {"WAREHOUSE_TYPE": "STANDARD", "name": "ANALYTICS_.*"})
    assert rows(plan, "row_kind", "total_warehouses", "mode", "name") == [("SUMMARY", 1, "dry-run", None), ("WAREHOUSE", None, None, "ANALYTICS_1")]
    nothing = assessment.bulk_plan(inventory, {"name": "NONEXISTENT_WH_XYZ_.*"})
    assert rows(nothing, "row_kind", "total_warehouses") == [("SUMMARY", 0)]


# Governance


def test_regions(frame, spark):
    accounts = frame([("a", "AWS_US_WEST_2"), ("b", "AZURE_WESTEUROPE"), ("c", "AWS_SA_EAST_1"), ("d", "UNKNOWN"), ("e", "GCP")],
                     "account STRING, region STRING")
    got = governance.region_support(accounts, seeds.region_support(spark))
    assert rows(got, "account", "status") == [("a", "GA"), ("b", "GA"), ("c", "UNAVAILABLE"), ("d", "UNAVAILABLE"), ("e", "GA")]
    strict = governance.region_support(accounts, seeds.region_support(spark), empty_matches=False)
    assert dict(strict.select("account", "status").collect())["e"] == "UNAVAILABLE"
    assert governance.region_matrix(spark).count() == 18


def test_transitions_flag_illegal_moves_across_hours(frame):
    requests = frame([(r, "W", "2024-01-01 00:00:00", "u") for r in ("ok", "bad", "new")],
                     "request_id STRING, warehouse_name STRING, created_at TIMESTAMP_NTZ, requested_by STRING")
    ddl = "request_id STRING, event_id BIGINT, event_time TIMESTAMP_NTZ, status STRING, actor STRING, notes STRING"
    events = frame([("ok", 1, "2024-01-01 01:00:00", "APPROVED", "m", "n"), ("ok", 2, "2024-01-03 01:00:00", "EXECUTED", "o", None),
                    ("ok", 3, "2024-01-03 01:10:00", "ROLLED_BACK", "o", None),
                    ("bad", 1, "2024-01-01 01:00:00", "EXECUTED", "o", None), ("bad", 2, "2024-01-01 01:00:01", "APPROVED", "m", "late")], ddl)
    got = governance.request_transitions(requests, events)
    assert rows(got, "request_id", "status", "illegal_moves") == [("bad", "APPROVED", 2), ("new", "PENDING", 0), ("ok", "ROLLED_BACK", 0)]
    assert rows(got, "request_id", "review_notes")[0] == ("bad", "late")


def test_audit_detail_from_variant_or_text(frame):
    audit = frame([("a1", "2024-01-01 00:00:00", "u", "r", "VIEW", '{"section": "audit_log"}', "W")],
                  "event_id STRING, event_timestamp TIMESTAMP_NTZ, username STRING, role_name STRING, event_type STRING, event_detail STRING, warehouse_name STRING")
    assert rows(governance.audit_recent(audit), "detail") == [("audit_log",)]
    assert rows(governance.audit_recent(audit.withColumn("event_detail", F.parse_json("event_detail"))), "detail") == [("audit_log",)]


# Readers


def test_warehouse_filter(frame):
    df = frame([("A", 1), ("B", 2), ("C", 3)], "warehouse_name STRING, x INT")
    names = frame([("A",), ("Z",)], "warehouse_name STRING")
    assert rows(readers.warehouse_filter(df, ["A", "B"], ["A"]), "x") == [(1,)]
    assert readers.warehouse_filter(df, []).count() == 3
    assert readers.warehouse_filter(df, ["Q"], ["A"]).count() == 3
    assert rows(readers.warehouse_filter(df, ["A", "B"], names), "x") == [(1,)]
    assert rows(readers.warehouse_filter(df, names, df), "x") == [(1,)]


def test_inventory_keeps_what_arrives(frame):
    raw = frame([("A", "STANDARD", "x")], "name STRING, type STRING, owner STRING")
    assert readers.inventory_normalise(raw).columns == ["warehouse_name", "warehouse_type"]


def test_conform_names_missing_columns(frame):
    from fleetmeter.sources.schemas import METERING_HISTORY

    with pytest.raises(ValueError, match="credits_used"):
        readers.conform(frame([("A", "2024-01-01")], "warehouse_name STRING, start_time STRING"), METERING_HISTORY)


def test_resolver_prefers_staged_and_tolerates_missing(frame, spark, tmp_path):
    from fleetmeter.sources.schemas import HOURLY_EVENTS

    hm = frame([("A", "2024-01-10 00:00:00", 2.0)], HM)
    hm.createOrReplaceTempView("staged_hourly")
    assert readers.resolve_source(spark, "staged_hourly", lambda: None, lambda df: df.filter("credits > 1")).count() == 1
    missing = readers.resolve_source(spark, "no_such_table", lambda: spark.read.parquet(str(tmp_path / "none")), when_missing=HOURLY_EVENTS)
    assert missing.count() == 0 and missing.columns == HOURLY_EVENTS.names


def test_empty_inputs_give_empty_reports(frame):
    hm = frame([], HM)
    assert anomaly.credit_anomalies(hm).count() == 0
    assert cost.credit_totals(hm).count() == 0
    assert rollups.hourly_metering(frame([], M), "2024-01-31").count() == 0
    assert validation.validate_log(frame([], LOG)).first().result == "FAIL - no migrations recorded"


def test_validation_results(frame):
    log = frame([("A", "MIGRATE", "2024-01-01 00:00:00", 168.0)], LOG)
    queries = frame([q(1, "A", "2024-01-10 11:00:00", 5, 40000), q(2, "A", "2024-01-10 11:00:00", 5, 0, "FAIL", "ADAPTIVE"),
                     q(3, "B", "2024-01-10 11:00:00", 5)], Q)
    now = "2024-01-10 12:00:00"
    assert rows(validation.validate_error_rate(queries, log, now), "warehouse_name", "result", "detail") == [("A", "FAIL", "50.00% error rate")]
    assert validation.validate_queue(queries, log, now).first().result.startswith("WARN")
    assert validation.validate_adaptive_queries(queries, log, now).first().detail == "1 adaptive queries / 2 total"
    spend = frame([("A", "2024-01-10 11:00:00", D("9.00"))], M)
    assert validation.validate_credit_range(log, spend, now).first().detail == "9.00 credits (6h) vs 6.00 baseline"
    assert validation.validate_credit_range(log, spend, now).first().result == "PASS"


def test_odd_state_warns(frame):
    inventory = frame([("A", "STANDARD", "ENABLED"), ("B", "ADAPTIVE", "ENABLED")], "warehouse_name STRING, warehouse_type STRING, state STRING")
    got = validation.state_by_type_check(inventory).first()
    assert got.result.startswith("WARN") and got.violations == 1
