"""Score, band, scenario and status formulas on hand-computed constants."""

import pytest
from pyspark.sql import functions as F

from fleetmeter.functions import labels, measures, times
from fleetmeter.operators import assessment


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    "cv,active,queued,credits,expected",
    [
        (2.0, 1, 1000, 10000.0, 40 + (1 - 1 / 336) * 30 + 20 + 10),
        (0.0, 336, 0, 0.0, 0.0),
        (5.0, 336, 0, 0.0, 40.0),
        (0.0, 336, 33600, 0.0, 20.0),
        (0.0, 336, 0, 5000.0, 10.0),
        (0.5, 168, 84, 250.0, 20 + 15 + 2.5 + 2.5),
    ],
)
def test_score(spark, cv, active, queued, credits, expected):
    score = assessment.readiness_score(F.lit(cv), F.lit(active), F.lit(queued), F.lit(credits), 336)
    assert value(spark, score) == pytest.approx(expected)


def test_score_is_null_without_activity(spark):
    """No active hour leaves the queue part, and so the score, undefined; the SQL ``least`` would return the cap."""
    assert value(spark, assessment.readiness_score(F.lit(2.0), F.lit(0), F.lit(0), F.lit(1.0), 336)) is None
    assert value(spark, measures.capped(F.lit(None).cast("double"), 40)) is None


def test_idle_component_may_be_negative(spark):
    parts = assessment.score_components(F.lit(0.0), F.lit(337), F.lit(0), F.lit(0.0), 336)
    assert value(spark, parts[1]) == pytest.approx(-30 / 336)


@pytest.mark.parametrize(
    "score,band",
    [(100, "MIGRATE NOW"), (80, "MIGRATE NOW"), (79.99, "STRONG CANDIDATE"), (60, "STRONG CANDIDATE"),
     (45, "EVALUATE"), (40, "EVALUATE"), (39.9, "KEEP STANDARD"), (None, "KEEP STANDARD")],
)
def test_band(spark, score, band):
    assert value(spark, labels.recommendation_band(F.lit(score).cast("double"))) == band


@pytest.mark.parametrize("ratio,status", [(1.51, "WARNING"), (1.5, "REVIEW"), (1.2, "HEALTHY"), (None, "HEALTHY")])
def test_health(spark, ratio, status):
    assert value(spark, labels.health_status(F.lit(ratio).cast("double"))) == status


@pytest.mark.parametrize("priority,severity", [(1, "CRITICAL"), (2, "HIGH"), (3, "MEDIUM"), (4, "LOW"), (None, "LOW")])
def test_severity(spark, priority, severity):
    assert value(spark, labels.sla_severity(F.lit(priority).cast("int"))) == severity


@pytest.mark.parametrize(
    "utilization,name,factor",
    [(29.9, "Optimistic (35%)", 0.65), (30.0, "Moderate (25%)", 0.75), (60.0, "Conservative (15%)", 0.85)],
)
def test_scenario_default(spark, utilization, name, factor):
    assert value(spark, assessment.scenario_default(F.lit(utilization))) == name
    assert value(spark, assessment.default_factor(F.lit(utilization))) == factor


@pytest.mark.parametrize("text,multi", [("3", True), (" 2 ", True), ("1", False), ("n/a", False), (None, False), ("-3", False), ("", False)])
def test_multi_cluster(spark, text, multi):
    assert value(spark, labels.is_multi_cluster(F.lit(text).cast("string"))) is multi


def test_minutes_count_boundaries(spark):
    """23:59:59 to 00:00:01 crosses one minute boundary although two seconds pass."""
    start, end = F.lit("2024-01-01 23:59:59").cast("timestamp_ntz"), F.lit("2024-01-02 00:00:01").cast("timestamp_ntz")
    assert value(spark, times.minutes_between(start, end)) == 1


@pytest.mark.parametrize(
    "moment,expected",
    [("2024-01-06 12:00", "WEEKEND"), ("2024-01-07 12:00", "WEEKEND"), ("2024-01-08 09:00", "PEAK"),
     ("2024-01-08 17:59", "PEAK"), ("2024-01-08 18:00", "OFF_PEAK"), ("2024-01-08 08:59", "OFF_PEAK")],
)
def test_load_window(spark, moment, expected):
    assert value(spark, labels.load_window(F.lit(moment).cast("timestamp_ntz"))) == expected


@pytest.mark.parametrize(
    "tag,expected", [("my_agent_ml", "AGENT"), ("ml_scoring", "ML_BATCH"), ("ML", "OTHER"), (None, "OTHER")]
)
def test_first_rule_wins_and_like_is_case_sensitive(spark, tag, expected):
    from fleetmeter.operators.performance import WORKLOAD_RULES

    assert value(spark, labels.first_match(F.lit(tag).cast("string"), WORKLOAD_RULES, "OTHER")) == expected


def test_rounding_ignores_summation_noise(spark):
    assert value(spark, measures.rounded(F.lit(129.825 - 2e-14), 2)) == 129.83
    assert value(spark, measures.rounded_even(F.lit(0.125), 2)) == 0.12
