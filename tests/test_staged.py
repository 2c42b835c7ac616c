"""Before/after reports from stored hours: equal to the raw reports, and raw rows matter only where an hour is cut."""

from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fleetmeter.functions.hours import OPEN, cover
from fleetmeter.operators import anomaly, comparison
from fleetmeter.plans import views
from fleetmeter.sources import store

METERING = "warehouse_name STRING, start_time TIMESTAMP_NTZ, credits_used DECIMAL(18,2)"
QUERIES = "warehouse_name STRING, start_time TIMESTAMP_NTZ, execution_status STRING, total_elapsed_time BIGINT, queued_overload_time BIGINT, warehouse_size STRING"
LOG = "warehouse_name STRING, action STRING, migrated_at TIMESTAMP_NTZ"
EVENTS = "warehouse_name STRING, event_name STRING, event_reason STRING, timestamp TIMESTAMP_NTZ"
START, NOW = datetime(2024, 1, 1), datetime(2024, 1, 25, 9, 30)
#: Inside an hour, on a full hour, and never stored.
CHANGES = {"A": datetime(2024, 1, 15, 10, 20), "B": datetime(2024, 1, 17, 6), "C": datetime(2024, 1, 16, 23, 59, 59)}


def times():
    at = START
    while at < NOW:
        yield at
        at += timedelta(minutes=20)


@pytest.fixture
def metering(frame):
    rows = [(w, str(t), D(1 + (t.hour + t.minute) % 7) / 100) for w in CHANGES if w != "C" for t in times()]
    return frame(rows, METERING)


@pytest.fixture
def queries(frame):
    rows = [
        (w, str(t), "FAIL" if t.minute == 40 and t.hour % 3 == 0 else "SUCCESS", 1000 + 37 * (t.hour + t.day), t.minute, "Small")
        for w in CHANGES if w != "C" for t in times()
    ]
    return frame(rows, QUERIES)


@pytest.fixture
def log(frame):
    return frame([(w, "MIGRATE", str(t)) for w, t in CHANGES.items()], LOG)


@pytest.fixture
def events(frame):
    return frame([(w, "CONVERT_WAREHOUSE", "CONVERT_TO_ADAPTIVE", str(t)) for w, t in CHANGES.items()], EVENTS)


def deploy(spark, tmp_path, table, source):
    path = str(tmp_path / table.name)
    store.refresh(spark, path, table, source, NOW)
    return store.load(spark, path, table)


def plain(df):
    names = sorted(df.columns)
    return sorted(tuple(str(round(r[n], 6) if isinstance(r[n], float) else r[n]) for n in names) for r in df.collect())


def spoiled(facts, days, column):
    """``column`` made wrong wherever a stored hour has to stand in: no change, no end of a window, not open."""
    cut = [str(t + d)[:13] for t in CHANGES.values() for d in (timedelta(0), timedelta(days=-days), timedelta(days=days))]
    kept = F.substring(F.col("start_time").cast("string"), 1, 13).isin(cut)
    newest = (NOW - timedelta(minutes=10)).replace(minute=0) - OPEN
    kept = kept | (F.col("start_time") >= F.lit(str(newest)).cast("timestamp_ntz"))
    return facts.withColumn(column, F.when(kept, F.col(column)).otherwise(F.lit(77_777)).cast(facts.schema[column].dataType))


def test_credits(spark, tmp_path, metering, log, events):
    stored = deploy(spark, tmp_path, store.METERING, metering)
    want = plain(comparison.credit_comparison(metering, log, 7))
    assert len(want) > 500
    assert plain(comparison.credit_comparison(spoiled(metering, 7, "credits_used"), log, 7, stored)) == want
    want = plain(comparison.before_after(metering, events, 5))
    assert len(want) == 2
    assert plain(comparison.before_after(spoiled(metering, 5, "credits_used"), events, 5, stored)) == want
    savings = [plain(comparison.daily_savings(comparison.credit_comparison(metering, log, 7, s))) for s in (None, stored)]
    assert savings[0] == savings[1] and savings[0]


def test_latency(spark, tmp_path, queries, log):
    stored = deploy(spark, tmp_path, store.QUERIES, queries)
    spoilt = spoiled(queries, 7, "total_elapsed_time")
    want = plain(comparison.performance_comparison(queries, log, 7))
    assert plain(comparison.performance_comparison(spoilt, log, 7, stored)) == want and len(want) > 500
    for share in (-50.0, 25.0):
        wants, got = (
            plain(anomaly.latency_regression_alert(q, log, NOW, 6, share, s))
            for q, s in ((queries, None), (spoiled(queries, 14, "total_elapsed_time"), stored))
        )
        assert wants == got and len(wants) == (2 if share < 0 else 0)


def test_tables_that_hold_less_than_the_report_asks_for(spark, tmp_path, metering, queries, log, events, frame):
    """Hours from before the first stored one are read raw; an empty table leaves everything to the raw rows."""
    late = metering.filter("start_time >= '2024-01-12 05:00:00'")
    for stored in (deploy(spark, tmp_path / "late", store.METERING, late), deploy(spark, tmp_path / "none", store.METERING, metering.limit(0))):
        assert plain(comparison.credit_comparison(metering, log, 7, stored)) == plain(comparison.credit_comparison(metering, log, 7))
        assert plain(comparison.before_after(metering, events, 9, stored)) == plain(comparison.before_after(metering, events, 9))
    stored = deploy(spark, tmp_path, store.QUERIES, queries)
    assert comparison.performance_comparison(queries, frame([], LOG), stored=stored).count() == 0
    assert anomaly.latency_regression_alert(queries, frame([], LOG), NOW, stored=stored).count() == 0
    assert comparison.before_after(metering, frame([], EVENTS), stored=deploy(spark, tmp_path, store.METERING, metering)).count() == 0


def test_cover():
    def hours(*n):
        return [START + timedelta(hours=h) for h in n]

    assert cover([]) == []
    assert cover(hours(5, 1, 2, 2, 9), 8) == [tuple(hours(1, 3)), tuple(hours(5, 6)), tuple(hours(9, 10))]
    assert cover(hours(1, 2, 5, 9), 2) == [tuple(hours(1, 6)), tuple(hours(9, 10))]
    assert cover(hours(1, 2, 5, 9), 1) == [tuple(hours(1, 10))]


def test_raw_scans_are_limited_to_cut_hours(spark, sf, tmp_path):
    """The scan of the facts gets the hours of changes and the hours outside the table as ranges."""
    metering = views.metering(spark, sf)
    path = str(tmp_path / "hours")
    store.refresh(spark, path, store.METERING, metering, views.AS_OF)
    df = comparison.credit_comparison(metering, views.migration_log(spark, sf), stored=store.load(spark, path, store.METERING))
    text = df._jdf.queryExecution().executedPlan().toString()
    raw = [line for line in text.splitlines() if "FileScan" in line and "/events.parquet" in line and "Or(" in line]
    assert raw and all("PushedFilters" in line for line in raw)


def test_alert_reads_two_ranges(spark, sf):
    df = anomaly.latency_regression_alert(views.query_history(spark, sf), views.migration_log(spark, sf), views.AS_OF)
    assert "Or(LessThan(ts," in df._jdf.queryExecution().executedPlan().toString()
