"""Stored tables: watermark, upsert, insert-only, retention, seeding."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fleetmeter import session
from fleetmeter.sources import schemas, seeds, store
from fleetmeter.sources.readers import read_or_empty, resolve_source

M = "warehouse_name STRING, start_time TIMESTAMP_NTZ, credits_used DECIMAL(18,2)"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def stored(spark, path, table=store.METERING):
    return sorted((r.warehouse_name, r.hour_ts, r.credits) for r in store.load(spark, path, table).collect())


def test_refresh_is_idempotent_and_updates_open_hours(spark, frame, path):
    first = [("A", "2024-01-10 08:10:00", D("1.00")), ("A", "2024-01-10 10:10:00", D("2.00"))]
    store.refresh(spark, path, store.METERING, frame(first, M), "2024-01-10 10:30:00")
    once = stored(spark, path)
    store.refresh(spark, path, store.METERING, frame(first, M), "2024-01-10 10:30:00")
    assert stored(spark, path) == once
    # 1 h, 2 h and 3 h behind the newest hour: the last one is too late
    late = first + [("A", "2024-01-10 09:00:00", D("4.00")), ("A", "2024-01-10 08:59:00", D("8.00")), ("A", "2024-01-10 07:59:00", D("16.00"))]
    store.refresh(spark, path, store.METERING, frame(late, M), "2024-01-10 11:30:00")
    assert stored(spark, path) == [
        ("A", datetime(2024, 1, 10, 8), 9.0), ("A", datetime(2024, 1, 10, 9), 4.0), ("A", datetime(2024, 1, 10, 10), 2.0)]
    store.refresh(spark, path, store.METERING, frame(late, M), "2024-01-10 11:30:00", rebuild_from=datetime(2024, 1, 10))
    assert stored(spark, path)[0] == ("A", datetime(2024, 1, 10, 7), 16.0)


def test_upsert_touches_only_its_days(spark, frame, path):
    rows = frame([("A", "2024-01-08 10:00:00", D("1.00")), ("A", "2024-01-09 10:00:00", D("2.00"))], M)
    store.refresh(spark, path, store.METERING, rows, "2024-01-09 12:00:00")
    before = {r.day: r.f for r in spark.read.parquet(path).select("day", F.input_file_name().alias("f")).collect()}
    more = rows.unionByName(frame([("B", "2024-01-09 11:00:00", D("3.00"))], M))
    store.refresh(spark, path, store.METERING, more, "2024-01-09 12:00:00")
    after = {r.day: r.f for r in spark.read.parquet(path).select("day", F.input_file_name().alias("f")).collect()}
    assert before[date(2024, 1, 8)] == after[date(2024, 1, 8)]
    assert before[date(2024, 1, 9)] != after[date(2024, 1, 9)]
    assert len(stored(spark, path)) == 3


def test_upsert_leaves_days_between_its_days_alone(spark, frame, path):
    def files():
        return {r.day: r.f for r in spark.read.parquet(path).select("day", F.input_file_name().alias("f")).distinct().collect()}

    days = [("A", f"2024-01-0{d} 10:00:00", D("1.00")) for d in (1, 2, 3, 4)]
    store.refresh(spark, path, store.METERING, frame(days, M), "2024-01-04 12:00:00")
    before = files()
    updates = store.METERING.aggregate(frame([("A", "2024-01-01 10:00:00", D("5.00")), ("B", "2024-01-04 11:00:00", D("7.00"))], M))
    store.merge_upsert(spark, path, store.METERING, updates, datetime(2024, 1, 1, 10), "2024-01-04 13:00:00")
    after = files()
    assert [d for d in before if before[d] == after[d]] and {d.day for d in before if before[d] == after[d]} == {2, 3}
    assert [(n, h.day, c) for n, h, c in stored(spark, path)] == [("A", 1, 5.0), ("A", 2, 1.0), ("A", 3, 1.0), ("A", 4, 1.0), ("B", 4, 7.0)]


def test_upsert_keeps_rows_of_a_touched_day(spark, frame, path):
    """Hours before the window, on the same day, survive the rewrite."""
    store.refresh(spark, path, store.METERING, frame([("A", f"2024-01-09 {h:02d}:00:00", D("1.00")) for h in (1, 20)], M), "2024-01-09 21:00:00")
    store.refresh(spark, path, store.METERING, frame([("A", "2024-01-09 21:00:00", D("5.00"))], M), "2024-01-09 22:00:00")
    assert [c for _, _, c in stored(spark, path)] == [1.0, 1.0, 5.0]


@pytest.mark.parametrize(
    "mark,as_of,start",
    [
        (datetime(2024, 1, 10, 10), "2024-01-10 10:30:00", datetime(2024, 1, 10, 8)),
        (store.EPOCH, "2024-01-31 00:00:00", datetime(2024, 1, 1)),
        (store.EPOCH, "2024-01-31 00:10:00", datetime(2024, 1, 1, 1)),
    ],
)
def test_window_start_is_a_full_hour(mark, as_of, start):
    assert store.window_start(mark, as_of) == start


def test_watermark(spark, frame, path):
    assert store.watermark(spark, path, store.METERING) == store.EPOCH
    store.refresh(spark, path, store.METERING, frame([("A", "2024-01-10 10:59:59", D("1.00"))], M), "2024-01-10 11:00:00")
    assert store.watermark(spark, path, store.METERING) == datetime(2024, 1, 10, 10)


def test_prune_drops_days_and_cuts_the_boundary_day(spark, frame, path):
    rows = frame([("A", f"2024-01-0{d} {h:02d}:00:00", D("1.00")) for d in (1, 2, 3) for h in (3, 15)], M)
    store.refresh(spark, path, store.METERING, rows, "2024-01-03 16:00:00")
    assert store.retention_prune(spark, path, store.METERING, "2024-02-02 12:00:00") == [date(2024, 1, 1)]
    assert [h for _, h, _ in stored(spark, path)] == [datetime(2024, 1, 2, 15), datetime(2024, 1, 3, 3), datetime(2024, 1, 3, 15)]
    assert store.retained(store.load(spark, path, store.METERING), "2024-02-03 12:00:00").count() == 1
    assert store.retention_prune(spark, path, store.METERING, "2024-02-02 23:00:00") == [date(2024, 1, 2)]
    assert [h for _, h, _ in stored(spark, path)] == [datetime(2024, 1, 3, 3), datetime(2024, 1, 3, 15)]


def test_insert_only_keeps_the_first_verdict(spark, frame, path):
    ddl = "warehouse_name STRING, workload_class STRING, breach_type STRING, breach_window TIMESTAMP_NTZ, actual_value DOUBLE"
    keys = ["warehouse_name", "workload_class", "breach_window", "breach_type"]
    for value in (1.0, 2.0):
        store.merge_insert_only(spark, path, schemas.SLA_BREACHES, frame([("A", "C", "QUEUE", "2024-01-01 01:00:00", value)], ddl), keys)
    assert [r.actual_value for r in read_or_empty(spark, path, schemas.SLA_BREACHES).collect()] == [1.0]
    by_day = path + "-days"
    for value, window in ((1.0, "2024-01-01 01:00:00"), (2.0, "2024-01-01 01:00:00"), (3.0, "2024-01-02 01:00:00")):
        rows = frame([("A", "C", "QUEUE", window, value)], ddl)
        store.merge_insert_only(spark, by_day, schemas.SLA_BREACHES, rows, keys, "breach_window")
    store.merge_insert_only(spark, by_day, schemas.SLA_BREACHES, rows.limit(0), keys, "breach_window")
    assert sorted(r.actual_value for r in read_or_empty(spark, by_day, schemas.SLA_BREACHES).collect()) == [1.0, 3.0]
    assert store.stored_days(spark, by_day) == [date(2024, 1, 1), date(2024, 1, 2)]


def test_append_event_sets_defaults(spark, frame, path):
    store.append_event(path, frame([("A", "STANDARD", "ADAPTIVE", "why")], "warehouse_name STRING, current_type STRING, target_type STRING, justification STRING"),
                       schemas.MIGRATION_REQUESTS, "2024-01-10 12:00:00", "kim")
    got = read_or_empty(spark, path, schemas.MIGRATION_REQUESTS).first()
    assert (got.status, got.requested_by, got.created_at, got.executed_at) == ("PENDING", "kim", datetime(2024, 1, 10, 12), None)
    assert len(got.request_id) == 36


def test_seed_only_when_empty(spark, frame, path):
    rows = frame([("C", "%C%")], "workload_class STRING, warehouse_pattern STRING")
    assert store.seed_if_empty(spark, path, schemas.WORKLOAD_SLA, rows)
    assert not store.seed_if_empty(spark, path, schemas.WORKLOAD_SLA, rows)
    assert read_or_empty(spark, path, schemas.WORKLOAD_SLA).count() == 1


@pytest.mark.parametrize(
    "rows,schema,n", [(seeds.regulatory_calendar, schemas.REGULATORY_CALENDAR, 8), (seeds.region_support, schemas.REGION_SUPPORT, 18)]
)
def test_configuration_tables_start_with_their_seeds(spark, path, rows, schema, n):
    assert store.seed_if_empty(spark, path, schema, rows(spark))
    assert not store.seed_if_empty(spark, path, schema, rows(spark))
    assert read_or_empty(spark, path, schema).count() == n


def test_only_a_missing_source_counts_as_empty(spark, path):
    def misspelt():
        return spark.range(1).select("no_such_column")

    assert resolve_source(spark, "no_table", lambda: spark.read.parquet(path), when_missing=schemas.REGION_SUPPORT).count() == 0
    with pytest.raises(AnalysisException):
        resolve_source(spark, "no_table", misspelt, when_missing=schemas.REGION_SUPPORT)


def test_unnamed_rows_are_not_stored(spark, frame, path):
    rows = frame([("A", "2024-01-10 10:00:00", D("1.00")), (None, "2024-01-10 10:00:00", D("2.00"))], M)
    for _ in range(2):
        store.refresh(spark, path, store.METERING, rows, "2024-01-10 11:00:00")
    assert stored(spark, path) == [("A", datetime(2024, 1, 10, 10), 1.0)]


def test_shared_dir_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert spark.sparkContext.getCheckpointDir() is not None
