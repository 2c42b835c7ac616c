"""Streams against their batch counterparts, over several files and so several micro-batches."""

import random
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fleetmeter.operators import governance, rollups, sla
from fleetmeter.plans import views
from fleetmeter.sources import schemas, seeds, segments, store
from fleetmeter.sources.readers import read_or_empty
from fleetmeter.streaming import jobs


@pytest.fixture(scope="module")
def split_events(spark, sf, tmp_path_factory):
    """The events in four files by time; a stream reads one per micro-batch, oldest first."""
    folder = tmp_path_factory.mktemp("events")
    events = views.events(spark, sf)
    for i in range(4):
        part = events.filter((F.dayofmonth("ts") > i * 8) & (F.dayofmonth("ts") <= (i + 1) * 8))
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream_of(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(writer, tmp_path, name="checkpoint"):
    jobs.start(writer, str(tmp_path / name)).awaitTermination()


def plain(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


@pytest.mark.parametrize(
    "table,columns,batch",
    [(store.METERING, views.METERING, rollups.metering_by_hour), (store.EVENTS, views.EVENT_ROWS, rollups.events_by_hour)],
)
def test_stream_equals_batch(spark, split_events, tmp_path, table, columns, batch):
    path = str(tmp_path / "t")
    run(jobs.stream_hourly(stream_of(spark, split_events).select(views.spark_columns(columns)), table, path), tmp_path)
    want = batch(spark.read.parquet(split_events).select(views.spark_columns(columns)))
    got = store.load(spark, path, table).select(want.columns)
    assert plain(got) == plain(want)
    # a second start finds nothing new and changes nothing
    run(jobs.stream_hourly(stream_of(spark, split_events).select(views.spark_columns(columns)), table, path), tmp_path)
    assert plain(store.load(spark, path, table).select(want.columns)) == plain(want)


def test_stream_keeps_cost_centres_and_prunes(spark, sf, frame, tmp_path):
    """A refreshed table that a stream goes on with holds what one refresh of everything holds."""
    ddl = "warehouse_name STRING, start_time TIMESTAMP_NTZ, credits_used DECIMAL(18,2)"
    rows = [("A", "2024-01-01 10:00:00", D("1.00")), ("A", "2024-02-10 10:00:00", D("2.00")), ("B", "2024-02-10 11:00:00", D("3.00"))]
    tags = frame(
        [("A", "WAREHOUSE", "COST_CENTER", "CC-1"), ("A", "WAREHOUSE", "COST_CENTER", "CC-0")],
        "object_name STRING, domain STRING, tag_name STRING, tag_value STRING")
    folder, path = str(tmp_path / "in"), str(tmp_path / "t")
    store.refresh(spark, path, store.METERING, frame(rows[:1], ddl), "2024-01-01 11:00:00", tags)
    frame(rows, ddl).coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(schemas.METERING_HISTORY).parquet(folder)
    run(jobs.stream_hourly(source, store.METERING, path, tags, store.RETENTION_DAYS), tmp_path)
    got = sorted((r.warehouse_name, r.hour_ts, r.credits, r.tag_cost_center) for r in store.load(spark, path, store.METERING).collect())
    assert got == [("A", datetime(2024, 2, 10, 10), 2.0, "CC-1"), ("B", datetime(2024, 2, 10, 11), 3.0, None)]


def test_rows_behind_the_watermark_are_dropped(spark, frame, tmp_path):
    """Newest 10:30, lateness 2 h: hours from 08:00 on stay open, an earlier one is closed."""
    ddl = "warehouse_name STRING, start_time TIMESTAMP_NTZ, credits_used DECIMAL(18,2)"
    folder, path = str(tmp_path / "in"), str(tmp_path / "t")
    batches = [
        [("A", "2024-01-10 10:30:00", D("1.00"))],
        [("A", "2024-01-10 10:40:00", D("1.00"))],
        [("A", "2024-01-10 08:50:00", D("2.00")), ("A", "2024-01-10 06:30:00", D("4.00"))],
    ]
    for rows in batches:
        frame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schemas.METERING_HISTORY).parquet(folder)
        run(jobs.stream_hourly(source, store.METERING, path), tmp_path)
    got = sorted((r.hour_ts, r.credits) for r in store.load(spark, path, store.METERING).collect())
    assert got == [(datetime(2024, 1, 10, 8), 2.0), (datetime(2024, 1, 10, 10), 2.0)]


def test_sla_stream_judges_closed_hours_once(spark, split_events, tmp_path):
    path = str(tmp_path / "b")
    rules = seeds.workload_sla(spark)
    queries = stream_of(spark, split_events).select(views.spark_columns(views.QUERY_HISTORY))
    run(jobs.stream_sla(queries, rules, path), tmp_path)
    got = read_or_empty(spark, path, schemas.SLA_BREACHES)
    batch = sla.detect_sla_breaches(
        spark.read.parquet(split_events).select(views.spark_columns(views.QUERY_HISTORY)), rules, views.AS_OF, 720)
    newest = spark.read.parquet(split_events).agg(F.max("ts")).first()[0]
    closed = batch.filter(F.col("breach_window") + F.expr("INTERVAL 3 HOURS") <= F.lit(str(newest)).cast("timestamp_ntz"))
    assert plain(got.select(sla.BREACH_COLUMNS)) == plain(closed.select(sla.BREACH_COLUMNS))
    assert got.groupBy(sla.BREACH_KEYS).count().filter("count > 1").count() == 0


def test_closed_sla_hours_have_a_size(spark, split_events, tmp_path, monkeypatch):
    """Hours close in a batch without input; a size of 0 would have all of them broadcast, through the driver."""
    seen, judge = [], jobs.breaches

    def judged(hours, *rest):
        stats = hours._jdf.queryExecution().optimizedPlan().stats()
        seen.append((int(stats.sizeInBytes()), hours.count()))
        return judge(hours, *rest)

    monkeypatch.setattr(jobs, "breaches", judged)
    queries = stream_of(spark, split_events).select(views.spark_columns(views.QUERY_HISTORY))
    run(jobs.stream_sla(queries, seeds.workload_sla(spark), str(tmp_path / "b")), tmp_path)
    assert seen and all(0 < rows <= size for size, rows in seen)


@pytest.mark.parametrize("hours,factor", [(4, 1.5), (6, 2.0)])
def test_closed_alert_windows_are_not_broadcast(spark, sf, split_events, tmp_path, hours, factor):
    metering = stream_of(spark, split_events).select(views.spark_columns(views.METERING))
    writer = jobs.stream_spike_alert(metering, views.migration_log(spark, sf), str(tmp_path / "a"), hours, factor)
    started = jobs.start(writer, str(tmp_path / "checkpoint"))
    started.awaitTermination()
    plan = started._jsq.explainInternal(False)  # of the last batch, which has no input
    assert "SortMergeJoin [warehouse_name" in plan and "BroadcastHashJoin [warehouse_name" not in plan
    assert spark.read.parquet(str(tmp_path / "a")).count() > 0


def test_request_state_stream_equals_batch(spark, split_events, tmp_path):
    path = str(tmp_path / "r")
    events = views.request_events_of(stream_of(spark, split_events))
    run(jobs.stream_request_state(events, path), tmp_path)
    got = jobs.current_states(spark, path, jobs.request_state_schema(events))
    batch = views.request_events_of(spark.read.parquet(split_events))
    requests = batch.select("request_id").distinct().selectExpr("request_id", "'' AS warehouse_name", "now() AS created_at", "'' AS requested_by")
    want = governance.request_transitions(requests, batch).select(got.columns)
    assert plain(got) == plain(want)
    assert got.filter("illegal_moves > 0").count() > 0
    # no request, finished or not, is held by the stream itself
    assert not (tmp_path / "checkpoint" / "state").exists()


def test_replayed_request_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [("r1", 1, datetime(2024, 1, 1), "EXECUTED", "a", None), ("r1", 2, datetime(2024, 1, 2), "APPROVED", "b", "n")]
    events = spark.createDataFrame(rows, "request_id STRING, event_id LONG, event_time TIMESTAMP_NTZ, status STRING, actor STRING, notes STRING")
    folder = str(tmp_path / "in")
    events.coalesce(1).write.parquet(folder)
    for name in ("one", "two"):  # a new checkpoint replays batch 0
        source = spark.readStream.schema(events.schema).parquet(folder)
        run(jobs.stream_request_state(source, path), tmp_path, name)
        got = jobs.current_states(spark, path, jobs.request_state_schema(events)).first()
        assert (got.status, got.illegal_moves, got.reviewed_by, got.executed_at) == ("APPROVED", 2, "b", datetime(2024, 1, 1))



REQUEST_EVENTS = "request_id STRING, event_id LONG, event_time TIMESTAMP_NTZ, status STRING, actor STRING, notes STRING"


def moves_of(spark, seed, n, requests):
    r = random.Random(seed)
    statuses = ["PENDING", "APPROVED", "REJECTED", "EXECUTED", "ROLLED_BACK"]
    return [(f"r{r.randrange(requests)}", seed * 1000 + i, datetime(2024, 1, 1 + seed % 28, i % 24, i % 60), r.choice(statuses), "a", f"n{i}") for i in range(n)]


def test_request_batches_are_folded_by_tiers(spark, tmp_path, monkeypatch):
    """Many small batches: the same states as the batch form, few segments, and each row rewritten once a tier."""
    monkeypatch.setattr(segments, "FANOUT", 3)
    path, log, every = str(tmp_path / "r"), segments.SegmentLog(spark, str(tmp_path / "r")), []
    schema = jobs.request_state_schema(spark.createDataFrame([], REQUEST_EVENTS))
    for batch in range(10):
        every += (rows := moves_of(spark, batch, 20, 12))
        log.write(jobs._state_rows(spark.createDataFrame(rows, REQUEST_EVENTS), batch), 0, batch, batch)
        log.compact(jobs.folded)
        assert log.holds(batch) and not log.holds(batch + 1)
    assert [(s.tier, s.first, s.last) for s in log.segments()] == [(0, 9, 9), (2, 0, 8)]
    events = spark.createDataFrame(every, REQUEST_EVENTS)
    requests = events.select("request_id").distinct().selectExpr("request_id", "'' AS warehouse_name", "now() AS created_at", "'' AS requested_by")
    got = jobs.current_states(spark, path, schema)
    assert plain(got) == plain(governance.request_transitions(requests, events).select(got.columns))
    assert spark.read.parquet(f"{path}/segment-2-0-8").count() <= 12


def test_small_batch_over_a_large_table_writes_its_own_rows(spark, tmp_path):
    path, folder = str(tmp_path / "r"), str(tmp_path / "in")
    log = segments.SegmentLog(spark, path)
    large = spark.range(50_000).selectExpr("concat('r', id) AS request_id", "id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS event_time", "'APPROVED' AS status", "'a' AS actor", "'' AS notes")
    log.write(jobs._state_rows(large, 1000), 5, 1000, 1007)
    spark.createDataFrame(moves_of(spark, 3, 100, 40_000), REQUEST_EVENTS).coalesce(1).write.parquet(folder)
    run(jobs.stream_request_state(spark.readStream.schema(REQUEST_EVENTS).parquet(folder), path), tmp_path)
    assert spark.read.parquet(f"{path}/segment-0-0-0").count() <= 100 and len(log.segments()) == 2
    assert jobs.current_states(spark, path, jobs.request_state_schema(large)).count() == 50_000


def test_unfinished_segments_are_not_seen(spark, tmp_path):
    log = segments.SegmentLog(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([(1,)], "x INT")
    log.write(rows, 0, 0, 0)
    log.write(rows, 1, 0, 7)
    (tmp_path / "r" / "segment-1-0-7" / "_SUCCESS").unlink()  # a fold that died
    assert [s.tier for s in log.segments()] == [0] and log.read(rows.schema).count() == 1
