"""A refresh that dies while it replaces days is finished, or undone, by the next one."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fleetmeter.sources import publication, store

M = "warehouse_name STRING, start_time TIMESTAMP_NTZ, credits_used DECIMAL(18,2)"
DAYS = [f"2024-01-0{d} 10:00:00" for d in (1, 2, 3, 4)]


class Killed(Exception):
    pass


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def stored(spark, path):
    return sorted((r.hour_ts.day, r.warehouse_name, r.credits) for r in store.load(spark, path, store.METERING).collect())


def first(spark, frame, path):
    store.refresh(spark, path, store.METERING, frame([("A", t, D("1.00")) for t in DAYS], M), "2024-01-04 12:00:00")


def updates(frame):
    return store.METERING.aggregate(frame([("A", t, D("5.00")) for t in DAYS[:3]] + [("B", DAYS[3], D("7.00"))], M))


BEFORE = [(d, "A", 1.0) for d in (1, 2, 3, 4)]
AFTER = [(1, "A", 5.0), (2, "A", 5.0), (3, "A", 5.0), (4, "A", 1.0), (4, "B", 7.0)]


def upsert(spark, frame, path):
    store.merge_upsert(spark, path, store.METERING, updates(frame), datetime(2024, 1, 1, 10), "2024-01-04 13:00:00")


def later(spark, frame, path):
    """A refresh with nothing new, as the schedule runs it."""
    store.refresh(spark, path, store.METERING, frame([("A", DAYS[3], D("1.00")), ("B", DAYS[3], D("7.00"))], M), "2024-01-04 14:00:00")


@pytest.mark.parametrize("call", ["delete", "rename"])
@pytest.mark.parametrize("at", [1, 2, 3, 4])
def test_killed_while_swapping(spark, frame, path, monkeypatch, call, at):
    """Dead before the n-th folder is deleted or put in place: the next refresh finishes, without ``rebuild_from``."""
    first(spark, frame, path)
    real, seen = getattr(publication.Folder, call), []

    def dying(self, *names):
        if names[0].startswith(("day=", publication.STAGING + "/")):
            seen.append(names)
            if len(seen) == at:
                raise Killed
        real(self, *names)

    with monkeypatch.context() as m:
        m.setattr(publication.Folder, call, dying)
        with pytest.raises(Killed):
            upsert(spark, frame, path)
    later(spark, frame, path)
    assert stored(spark, path) == AFTER
    assert not [n for n in publication.Folder(spark, path).folders() if not n.startswith("day=")]


def test_killed_before_the_intent(spark, frame, path, monkeypatch):
    """Days staged, no intent: nothing was replaced, and the staged days go."""
    first(spark, frame, path)
    for name, call in (("write", publication.Folder.write), ("rename", publication.Folder.rename)):
        with monkeypatch.context() as m:
            def dying(self, *names, call=call):
                raise Killed

            m.setattr(publication.Folder, name, dying)
            with pytest.raises(Killed):
                upsert(spark, frame, path)
        assert stored(spark, path) == BEFORE and publication.STAGING in publication.Folder(spark, path).folders()
        assert not publication.recover(spark, path) and stored(spark, path) == BEFORE
        assert publication.STAGING not in publication.Folder(spark, path).folders()
    upsert(spark, frame, path)
    assert stored(spark, path) == AFTER


def test_killed_while_pruning(spark, frame, path, monkeypatch):
    """Expired days and the boundary day are one publication."""
    rows = [("A", t, D("1.00")) for t in DAYS] + [("A", "2024-01-03 20:00:00", D("2.00"))]
    store.refresh(spark, path, store.METERING, frame(rows, M), "2024-01-04 12:00:00")
    real, seen = publication.Folder.delete, []

    def dying(self, name):
        seen.append(name)
        if len(seen) == 2:
            raise Killed
        real(self, name)

    with monkeypatch.context() as m:
        m.setattr(publication.Folder, "delete", dying)
        with pytest.raises(Killed):
            store.retention_prune(spark, path, store.METERING, "2024-02-03 15:00:00")
    store.retention_prune(spark, path, store.METERING, "2024-02-03 15:00:00")
    assert stored(spark, path) == [(3, "A", 2.0), (4, "A", 1.0)]
    assert store.stored_days(spark, path) == [date(2024, 1, 3), date(2024, 1, 4)]


def test_nothing_to_publish(spark, frame, path):
    assert not publication.recover(spark, path)
    store.merge_upsert(spark, path, store.METERING, updates(frame).limit(0), datetime(2024, 1, 1), "2024-01-04 13:00:00")
    assert stored(spark, path) == [] and store.retention_prune(spark, path, store.METERING, "2024-02-03 15:00:00") == []
    first(spark, frame, path)
    assert spark.read.parquet(path).agg(F.countDistinct("day")).first()[0] == 4
