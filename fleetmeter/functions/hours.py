"""Answering a report about arbitrary instants from stored whole hours, with raw rows only where an hour doesn't do.

A stored hour can stand for its rows unless an instant that the report asks for (an edge) falls into it, or it isn't stored
for good: hours before the first stored one, and the last hours, which late rows may still change. Those are read raw.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .times import HOUR, floor_to, hour_of, moment

#: Ranges of time that a raw scan is given; more of them are joined across the shortest gaps.
RANGES = 32
#: Newest stored hours that late rows may still change.
OPEN = timedelta(hours=2)


def cover(hours: list[datetime], most: int = RANGES) -> list[tuple[datetime, datetime]]:
    """At most ``most`` half-open ranges that hold all the hours: what lies between is left out, the longest gaps first."""
    found = sorted(set(hours))
    if not found:
        return []
    gaps = [(b - a, i) for i, (a, b) in enumerate(zip(found, found[1:])) if b - a > HOUR]
    cuts = sorted(i for _, i in sorted(gaps, reverse=True)[: most - 1])
    starts, ends = [0, *(i + 1 for i in cuts)], [*cuts, len(found) - 1]
    return [(found[a], found[b] + HOUR) for a, b in zip(starts, ends, strict=True)]


@dataclass(frozen=True)
class Split:
    """The hours of a report: ``whole`` picks stored rows (joined with the changes), ``rest`` raw ones, ``near`` is for the raw scan."""

    whole: Column
    rest: Column
    near: Column


def split_at(stored: DataFrame, facts: DataFrame, column: str, dates: DataFrame, edges: list[Column]) -> Split:
    """How stored hours (``hour_ts``) and raw rows share a report whose ``edges`` follow from a row of ``dates``.

    What reaches the driver is one line per distinct hour with an edge: 8784 a year of changes, whatever their number. The
    edges' columns must be in the rows that ``whole`` and ``rest`` are applied to. No stored hours: everything is raw.
    """
    first, last = stored.agg(F.min("hour_ts").cast("string"), F.max("hour_ts").cast("string")).first()
    if first is None:
        return Split(F.lit(False), F.lit(True), F.lit(True))
    first, still_open = datetime.fromisoformat(first), datetime.fromisoformat(last) - OPEN
    edge_hours = [F.date_trunc("hour", e).cast("timestamp_ntz") for e in edges]
    marked = dates.select(F.explode(F.array(*[e.cast("string") for e in edge_hours])).alias("h"))
    found = marked.where("h IS NOT NULL").distinct().collect()

    def outside(hour: str | Column, frame: DataFrame, name: str) -> Column:
        return (hour < moment(frame, name, first)) | (hour >= moment(frame, name, still_open))

    hour = hour_of(facts, column)
    at_edge = lambda h: reduce(Column.__or__, [h.cast("timestamp_ntz").eqNullSafe(e) for e in edge_hours])
    ranges = [
        (F.col(column) >= moment(facts, column, a)) & (F.col(column) < moment(facts, column, b))
        for a, b in cover([datetime.fromisoformat(r.h) for r in found])
    ]
    stored_hour = floor_to(stored, "hour", "hour_ts")
    return Split(
        ~outside(F.col("hour_ts"), stored, "hour_ts") & ~at_edge(stored_hour),
        outside(hour, facts, column) | at_edge(hour),
        reduce(Column.__or__, ranges, outside(F.col(column), facts, column)),
    )
