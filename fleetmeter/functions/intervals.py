"""Which date windows cover a day, by equality joins only.

An index cuts every window into aligned ranges of 1, 16, 256 ... days, at most 30 of each width, and counts the windows per range.
A day lies in one range of each width, so it looks up LEVELS rows, however many windows there are and however long they run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a range's width per level, and levels: the widest range is longer than the calendar's 9999 years.
BITS, LEVELS = 4, 7


def window_index(windows: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """``keys``, ``_level``, ``_range``, ``_windows`` (their number) and ``_first`` (the least ``name``) of all ranges of windows.

    Both ends belong to a window; one that ends before it starts, or lacks an end, covers nothing.
    """
    days = windows.filter(F.col(start) <= F.col(end)).select(
        *keys, F.col(name).alias("_name"), F.unix_date(start).alias("_s"), (F.unix_date(end) + 1).alias("_e"),
        F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level"),
    )

    def whole(level: str) -> tuple[str, str]:
        """First whole range of a level in the window, and the first one after it."""
        width = f"shiftleft(1, {BITS} * ({level}))"
        return f"shiftright(_s + {width} - 1, {BITS} * ({level}))", f"shiftright(_e, {BITS} * ({level}))"

    (lo, hi), (above, over) = whole("_level"), whole("_level + 1")
    cut = days.withColumns({
        "_lo": F.expr(lo), "_hi": F.expr(hi),
        "_from": F.expr(f"IF(_level < {LEVELS - 1}, shiftleft({above}, {BITS}), 0)"),
        "_to": F.expr(f"IF(_level < {LEVELS - 1}, shiftleft({over}, {BITS}), 0)"),
    })
    # what wider ranges hold is left out
    some = lambda a, b: f"IF({a} < {b}, sequence({a}, {b} - 1), array())"
    ranges = F.expr(f"IF(_from < _to, concat({some('_lo', '_from')}, {some('_to', '_hi')}), {some('_lo', '_hi')})")
    return (
        cut.select(*keys, "_level", F.explode(ranges).alias("_range"), "_name")
        .groupBy(*keys, "_level", "_range").agg(F.count(F.lit(1)).alias("_windows"), F.min("_name").alias("_first"))
    )


def covering(days: DataFrame, index: DataFrame, keys: list[str], day: str, of: list[str]) -> DataFrame:
    """``of``, ``day``, ``_windows`` and ``_first`` of the days (rows of ``keys``, ``of``, ``day``) that windows of their keys cover."""
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level")
    looked_up = days.select(*keys, *of, day, level).withColumn("_range", F.expr(f"shiftright(unix_date({day}), {BITS} * _level)"))
    return (
        looked_up.join(index, [*keys, "_level", "_range"])
        .groupBy(*of, day).agg(F.sum("_windows").alias("_windows"), F.min("_first").alias("_first"))
    )


def with_cover(rows: DataFrame, windows: DataFrame, key: str, of_key: str, day: Column, start: str, end: str, name: str) -> DataFrame:
    """``rows`` with ``_windows`` and ``_first``: how many windows cover the row's day, and the least name of them.

    ``windows`` has an array ``of_key`` of the keys (text) that a window is for; where it is NULL, it is for all rows. A hot key or
    day is one row of the covers, so that only the rows' side of a join is large, and adaptive execution splits it.
    """
    everyone = F.lit("*")
    own = lambda k: F.concat(F.lit("="), k)
    listed = F.coalesce(F.transform(F.array_distinct(of_key), own), F.array(everyone))
    index = window_index(windows.withColumn("_key", F.explode(listed)), ["_key"], start, end, name)
    keyed = rows.withColumn("_day", day)
    # a distinct pair looks up its own windows and everyone's
    pairs = keyed.filter(F.col("_day").isNotNull()).select(key, "_day").distinct()
    looked_up = pairs.select(key, "_day", F.explode(F.array_compact(F.array(own(F.col(key)), everyone))).alias("_key"))
    found = covering(looked_up, index, ["_key"], "_day", [key]).withColumnsRenamed({key: "_of", "_day": "_on"})
    same = F.col(key).eqNullSafe(F.col("_of")) & (F.col("_day") == F.col("_on"))
    return keyed.join(found, same, "left").select(*rows.columns, F.coalesce("_windows", F.lit(0)).alias("_windows"), "_first")
