"""Time windows relative to an explicit ``as_of`` instant."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = timedelta(hours=1)


def instant(value: str | datetime) -> datetime:
    """``as_of`` as a naive UTC datetime."""
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def midnight(value: str | datetime) -> datetime:
    return instant(value).replace(hour=0, minute=0, second=0, microsecond=0)


def moment(df: DataFrame, column: str, value: datetime) -> Column:
    """``value`` as a constant of ``column``'s own type, so a comparison needs no cast on the column.

    A cast on the column side would keep the predicate out of the Parquet reader.
    """
    return F.lit(value.isoformat(sep=" ")).cast(df.schema[column].dataType)


def between(df: DataFrame, column: str, start: datetime, end: datetime) -> Column:
    """``start <= column <= end``."""
    return (F.col(column) >= moment(df, column, start)) & (F.col(column) <= moment(df, column, end))


def last(df: DataFrame, column: str, as_of: str | datetime, **span: float) -> Column:
    """Rows of the last ``span`` (days=, hours=) up to ``as_of``. Rows after ``as_of`` did not exist yet then."""
    now = instant(as_of)
    return between(df, column, now - timedelta(**span), now)


def since_midnight(df: DataFrame, column: str, as_of: str | datetime, days: int) -> Column:
    """Rows from midnight ``days`` days before the date of ``as_of``, up to ``as_of``."""
    return between(df, column, midnight(as_of) - timedelta(days=days), instant(as_of))


def floor_to(df: DataFrame, unit: str, column: str) -> Column:
    """``date_trunc`` that keeps the column's timestamp flavour."""
    return F.date_trunc(unit, F.col(column)).cast(df.schema[column].dataType)


def hour_of(df: DataFrame, column: str = "start_time") -> Column:
    return floor_to(df, "hour", column)


def day_of(df: DataFrame, column: str = "start_time") -> Column:
    return floor_to(df, "day", column)


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed from ``start`` to ``end`` (not whole minutes elapsed)."""

    def minute(c: Column) -> Column:
        return F.unix_seconds(F.date_trunc("minute", c).cast("timestamp"))

    return ((minute(end) - minute(start)) / 60).cast("long")


def is_weekend(day: Column) -> Column:
    """Saturday or Sunday; Spark numbers Sunday 1 and Saturday 7."""
    return F.dayofweek(day).isin(1, 7)
