"""Null-safe arithmetic and the aggregates used more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; NULL when ``whole`` is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def capped(value: Column, cap: float) -> Column:
    """The smaller of the two, but NULL stays NULL (``least`` alone would return the cap)."""
    return F.when(value.isNotNull(), F.least(value, F.lit(float(cap))))


def total(column: str | Column) -> Column:
    """Sum as double. Decimal inputs are summed exactly first, so the result does not depend on row order."""
    return F.sum(column).cast("double")


def mean(column: str | Column) -> Column:
    """Average over the non-null values, from an exact sum where the input is decimal or integer."""
    return ratio(F.sum(column), F.count(column))


def scalar(value: float | DataFrame) -> Column:
    """A number, or the one value of a one-row frame as a scalar subquery: it never passes through the driver, and more
    rows are an error."""
    return value.select(value.columns[0]).scalar() if isinstance(value, DataFrame) else F.lit(float(value))


def seconds(milliseconds: Column) -> Column:
    return milliseconds.cast("double") / F.lit(1000.0)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def rounded(value: Column | str, digits: int) -> Column:
    """Round half up. Ten digits are settled first, so noise from the order of a sum does not decide a tie."""
    return F.round(F.round(value, 10), digits)


def rounded_even(value: Column | str, digits: int) -> Column:
    """Round half to even, with the same protection as ``rounded``."""
    return F.bround(F.round(value, 10), digits)


def fixed(value: Column, digits: int) -> Column:
    """A number as text with exactly ``digits`` decimals."""
    return rounded(value, digits).cast(f"decimal(28,{digits})").cast("string")
