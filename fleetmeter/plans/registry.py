"""Registry of runnable queries and their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, TimestampType

from ..functions.measures import rounded
from ..session import prepare
from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Decimals kept when results of two engines are compared.
DIGITS = 6


def decimal_rounding(sql: str) -> str:
    """Let the SQL decide rounding ties on the decimal value, as the operators do.

    DuckDB rounds the binary value: 129.825 gives 129.82. ``round(x, n)`` and ``round_even(x, n)`` therefore become
    decimal expressions.
    """
    out, i = "", 0
    for hit in re.finditer(r"\b(round|round_even)\(", sql):
        if hit.start() < i:
            continue
        depth, comma, end = 1, None, hit.end()
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = end
            end += 1
        if comma is None:
            continue
        value, digits = decimal_rounding(sql[hit.end() : comma]), int(sql[comma + 1 : end - 1])
        x = f"CAST({value} AS DECIMAL(38,10))"
        if hit.group(1) == "round":
            new = f"CAST(round({x}, {digits}) AS DOUBLE)"
        else:
            scaled = f"({x} * {10**digits})"
            new = (
                f"CAST(CASE WHEN abs({scaled} - trunc({scaled})) = 0.5 THEN 2 * round({scaled} / 2.0::DOUBLE) / {10**digits} "
                f"ELSE round({x}, {digits}) END AS DOUBLE)"
            )
        out += sql[i : hit.start()] + new
        i = end
    return out + sql[i:]


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles rounded (never -0.0), integers as BIGINT, timestamps without zone."""

    def column(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            return (rounded(c, DIGITS) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, IntegerType):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, TimestampType):
            return c.cast("timestamp_ntz").alias(f.name)
        return c

    return df.select([column(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, like: str | None = None) -> Callable[[Query], Query]:
    """Register a job under ``name``, with the SQL that must give the same rows, or that of the query it must equal."""

    def register(job: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return tidy(job(prepare(spark), sf))

        run.__doc__ = job.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = decimal_rounding(with_views(sql))
        elif like is not None:
            ORACLES[name] = ORACLES[like]
        return job

    return register


def r(expression: str, alias: str | None = None) -> str:
    """SQL of a rounded double output column, matching ``tidy``."""
    return f"round({expression}, {DIGITS}) + 0.0 AS {alias or expression}"


def big(expression: str, alias: str | None = None) -> str:
    """SQL of a BIGINT output column."""
    return f"CAST({expression} AS BIGINT) AS {alias or expression}"
