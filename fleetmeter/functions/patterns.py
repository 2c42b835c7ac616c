"""Matching many names with many LIKE patterns, by equality joins only.

A pattern's longest literal part has to be in every name that it matches. Its first GRAM characters are the pattern's key; a name
has the keys of all its substrings. Ends count as characters, so that ``ETL%`` looks for names that begin so, and ``%`` for any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most characters of a key.
GRAM = 8
#: What stands for the start and the end of a name.
START, END = "\x02", "\x03"


def _key_of(pattern: Column) -> Column:
    framed = F.concat(F.lit(START), pattern, F.lit(END))
    parts = F.regexp_extract_all(framed, F.lit(r"((?:[^%_\\]|\\.)+)"), 1)
    plain = F.transform(parts, lambda p: F.regexp_replace(p, r"\\(.)", "$1"))
    # the longest part, the first of equals
    longest = F.aggregate(plain, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    return F.substring(longest, 1, GRAM)


def _keys_in(name: Column) -> Column:
    framed = F.concat(F.lit(START), name, F.lit(END))
    of_size = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1))), lambda at: F.substring(framed, at, n)
    )
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), of_size)))


def matched(names: DataFrame, name: str, rules: DataFrame, pattern: str) -> DataFrame:
    """Pairs of distinct ``name`` and rule whose ``pattern`` (escape character: backslash) matches; NULL matches nothing."""
    keyed = names.select(name).distinct().select(name, F.explode(_keys_in(F.col(name))).alias("_key"))
    return (
        keyed.join(rules.withColumn("_key", _key_of(F.col(pattern))), "_key")
        .filter(F.expr(f"`{name}` LIKE `{pattern}`"))
        .drop("_key")
    )
