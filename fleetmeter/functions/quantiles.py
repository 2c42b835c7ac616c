"""Exact continuous percentiles for a handful of very large groups.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. That is right for (warehouse, hour)
groups, but a report with two groups over the whole table would put the table's distinct values into two tasks.
Here the values are counted first, then the two order statistics around the wanted rank are located: first in
coarse value buckets, then inside the bucket. No task ever holds more than one bucket. Other sums of the same groups
ride along with the counts. Both steps read the value counts with the same columns, so that they share one exchange and
the raw rows are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_of_large_groups(
    df: DataFrame,
    keys: list[str],
    value: str,
    fraction: float,
    name: str,
    sums: dict[str, Column] | None = None,
    bucket_width: float = 1000.0,
) -> DataFrame:
    """One row per ``keys`` with the interpolated percentile of ``value`` as ``name`` (NULL values are ignored).

    ``sums`` maps output names to aggregates (sums or counts) that add up over parts of a group; they cover all rows.
    ``bucket_width`` is in the unit of ``value`` and bounds the distinct values one sort has to order.
    """
    carried = dict(sums or {})
    counted = df.groupBy(
        *keys, F.floor(F.col(value) / F.lit(bucket_width)).alias("_bucket"), F.col(value).alias("_value")
    ).agg(F.count(F.lit(1)).alias("_n"), *[part.alias(n) for n, part in carried.items()])

    by_bucket = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_bucket"))
    group = Window.partitionBy(*keys)
    values_in = F.when(F.col("_bucket").isNotNull(), F.col("_bucket_n")).otherwise(0)
    buckets = (
        counted.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_bucket_n"), F.max("_value").alias("_most"), *[F.sum(n).alias(n) for n in carried])
        .withColumn("_before", F.sum(values_in).over(by_bucket) - values_in)
        .withColumn("_values", F.sum(values_in).over(group))
        .withColumn("_rank", (F.col("_values") - 1) * F.lit(float(fraction)))
    )
    low, high = F.floor("_rank"), F.ceil("_rank")

    def holds(rank: Column, start: str, count: str) -> Column:
        return (rank >= F.col(start)) & (rank < F.col(start) + F.col(count))

    # NULL values alone: the group keeps its row, without a percentile
    only_nulls = (F.col("_values") == 0) & F.col("_bucket").isNull()
    inner = only_nulls | (
        F.col("_bucket").isNotNull() & (holds(low, "_before", "_bucket_n") | holds(high, "_before", "_bucket_n"))
    )
    # a group's sums: those of its other buckets here, those of the wanted buckets from their values below
    others = [F.sum(F.when(~F.col("_inner"), F.col(n))).over(group).alias(f"_other_{n}") for n in carried]
    wanted = (
        buckets.withColumn("_inner", F.coalesce(inner, F.lit(False)))
        .select("*", *others).filter("_inner").drop("_bucket_n", "_inner", *carried)
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    parts = counted.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), "_value", "_n", *carried
    )
    same = F.col("_bucket").eqNullSafe(F.col("_b")) & (F.col("_value").isNull() | (F.col("_value") <= F.col("_most")))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ranked = parts.join(wanted, same).withColumn("_start", F.col("_before") + F.sum("_n").over(inside) - F.col("_n"))
    ends = ranked.groupBy(*keys).agg(
        F.first("_rank").alias("_rank"),
        F.max(F.when(holds(low, "_start", "_n"), F.col("_value"))).cast("double").alias("_low"),
        F.max(F.when(holds(high, "_start", "_n"), F.col("_value"))).cast("double").alias("_high"),
        *[
            F.coalesce(F.first(f"_other_{n}") + F.sum(n), F.sum(n), F.first(f"_other_{n}")).alias(n) for n in carried
        ],
    )
    weight = F.col("_rank") - F.floor("_rank")
    return ends.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * weight).alias(name), *carried)
