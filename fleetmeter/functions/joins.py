"""Joining raw telemetry to a much smaller table whose keys may be hot.

Nothing here forces a broadcast: Catalyst broadcasts the small side only when its size is under
``spark.sql.autoBroadcastJoinThreshold``. When it is not, a plain shuffle join would send a key that owns a third of all
rows to one task, so the telemetry side is spread over a salt and the small side is repeated once per salt value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fewest salts of a spread join.
SALTS = 16


def salts_for(spark: SparkSession) -> int:
    """As many salts as spread a third of all rows over a third of the shuffle partitions."""
    return max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)


def join_spread(
    facts: DataFrame, small: DataFrame, keys: list[str], spread_by: str, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join ``facts`` to ``small`` (unique ``keys``), spreading each key over ``salts`` tasks (``salts_for`` by default).

    The salt is a hash of ``spread_by``, not a random number, so a recomputed partition holds the same rows.
    """
    salts = salts or salts_for(facts.sparkSession)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    repeated = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def join_per_warehouse(facts: DataFrame, per_warehouse: DataFrame, spread_by: str, how: str = "inner") -> DataFrame:
    return join_spread(facts, per_warehouse, ["warehouse_name"], spread_by, how)
