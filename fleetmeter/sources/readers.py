"""Reading telemetry, choosing between staged and raw sources, and normalising what arrives."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

# Inventory columns as delivered, and their canonical names.
INVENTORY_COLUMNS = {
    "name": "warehouse_name",
    "type": "warehouse_type",
    "state": "state",
    "size": "warehouse_size",
    "generation": "generation",
    "max_query_performance_level": "max_query_perf_level",
    "query_throughput_multiplier": "throughput_multiplier",
    "min_cluster_count": "min_clusters",
    "max_cluster_count": "max_clusters",
    "auto_suspend": "auto_suspend",
    "resource_monitor": "resource_monitor",
}

# Fleet listing order; the columns after the first four are shown when present.
FLEET_COLUMNS = [
    "warehouse_name", "warehouse_type", "state", "warehouse_size", "max_clusters", "auto_suspend",
    "resource_monitor", "generation", "max_query_perf_level", "throughput_multiplier",
]


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select the schema's columns with its types; a missing column is an error that names it."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"input lacks column(s): {', '.join(missing)}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """Any Spark source, validated against a logical schema."""
    return conform(spark.read.format(fmt).options(**options).load(path), schema)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored table, or no rows when nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)


#: Conditions of a table or path that doesn't exist.
MISSING = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND")


def resolve_source(
    spark: SparkSession,
    staged_table: str,
    raw: Callable[[], DataFrame],
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    when_missing: StructType | None = None,
) -> DataFrame:
    """The staged rollup when the catalog has it, else the raw computation.

    ``keep`` restricts the staged rows (the look-back). With ``when_missing`` a raw source that doesn't exist yields no rows
    instead of an error; any other error stays one.
    """
    if spark.catalog.tableExists(staged_table):
        return keep(spark.table(staged_table))
    try:
        return raw()
    except AnalysisException as e:
        if when_missing is None or e.getCondition() not in MISSING:
            raise
        return empty(spark, when_missing)


def inventory_normalise(inventory: DataFrame) -> DataFrame:
    """Keep the inventory columns that arrived, under canonical names."""
    return inventory.select(
        [F.col(found).alias(name) for found, name in INVENTORY_COLUMNS.items() if found in inventory.columns]
    )


def fleet_listing(inventory: DataFrame) -> DataFrame:
    """Normalised inventory for display: adaptive after standard in reverse type order, then by name."""
    present = [c for c in FLEET_COLUMNS if c in inventory.columns]
    return inventory.select(present).orderBy(F.desc("warehouse_type"), "warehouse_name")


def numeric_normalise(df: DataFrame) -> DataFrame:
    """Decimal columns as double."""
    return df.select(
        [
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def warehouse_filter(
    df: DataFrame, names: Iterable[str] | DataFrame | None = None, allowlist: Iterable[str] | DataFrame | None = None
) -> DataFrame:
    """Rows of the requested warehouses that are also on the allowlist.

    No names, or none on the allowlist, means no filter. Long lists come as a DataFrame with ``warehouse_name``.
    """
    if isinstance(names, DataFrame):
        wanted = names.select("warehouse_name").distinct()
        if isinstance(allowlist, DataFrame):
            wanted = wanted.join(allowlist.select("warehouse_name"), "warehouse_name", "left_semi")
        elif allowlist is not None:
            wanted = wanted.filter(F.col("warehouse_name").isin(list(allowlist)))
        return df if wanted.isEmpty() else df.join(wanted, "warehouse_name", "left_semi")
    asked = list(names or [])
    if asked and isinstance(allowlist, DataFrame):
        # at most len(asked) rows reach the driver
        hits = allowlist.filter(F.col("warehouse_name").isin(asked)).select("warehouse_name").distinct().collect()
        asked = [row.warehouse_name for row in hits]
    elif allowlist is not None:
        allowed = set(allowlist)
        asked = [n for n in asked if n in allowed]
    return df.filter(F.col("warehouse_name").isin(asked)) if asked else df
