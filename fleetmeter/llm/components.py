"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node around it."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it is connected to) of every node that has an edge and isn't a root itself.

    ``edges`` has two columns of one orderable type; direction and repeats don't matter. Each round writes the edges to the
    shared folder; the rounds grow with the logarithm of the longest chain. A node with very many neighbours is a hot key of
    two joins whose other side has one row per node, which adaptive execution splits.
    """
    a, b = edges.columns
    now = checkpointed(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    seen = None
    while True:
        now = checkpointed(_small_star(_large_star(now)))
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if state == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = state
