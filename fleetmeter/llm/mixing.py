"""Mixing sources to target weights by nested hash thresholds.

Every row has a 64-bit hash. A source whose target is ``e`` whole passes and a rest takes each row ``e`` times, and those
below a threshold once more. The threshold comes from histograms: words by source and leading hash bits give the bucket in
which the rest is used up, and only the rows of that bucket are looked at again by their next bits. Buckets are nested, so
a larger budget takes a superset of a smaller one, and no row is ever sorted.

Only built-in functions are used. A source that owns most rows arrives at each shuffle as one partial sum per bucket and
task. What joins back to the rows is one line per source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import join_spread
from .common import checkpointed, word_count

#: Hash bits that one histogram adds, and the most histograms (60 of 64 bits: then a bucket holds equal rows only).
BITS, LEVELS = 10, 6
#: The lines per source are broadcast up to this many sources; beyond it they meet the rows in a salted shuffle join.
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class Mix:
    """Where each source's mix ends: ``limits`` has a line per source, ``depth`` is the number of hash bits they use."""

    limits: DataFrame
    depth: int


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _top_bits(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``source_size`` and ``target`` of each source (columns ``key``, ``source``, ``source_size``).

    The shares fill up like vessels: with sources in order of how soon they are full, the common level is that of the
    first source which is not. The windows run over one line per source.
    """
    by_code_point = W.orderBy(F.asc_nulls_last("source"))
    choices = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn(
        "weight", F.element_at(choices, (F.pmod(F.row_number().over(by_code_point) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("most", F.col("source_size") * F.lit(float(most)))
    soonest = W.orderBy(F.col("most") / F.col("weight"), "key")
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    before = F.coalesce(F.sum("most").over(soonest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(soonest.rowsBetween(W.currentRow, W.unboundedFollowing))
    leveled = ranked.withColumn("level", (total - before) / rest).withColumn(
        "open", F.when(F.col("most") / F.col("weight") > F.col("level"), F.col("level"))
    )
    level = F.first("open", ignorenulls=True).over(
        soonest.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    return leveled.withColumn("level", level).select(
        "key", "source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target")
    )


def row_hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def plan(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, doc_id: str = "doc_id",
    text: str = "text", source: str = "source",
) -> Mix:
    """Find each source's target and the hash threshold that meets it.

    Null texts have size 0 and a null source is a source, the last. Equal rows (same id, same text) share a hash and are
    taken or left together. A source without words has target 0. An empty table has no limits.
    """
    rows = checkpointed(
        docs.select(
            _key(F.col(source)).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            row_hash(F.col(doc_id), F.col(text)).alias("h"),
        )
    )
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    limits = (
        targets(sizes, weights, most).withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumns({"prefix": F.lit(0).cast("long"), "boundary_size": F.lit(None).cast("long")})
    )
    limits = checkpointed(limits)
    left, depth = rows.select("key", "size", "h"), 0
    for _ in range(LEVELS):
        depth += BITS
        buckets = left.groupBy("key", _top_bits(F.col("h"), depth).alias("bucket")).agg(
            F.sum("size").alias("bucket_size"), F.count("*").alias("bucket_rows")
        )
        upto = F.sum("bucket_size").over(W.partitionBy("key").orderBy("bucket"))
        boundary = (
            buckets.withColumn("upto", upto)
            .join(_small(limits.select("key", "rest")), "key")
            .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("bucket_size") <= F.col("rest")))
            .select(
                "key", "bucket", "bucket_size", "bucket_rows",
                (F.col("rest") - (F.col("upto") - F.col("bucket_size"))).alias("new_rest"),
            )
        )
        limits = checkpointed(
            limits.drop("boundary_size", "bucket_rows").join(boundary, "key", "left").select(
                "key", "source", "source_size", "target", "passes",
                F.coalesce("new_rest", "rest").alias("rest"),
                # without a boundary the whole source is needed: a prefix above every bucket
                F.coalesce("bucket", F.when(F.col("rest") > 0, F.lit(1 << depth).cast("long")).otherwise(0)).alias("prefix"),
                F.col("bucket_size").alias("boundary_size"),
                "bucket_rows",
            )
        )
        if (limits.agg(F.max("bucket_rows")).first()[0] or 0) <= 1:
            break
        at = _small(limits.select("key", F.col("prefix").alias("at")))
        left = checkpointed(left.join(at, "key").where(_top_bits(F.col("h"), depth) == F.col("at")).select("key", "size", "h"))
    take = F.coalesce(2 * F.col("rest") >= F.col("boundary_size"), F.lit(False))
    final = limits.select("key", "source_size", "target", "passes", "prefix", take.alias("with_boundary"))
    return Mix(checkpointed(final), depth)


def _small(lines: DataFrame) -> DataFrame:
    return F.broadcast(lines) if lines.count() <= BROADCAST_SOURCES else lines


def with_mix(
    docs: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text", source: str = "source", out: str = "_mix"
) -> DataFrame:
    """The rows of ``docs`` with a struct ``out`` of size, source_size, target, copies and taken (size times copies)."""
    h = row_hash(F.col(doc_id), F.col(text))
    facts = docs.withColumns({
        "_mix_key": _key(F.col(source)), "_mix_h": h, "_mix_top": _top_bits(h, mix.depth), "_mix_size": word_count(F.col(text)),
    })
    limits = mix.limits.select(F.col("key").alias("_mix_key"), F.struct(*mix.limits.columns).alias("_mix_limit"))
    if limits.count() <= BROADCAST_SOURCES:
        met = facts.join(F.broadcast(limits), "_mix_key")
    else:
        met = join_spread(facts, limits, ["_mix_key"], "_mix_h")
    limit = F.col("_mix_limit")
    below = (F.col("_mix_top") < limit["prefix"]) | ((F.col("_mix_top") == limit["prefix"]) & limit["with_boundary"])
    copies = limit["passes"] + below.cast("long")
    value = F.struct(
        F.col("_mix_size").alias("size"), limit["source_size"].alias("source_size"), limit["target"].alias("target"),
        copies.alias("copies"), (F.col("_mix_size") * copies).alias("taken"),
    )
    return met.withColumn(out, value).select(*[F.col(f"`{c}`") for c in docs.columns if c != out], out)


def mixed(docs: DataFrame, mix: Mix, **columns: str) -> DataFrame:
    """The mix itself: each row as often as its source's passes and threshold say, in the columns of ``docs``."""
    counted = with_mix(docs, mix, **columns)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix.copies")))
    return counted.where(F.col("_mix.copies") > 0).select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias("_mix_copy")).drop("_mix_copy")
