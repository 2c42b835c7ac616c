"""Document fingerprints from content-defined chunks.

A rolling gear hash over the UTF-8 bytes cuts a text where its leading bits are zero. Chunking is normalised: below the
normal length more bits must be zero, above it fewer, so chunk lengths crowd around the normal one. Cuts depend on the 32
bytes before them only, so an insertion moves the cuts near it and no others. A fingerprint is the set of the chunks' digests,
each with its chunk's length as weight; the weight that two sets share, against the lighter set, measures containment.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest, normal and longest chunk in bytes (a text's last chunk may be shorter). The longest fits two hex digits.
SHORTEST, NORMAL, LONGEST = 16, 64, 255
#: Leading bits of the gear hash that must be zero below and above the normal length.
STRICT_BITS, LOOSE_BITS = 7, 5
#: One random word per byte value, by rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
#: Hex digits of an entry: twelve of the digest, two of the length.
ENTRY = 14
#: Sorted runs per shuffle partition, so that partitions even out; rows per Arrow batch of the result.
RUNS, ROWS = 4, 512


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
    strict = (loose[h[loose] < np.uint32(1 << (32 - STRICT_BITS))] + 1).tolist()
    loose, ends, start, size = (loose + 1).tolist(), [], 0, len(data)
    while size - start > SHORTEST:
        end = min(start + LONGEST, size)
        i = bisect_left(strict, start + SHORTEST)
        if i < len(strict) and strict[i] < start + NORMAL:
            end = min(strict[i], end)
        else:
            i = bisect_left(loose, start + NORMAL)
            if i < len(loose):
                end = min(loose[i], end)
        ends.append(end)
        start = end
    return ends if start == size else [*ends, size]


def fingerprint(text: str | None) -> str:
    """The distinct chunks' entries in order, one after another; empty for an empty or null text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found, start, hashed = set(), 0, xxhash.xxh64_intdigest
    for end in cuts(data) if data else ():
        found.add(f"{hashed(data[start:end]) >> 16:012x}{end - start:02x}")
        start = end
    return "".join(sorted(found))


def _entries(fp: str) -> set[str]:
    return {fp[i : i + ENTRY] for i in range(0, len(fp), ENTRY)}


def containment(a: str, b: str) -> float:
    """Length of the chunks two fingerprints share, against that of the one with less: 1 for equal ones, the empty too."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    one, two = _entries(a), _entries(b)
    weigh = lambda entries: sum(int(e[-2:], 16) for e in entries)
    return weigh(one & two) / min(weigh(one), weigh(two))


def edited(text: str | None, following: str | None) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the next one."""
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ordered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows in runs, each sorted by descending id and followed by the next run's first row as a guard.

    Columns: ``run``, ``guard``, ``doc_id``, ``text``. Null ids come last and equal ids in the order of their texts' hashes.
    Where the runs begin is found on the keys alone; the number of runs follows the shuffle partitions, and one key a run
    is all that reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumns({
        "none": F.col("doc_id").isNull(), "a": F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))),
        "b": F.bitwise_not(F.xxhash64("text")),
    })
    n = RUNS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = rows.select("none", "a", "b").repartitionByRange(n, "none", "a", "b").groupBy(F.spark_partition_id()).agg(
        F.min(F.struct("none", "a", "b")).alias("k")
    )
    starts = sorted((r.k.none, r.k.a, r.k.b) for r in firsts.collect())

    @F.pandas_udf("array<int>")
    def runs(none, a, b):  # twice the run, and one more for a guard
        import pandas as pd

        out = []
        for key in zip(none.tolist(), a.tolist(), b.tolist(), strict=True):
            run = bisect_right(starts, key) - 1
            out.append([2 * run, 2 * ((run - 1) % len(starts)) + 1] if starts[run] == key else [2 * run])
        return pd.Series(out)

    placed = rows.withColumn("place", F.explode(runs("none", "a", "b")))
    return (
        placed.withColumn("run", F.expr("place div 2").cast("int"))
        .repartition(F.col("run")).sortWithinPartitions("place", "none", "a", "b")
        .select("run", (F.col("place") % 2 == 1).alias("guard"), "doc_id", "text")
    )


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    A row per document: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``
    and ``near_next``. The next document is the one with the next lower id, for the last the first; a lone document is its own
    next one. Null texts count as empty. The texts are shuffled once and stream through the tasks in order; a task holds two
    texts at a time.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("run", "guard", "doc_id", "text")]
            for i in range(batch.num_rows):
                run, guard, key, here = (c[i].as_py() for c in columns)
                here, print_ = here or "", fingerprint(here)
                if held is not None and held[0] == run:
                    changed = edited(held[2], here)
                    then = fingerprint(changed)
                    out.append((
                        held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held[3],
                        then, containment(held[3], then), containment(held[3], print_),
                    ))
                held = None if guard else (run, key, here, print_)
                if len(out) == ROWS:
                    yield arrow(out)
                    out = []
        if out:
            yield arrow(out)

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _ordered(docs, doc_id, text).mapInArrow(stream, schema)
