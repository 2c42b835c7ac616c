"""Near duplicates by SimHash, linked by multi-index hashing.

A fingerprint has 64 bits in SEGMENTS segments. If two differ in ``distance`` bits or fewer, they differ in
``distance // SEGMENTS`` or fewer within some segment. So each fingerprint stands in one table under the value of each of its
segments, and looks up all values of the small Hamming ball around each of its segments; each match is verified by its whole
distance, within the join.

A value that more than CROWD fingerprints share isn't looked up, as that would compare all of them with each other. Two
fingerprints meet without it unless the values of both are crowded, for each looks up the other. Crowded ones are all put
under the values of a ball of half the distance around the whole fingerprint, and who meets under one is linked to the least
there: two balls of half the distance meet, and whoever meets is near enough.

Only distinct fingerprints enter the tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, map_slices, quoted, row_hash, unused, words_of
from .components import components

SEED = 42
BITS = 64
#: Segments of the fingerprint.
SEGMENTS = 2
#: Most differing bits of a link, unless another number is given.
DISTANCE = 2
#: Fingerprints that share a segment's value and are still compared one by one.
CROWD = 64
#: Shingles hashed at once, so that a very long text needs no more memory than a long one.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats counted; a bit is set if over half have it.

    A text of fewer words is one shingle; a text without words, or null, has fingerprint 0.
    """
    words = [w.lower() for w in words_of(text)]
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends, starts = ends[width - 1 :].tolist(), starts[: len(words) - width + 1].tolist()
    hashed, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        some = zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)
        h = np.array([hashed(joined[s:e], SEED) for s, e in some], np.dtype(">u8"))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def node(text: Column) -> Column:
    """What stands for all equal texts; texts without a word are equal."""
    return F.when(F.coalesce(text, F.lit("")).rlike(rf"^[{SPACE}]*+$"), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) and ``node`` of every row; equal texts have equal fingerprints."""
    source = F.col(quoted(text))
    named = docs.select(F.col(quoted(doc_id)).alias("doc_id"), source.alias("text"), node(source).alias("node"))

    def work(part: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
        return {"doc_id": part.column("doc_id"), "fp": fp.view(np.int64), "node": part.column("node")}

    kind = named.schema["doc_id"].dataType.simpleString()
    return map_slices(named, "text", work, f"doc_id {kind}, fp long, node long")


def _ball(first: int, bits: int, radius: int) -> list[int]:
    """Signed masks of at most ``radius`` of the ``bits`` bits from ``first`` on."""
    masks = [sum(1 << b for b in some) for n in range(radius + 1) for some in combinations(range(first, first + bits), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _entries(distinct: DataFrame, radius: int) -> DataFrame:
    """``fp`` and the ``key`` of every segment value within ``radius`` bits of its own."""
    width = BITS // SEGMENTS
    masks = [F.struct(F.lit(s).alias("seg"), F.lit(m).cast("long").alias("mask")) for s in range(SEGMENTS) for m in _ball(s * width, width, radius)]
    value = f"shiftrightunsigned(fp ^ of.mask, of.seg * {width}) & {(1 << width) - 1}L"
    return distinct.select("fp", F.explode(F.array(*masks)).alias("of")).select("fp", F.expr(f"({value}) * {SEGMENTS} + of.seg").alias("key"))


def _met(distinct: DataFrame, distance: int) -> DataFrame:
    """Links between fingerprints whose balls of half the distance have a value in common, each to the least one there."""
    near, far = distance // 2, distance - distance // 2
    at = lambda radius: distinct.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in _ball(0, BITS, radius)])).alias("mask")).select("fp", (F.col("fp").bitwiseXOR(F.col("mask"))).alias("at"))
    if near == far:
        all_at = at(near)
        least = all_at.groupBy("at").agg(F.min("fp").alias("to"), F.count("*").alias("n")).where("n > 1").select("at", "to")
        return all_at.join(least, "at").select("fp", "to")
    close, wide = at(near), at(far)
    to = lambda rows: rows.groupBy("at").agg(F.min("fp").alias("to"))
    return close.join(to(wide), "at").select("fp", "to").union(wide.join(to(close), "at").select("fp", "to"))


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp`` and ``to``: links between distinct fingerprints at ``distance`` or fewer bits, enough to connect all that match."""
    if not 0 <= distance < BITS // SEGMENTS:
        raise ValueError(f"distance has to be from 0 to {BITS // SEGMENTS - 1}")
    near = f"bit_count(fp ^ to) <= {distance}"
    table = _entries(distinct, 0)
    sizes = checkpointed(table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # alone under its value, a fingerprint can still be found by others, so only crowded values are left out
    crowded = sizes.where(f"n > {CROWD}").select("key")
    found = table.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("to"))
    matched = _entries(distinct, distance // SEGMENTS).join(found, "key").where("fp != to").where(near).select("fp", "to")
    packed = table.join(crowded, "key", "left_semi").select("fp").distinct()
    return matched.union(_met(packed, distance).where("fp != to").where(near))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = DISTANCE
) -> DataFrame:
    """A row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the least id reachable.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null id belong to their group, but
    never name it; a group of null ids only has a null component. Repeated rows stay repeated.
    """
    return _grouped(fingerprints(docs, doc_id, text, shingle), distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(prints: DataFrame, distance: int) -> DataFrame:
    """``prints`` with ``root``, the least fingerprint of its group, and ``component_id``."""
    rows = checkpointed(prints)
    named = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(named.select("fp"), distance))
    of = named.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(names, "root").select("fp", "root", "component_id"), "fp")


def without_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = DISTANCE
) -> DataFrame:
    """The rows of ``docs`` of which the one with the least id of each group stays.

    A row is told by its id and text: unlike texts of one id are judged each on its own. Of several texts with a group's least
    id the one with the least hash stays, of its repeated rows one: the one whose columns have the least hash. Rows without an
    id form no group and stay.
    """
    members = _grouped(fingerprints(docs, doc_id, text, shingle), distance)
    least = members.where("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    own_id, own_node, own_row, times = unused(docs, "id", "node", "row", "times")
    told = {own_id: F.col(quoted(doc_id)), own_node: node(F.col(quoted(text))), own_row: row_hash(docs)}
    rows = docs.where(F.col(quoted(doc_id)).isNotNull()).withColumns(told)
    least = least.select(F.col("least.doc_id").alias(own_id), F.col("least.node").alias(own_node))
    kept = rows.select(*told).join(least, [own_id, own_node]).groupBy(own_id, own_node, own_row).agg(F.count("*").alias(times))
    kept = kept.groupBy(own_id, own_node).agg(F.min_by(F.struct(own_row, times), own_row).alias(own_row))
    kept = checkpointed(kept.select(own_id, own_node, F.col(f"{own_row}.{own_row}"), F.col(f"{own_row}.{times}").alias(times)))
    stays, columns = rows.join(kept, [own_id, own_node, own_row]), [F.col(quoted(c)) for c in docs.columns]
    once, again = stays.where(f"{times} = 1"), stays.where(f"{times} > 1").dropDuplicates([own_id, own_node, own_row])
    return once.select(*columns).unionByName(again.select(*columns)).unionByName(docs.where(F.col(quoted(doc_id)).isNull()))
