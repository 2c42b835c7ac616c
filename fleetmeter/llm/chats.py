"""Collapsing logged conversation snapshots, and rendering what is left.

A log that writes a conversation after every turn holds all its prefixes. Each turn's content hash is salted with its place,
and the exclusive or of the salted hashes up to a turn identifies the prefix that ends there. A conversation whose whole is a
proper prefix of another one goes, by an anti-join on these hashes; of equal ones the least id stays.

A conversation is cut into blocks of BLOCK turn numbers, and a block of more than CELL rows (numbers may repeat, or be null)
into cells by number and by the leading bits of the content hash, which keeps the order. Places and prefix hashes are summed up
per cell first and then within the cell, so that a conversation with a third of all rows is many small groups, whatever its
numbers are; texts travel to parts of at most BLOCK rows, to be rendered.
Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Turn numbers of a block, and most rows of a rendered part, which holds one block or a stretch of it.
BLOCK = 64
#: Rows of a block, and of a turn number in it, from which on they are cut; cut turn numbers have about a quarter to a half of it.
CELL = 4096
#: What begins and ends a turn. Where a text itself has an opening mark, a space breaks it.
OPEN, CLOSE, MARK, BROKEN = "<|im_start|>", "<|im_end|>", "<|", "< |"


def _turns(log: DataFrame) -> DataFrame:
    """Narrow rows: conversation key, block, turn, and two content hashes; repeated rows once."""
    content = F.struct(F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    return log.select(
        _key(F.col("conv_id")).alias("key"), F.col("conv_id"), _block(F.col("turn")).alias("block"), F.col("turn"),
        F.xxhash64(content).alias("a"), F.xxhash64(F.lit(1), content).alias("b"),
    ).distinct()


def _key(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), "n").otherwise(F.concat(F.lit("c"), conv_id.cast("string")))


def _block(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / BLOCK), F.lit(-(1 << 62))).cast("long")


def _celled(turns: DataFrame) -> DataFrame:
    """``turns`` with ``cell``, a struct that follows the order of the rows; none has many more rows than CELL."""
    number = F.coalesce("turn", F.lit(0)).cast("long").alias("number")  # a null turn is alone in its block
    counts = turns.groupBy("key", "block", number).agg(F.count("*").alias("rows"))
    large = counts.groupBy("key", "block").agg(F.sum("rows").alias("all")).where(F.col("all") > CELL).select("key", "block")
    bits = F.when(F.col("rows") > CELL, F.ceil(F.log2(F.col("rows") * 4 / CELL)) - 1).otherwise(0).cast("int")
    cut = counts.join(large, ["key", "block"]).select("key", "block", "number", bits.alias("bits"))
    bucket = F.when(F.col("bits") > 0, F.expr("shiftright(a, 64 - bits)")).otherwise(F.lit(0)).cast("long")
    rows = turns.withColumn("number", number).join(cut, ["key", "block", "number"], "left")
    place = F.when(F.col("bits").isNull(), F.lit(0)).otherwise(F.col("number")).cast("long")
    cell = F.struct("block", place.alias("number"), bucket.alias("bucket"))
    return rows.select("key", "conv_id", "turn", "a", "b", cell.alias("cell"))


def _placed(log: DataFrame) -> DataFrame:
    """Distinct turns with ``cell``, ``place``, ``n`` (turns of the conversation), and ``at`` and ``size`` (place in the block, its rows)."""
    turns = _celled(checkpointed(_turns(log)))
    before = lambda *by: W.partitionBy(*by).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sizes = turns.groupBy("key", "cell").agg(F.count("*").alias("rows")).withColumn("block", F.col("cell.block"))
    sizes = sizes.select(
        "key", "cell", F.coalesce(F.sum("rows").over(before("key")), F.lit(0)).alias("start"),
        F.coalesce(F.sum("rows").over(before("key", "block")), F.lit(0)).alias("inner"),
        F.sum("rows").over(W.partitionBy("key")).alias("n"), F.sum("rows").over(W.partitionBy("key", "block")).alias("size"),
    )
    inside = F.row_number().over(W.partitionBy("key", "cell").orderBy(F.asc_nulls_first("turn"), "a", "b"))
    placed = turns.join(sizes, ["key", "cell"]).withColumn("inside", inside)
    return placed.select(
        "key", "conv_id", "cell", "turn", "a", "b", (F.col("start") + F.col("inside")).alias("place"), "n",
        (F.col("inner") + F.col("inside")).alias("at"), "size",
    )


def prefixes(log: DataFrame) -> DataFrame:
    """``key``, ``conv_id``, ``place``, ``n`` (turns of the conversation), and the prefix hashes ``p1`` and ``p2``, a row per turn."""
    return _prefixes(checkpointed(_placed(log)))


def _prefixes(placed: DataFrame) -> DataFrame:
    before = W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    salted = placed.withColumns({"z1": F.xxhash64("place", "a", "b"), "z2": F.xxhash64("b", "place", "a")})
    cells = salted.groupBy("key", "cell").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"))
    xor = lambda c: F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long"))
    carried = cells.select("key", "cell", xor("x1").alias("c1"), xor("x2").alias("c2"))
    upto = W.partitionBy("key", "cell").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    rolled = salted.withColumns({"w1": F.bit_xor("z1").over(upto), "w2": F.bit_xor("z2").over(upto)})
    return rolled.join(carried, ["key", "cell"]).select(
        "key", "conv_id", "place", "n", F.expr("w1 ^ c1").alias("p1"), F.expr("w2 ^ c2").alias("p2")
    )


def maximal(log: DataFrame) -> DataFrame:
    """``key``, ``conv_id``, ``n_turns`` and ``n_copies`` of the conversations that are no other's proper prefix.

    Equal conversations count as copies of the one with the least id (a null id only if there is no other). Turns follow
    their number, null first; rows of one number follow their hashes, and repeated rows count once. Turns without an id
    are one conversation.
    """
    return _maximal(checkpointed(_placed(log)))


def _maximal(placed: DataFrame) -> DataFrame:
    every = checkpointed(_prefixes(placed))
    whole = every.where("place = n").groupBy("p1", "p2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = every.where("place < n").select("p1", "p2", F.col("place").alias("n")).distinct()
    kept = whole.join(begun, ["p1", "p2", "n"], "left_anti")
    return kept.select(_key(F.col("conv_id")).alias("key"), "conv_id", F.col("n").alias("n_turns"), "n_copies")


def rendered(log: DataFrame) -> DataFrame:
    """``conv_id``, ``part``, ``n_turns`` (of the part), ``n_copies`` and ``text`` of the maximal conversations.

    A part holds the turns of one block of numbers, or BLOCK of them at most where numbers repeat; its text is one marked
    section per turn, and the parts of a conversation in order are the conversation. A null role reads ``unknown``, a null text
    is empty.
    """
    placed = checkpointed(_placed(log))
    rows = log.select(
        _key(F.col("conv_id")).alias("key"), _block(F.col("turn")).alias("block"), "turn",
        F.struct(F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")).alias("content"), "role", "text",
    )
    kept = _maximal(placed).select("key", "conv_id", "n_copies")
    clean = lambda c: F.replace(c, F.lit(MARK), F.lit(BROKEN))
    section = F.concat(
        F.lit(OPEN), clean(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), clean(F.coalesce("text", F.lit(""))),
        F.lit(CLOSE + "\n"),
    )
    number = F.coalesce("turn", F.lit(0)).cast("long").alias("number")
    lines = rows.select(
        "key", "block", number, "turn", F.xxhash64("content").alias("a"), F.xxhash64(F.lit(1), "content").alias("b"), section.alias("line")
    ).join(kept, "key")
    crowded = placed.where(F.col("size") > BLOCK).select(
        "key", F.col("cell.block").alias("block"), number, "a", "b", F.floor((F.col("at") - 1) / BLOCK).alias("stretch")
    )
    lines = lines.join(crowded, ["key", "block", "number", "a", "b"], "left").withColumn("stretch", F.coalesce("stretch", F.lit(0)))
    parts = lines.groupBy("key", "block", "stretch").agg(
        F.first("conv_id").alias("conv_id"), F.first("n_copies").alias("n_copies"),
        F.sort_array(F.collect_set(F.struct("turn", "a", "b", "line"))).alias("lines"),
    )
    # parts are numbered on narrow rows, before any text is there
    stretch = F.when(F.col("size") > BLOCK, F.floor((F.col("at") - 1) / BLOCK)).otherwise(F.lit(0)).alias("stretch")
    which = placed.select("key", F.col("cell.block").alias("block"), stretch).distinct()
    part = F.row_number().over(W.partitionBy("key").orderBy("block", "stretch")).cast("long") - 1
    return parts.join(which.select("key", "block", "stretch", part.alias("part")), ["key", "block", "stretch"]).select(
        "conv_id", "part", F.size("lines").cast("long").alias("n_turns"), "n_copies", F.array_join("lines.line", "").alias("text")
    )


#: The same rows by comparing whole prefixes as texts, for logs with one row a turn number.
ORACLE = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), rolled AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(md5(concat(role IS NULL, '|', role, '|', text IS NULL, '|', md5(coalesce(text, '')))), '') OVER w AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST)
), whole AS (
  SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM rolled WHERE place = n GROUP BY prefix, n
), kept AS (
  SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.place < r.n AND r.prefix = whole.prefix)
)
SELECT k.conv_id, CAST(dense_rank() OVER (PARTITION BY k.conv_id ORDER BY floor(t.turn / {BLOCK})) - 1 AS BIGINT) AS part,
       t.n_turns, k.n_copies, t.text
FROM kept k JOIN (
  SELECT conv_id, min(turn) AS turn, count(*) AS n_turns,
         string_agg('{OPEN}' || replace(coalesce(role, 'unknown'), '{MARK}', '{BROKEN}') || chr(10)
                    || replace(coalesce(text, ''), '{MARK}', '{BROKEN}') || '{CLOSE}' || chr(10), '' ORDER BY turn NULLS FIRST) AS text
  FROM turns GROUP BY conv_id, floor(turn / {BLOCK})
) t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
"""
