"""Collocations: phrases of two and three words that occur more often than their parts suggest.

Counting follows the vertical partitioning of suffix-tree builders for strings that outgrow memory. The first words of all
suffixes are prefixes; a first pass counts them, and prefixes are put into groups whose suffixes fit a budget. A prefix that
alone outgrows it is dealt over several groups by the word that follows. Then each group builds its own subtree of the suffixes,
cut at LONGEST words, independently of all others, and reads the count of each phrase from the totals of the leaves under it.

Tasks hand suffixes on as partial subtrees: sorted leaves with counts and the words they are made of, compressed, one for each
group; so a phrase that makes up a third of all text arrives as one leaf from each. A group whose partial subtrees still have many
times the budget of leaves (two words that very many different ones follow) is dealt again, by the third word; only then the
counts of its two-word phrases are completed by a grouped sum. Everything is exact and on words, not on hashes; hashes only choose
groups.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, quoted, slices

#: Words of the longest phrase and of a leaf's path.
LONGEST = 3
#: Least occurrences of a candidate, share in percent by which a longer one makes it redundant, and rows of a language.
LEAST, SHARE, TOP = 10, 50, 2000
#: Suffixes of a group, at most about; its subtree is held by one task.
BUDGET = 1 << 20
#: Times the budget that the leaves of a group's partial subtrees may be before it is dealt again.
FULL = 8
#: Suffixes of a group where the corpus is small and there are tasks enough; only the work is dealt otherwise.
SMALL = 1 << 16
#: Buckets that prefixes are hashed to, for each group that the corpus needs; groups are runs of buckets.
FINE = 8
#: Different words, and suffixes, that a task holds before it hands them on; words are numbered with 21 bits.
HELD_WORDS, HELD = 400_000, 3 << 20
NUMBER = 21
#: Pieces end at these; the words of a piece are split at space and tab.
CUT = bytes.maketrans(b".,;:!?\x0A\x0B\x0C\x0D", b"\n" * 10)
#: Parts the words of a phrase; no word has it.
GAP = " "


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of each piece of a text, A-Z lower-cased, as UTF-8; a text without words has none."""
    for piece in (text or "").encode("utf-8", "surrogatepass").lower().translate(CUT).split(b"\n"):
        if words := piece.split():
            yield words


def _bucket(lang: str, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(f"{lang}\n".encode()))


def _named(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"), F.col(quoted(text)).alias("text"))


def word_counts(named: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` (a word) and ``f`` of all words."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def hand_on(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            words = [w.decode("utf-8", "surrogatepass") for w in counts]
            yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    count = held.setdefault(lang, Counter()).update
                    for words in pieces(text):
                        count(words)
                    if sum(map(len, held.values())) > HELD_WORDS:
                        yield from hand_on(held)
                        held = {}
        yield from hand_on(held)

    return named.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


class Groups:
    """Which group a suffix belongs to: runs of buckets within the budget, and the groups of prefixes beyond it.

    Holds a number for each bucket and an entry for each prefix beyond the budget; of either there are at most FINE and one for
    each BUDGET of words in the corpus.
    """

    def __init__(self, loads: np.ndarray, heavy: dict[tuple[str, bytes], int], budget: int):
        self.n = len(loads)
        group, used, self.of = 0, 0, np.zeros(len(loads), np.int64)
        for bucket, load in enumerate(loads.tolist()):
            if used and used + load > budget:
                group, used = group + 1, 0
            self.of[bucket] = group
            used += load
        self.heavy, group = {}, group + 1
        for key, n in sorted(heavy.items()):
            parts = -(-n // budget)
            self.heavy[key] = (group, parts)
            group += parts
        self.count = group

    def groups(self, lang: str, words: list[bytes], first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The group of each suffix, given by the numbers (from 1) of its first and second word."""
        own, base, parts = (np.zeros(len(words) + 1, np.int64) for _ in range(3))
        for i in np.unique(first).tolist():
            word = words[i - 1]
            if dealt := self.heavy.get((lang, word)):
                base[i], parts[i] = dealt
            else:
                own[i] = self.of[_bucket(lang, word) % self.n]
        out = own[first]
        heavy = parts[first] > 0
        if heavy.any():
            crc = np.array([0, *map(zlib.crc32, words)], np.int64)
            out[heavy] = base[first[heavy]] + crc[second[heavy]] % parts[first[heavy]]
        return out


class Leaves:
    """Suffixes of up to LONGEST words and their counts; words are numbered from 1, and 0 is none."""

    def __init__(self, words: list[bytes], path: np.ndarray, times: np.ndarray):
        self.words, self.path, self.times = words, path, times

    def packed(self, which: np.ndarray) -> tuple[bytes, bytes]:
        """Some leaves: the words they have, and numbers within these and counts, by bytes of equal weight."""
        path = self.path[:, which]
        used = np.unique(path)
        used = used[used > 0]
        number = np.zeros(len(self.words) + 1, np.uint32)
        number[used] = np.arange(1, len(used) + 1)
        planes = np.concatenate([number[path].ravel(), self.times[which].astype(np.uint64).view(np.uint32)])
        packer = zstandard.ZstdCompressor(level=3)
        return packer.compress(b"\n".join([self.words[i - 1] for i in used.tolist()])), packer.compress(planes.view(np.uint8).reshape(-1, 4).T.tobytes())

    @classmethod
    def unpacked(cls, words: bytes, numbers: bytes) -> Leaves:
        unpack = zstandard.ZstdDecompressor()
        planes = np.ascontiguousarray(np.frombuffer(unpack.decompress(numbers), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
        n = len(planes) // (LONGEST + 2)
        return cls(unpack.decompress(words).split(b"\n"), planes[: LONGEST * n].reshape(LONGEST, n).astype(np.int64), planes[LONGEST * n :].view(np.uint64).astype(np.int64))


def summed(path: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in order, equal ones as one with their total."""
    order = np.lexsort(path[::-1])
    path, times = path[:, order], times[order]
    starts = np.flatnonzero(np.concatenate(([True], (path[:, 1:] != path[:, :-1]).any(axis=0)))) if len(times) else order
    return path[:, starts], np.add.reduceat(times, starts) if len(starts) else times


def subtree_counts(path: np.ndarray, times: np.ndarray, least: int, partial: bool = False) -> Iterator[tuple[list[int], int]]:
    """Word numbers and counts of the phrases of two and more words in a subtree with ordered leaves.

    The leaves under a phrase are neighbours; its count is their total. Counts under ``least`` are left out, but not of phrases
    whose leaves are in several subtrees (``partial``: all shorter than LONGEST).
    """
    for depth in range(2, LONGEST + 1):
        starts = np.flatnonzero(np.concatenate(([True], (path[:depth, 1:] != path[:depth, :-1]).any(axis=0)))) if len(times) else np.zeros(0, np.int64)
        if not len(starts):
            continue
        totals = np.add.reduceat(times, starts)
        good = (path[depth - 1, starts] > 0) & ((totals >= least) | (partial and depth < LONGEST))
        yield from zip(path[:depth, starts[good]].T.tolist(), totals[good].tolist(), strict=True)


def grouped(words: DataFrame, budget: int, total: int) -> Groups:
    """Groups for the prefixes counted in ``words``, ``total`` in all."""
    n = FINE * max(1, -(-total // budget))
    heavy = {(r["lang"], r["phrase"].encode("utf-8", "surrogatepass")): r["f"] for r in words.where(F.col("f") > budget).toLocalIterator()}
    bucket = F.pmod(F.crc32(F.encode(F.concat("lang", F.lit("\n"), "phrase"), "utf-8")), F.lit(n)).alias("bucket")
    loads = np.zeros(n, np.int64)
    for r in words.where(F.col("f") <= budget).groupBy(bucket).agg(F.sum("f").alias("f")).toLocalIterator():
        loads[r["bucket"]] = r["f"]
    return Groups(loads, heavy, budget)


def partial_subtrees(named: DataFrame, groups: Groups) -> DataFrame:
    """``group``, ``lang``, ``size``, ``words`` and ``leaves``: the suffixes of a task that belong to a group, and how many."""
    known = named.sparkSession.sparkContext.broadcast(groups)
    schema = pa.schema([("group", pa.int64()), ("lang", pa.string()), ("size", pa.int64()), ("words", pa.binary()), ("leaves", pa.binary())])

    def hand_on(lang: str, number: dict[bytes, int], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        words = sorted(number)  # similar words side by side, for the packer
        rank = np.zeros(len(words) + 1, np.int64)
        rank[np.fromiter(map(number.__getitem__, words), np.int64, len(words)) + 1] = np.arange(1, len(words) + 1)
        flat = rank[np.concatenate([*ids, np.full(LONGEST, -1, np.int32)]).astype(np.int64) + 1]
        key, going = np.zeros(len(flat) - LONGEST, np.int64), flat[:-LONGEST] > 0
        for k in range(LONGEST):  # a suffix ends with its piece
            at = flat[k : len(flat) - LONGEST + k]
            going = going & (at > 0)
            key = (key << NUMBER) | np.where(going, at, 0)
        key, times = np.unique(key[key > 0], return_counts=True)
        path = np.stack([(key >> (NUMBER * (LONGEST - 1 - k))) & ((1 << NUMBER) - 1) for k in range(LONGEST)])
        leaves, group = Leaves(words, path, times), known.value.groups(lang, words, path[0], path[1])
        order = np.argsort(group, kind="stable")
        for which in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            packed = leaves.packed(which)
            columns = [pa.array([int(group[which[0]])]), pa.array([lang]), pa.array([len(which)]), *(pa.array([p]) for p in packed)]
            yield pa.record_batch(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[defaultdict, list[np.ndarray]]] = {}
        many = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if lang not in held:
                        held[lang] = (defaultdict(), [])
                        held[lang][0].default_factory = held[lang][0].__len__
                    number, ids = held[lang]
                    found: list[int] = []
                    for words in pieces(text):
                        found.extend(map(number.__getitem__, words))
                        found.append(-1)
                        if len(number) > HELD_WORDS:  # also within a very long text: a piece is never cut
                            ids.append(np.array(found, np.int32))
                            yield from hand_on(lang, number, ids)
                            number.clear()
                            ids.clear()
                            found = []
                    if found:
                        ids.append(np.array(found, np.int32))
                        many += len(found)
                if many > HELD:
                    for lang, (number, ids) in held.items():
                        yield from hand_on(lang, number, ids)
                    held, many = {}, 0
        for lang, (number, ids) in held.items():
            yield from hand_on(lang, number, ids)

    return named.mapInArrow(run, "group long, lang string, size long, words binary, leaves binary")


def dealt_again(parts: DataFrame, budget: int) -> DataFrame:
    """``parts`` with ``partial``: groups with too many leaves are cut by the third word."""
    full = parts.groupBy("group").agg(F.sum("size").alias("size")).where(F.col("size") > FULL * budget)
    # one entry for each FULL budgets of leaves in the corpus at most
    cuts = {r["group"]: -(-r["size"] // (FULL * budget)) for r in full.toLocalIterator()}
    none = parts.withColumns({"part": F.lit(0).cast("long"), "partial": F.lit(False)})
    if not cuts:
        return none
    known = parts.sparkSession.sparkContext.broadcast(cuts)
    schema = pa.schema([
        ("group", pa.int64()), ("lang", pa.string()), ("size", pa.int64()), ("words", pa.binary()), ("leaves", pa.binary()), ("part", pa.int64()), ("partial", pa.bool_()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                leaves = Leaves.unpacked(r["words"], r["leaves"])
                crc = np.array([0, *map(zlib.crc32, leaves.words)], np.int64)
                part = crc[leaves.path[LONGEST - 1]] % known.value[r["group"]]
                order = np.argsort(part, kind="stable")
                for which in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    row = [r["group"], r["lang"], len(which), *leaves.packed(which), int(part[which[0]]), True]
                    yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    again = F.col("group").isin(list(cuts))
    ddl = "group long, lang string, size long, words binary, leaves binary, part long, partial boolean"
    return none.where(~again).union(parts.where(again).mapInArrow(cut, ddl))


def phrase_counts(named: DataFrame, words: DataFrame, least: int, budget: int) -> DataFrame:
    """``lang``, ``phrase`` and ``f`` of all phrases of two to LONGEST words that occur ``least`` times or more."""
    spread = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = words.agg(F.sum("f")).first()[0] or 0
    budget = max(1, min(budget, max(SMALL, total // spread)))
    parts = checkpointed(partial_subtrees(named, grouped(words, budget, total)))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def build(table: pa.Table) -> pa.Table:
        langs, out = table.column("lang").to_pylist(), []
        for lang in dict.fromkeys(langs):
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            paths, times, held = [], [], 0
            for i in (i for i, x in enumerate(langs) if x == lang):
                leaves = Leaves.unpacked(table.column("words")[i].as_py(), table.column("leaves")[i].as_py())
                own = np.concatenate(([0], np.fromiter(map(number.__getitem__, leaves.words), np.int64, len(leaves.words)) + 1))
                paths.append(own[leaves.path])
                times.append(leaves.times)
                held += len(leaves.times)
                if held > 2 * budget:
                    path, n = summed(np.concatenate(paths, axis=1), np.concatenate(times))
                    paths, times, held = [path], [n], 0
            path, n = summed(np.concatenate(paths, axis=1), np.concatenate(times))
            known = [w.decode("utf-8", "surrogatepass") for w in number]
            found = list(subtree_counts(path, n, least, table.column("partial")[0].as_py()))
            lines = [GAP.join([known[i - 1] for i in p]) for p, _ in found]
            out.append(pa.record_batch([pa.array([lang] * len(lines), pa.string()), pa.array(lines, pa.string()), pa.array([f for _, f in found], pa.int64())], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    trees = dealt_again(parts, budget).groupBy("group", "part").applyInArrow(build, "lang string, phrase string, f long")
    return trees.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, share: int = SHARE, top: int = TOP, budget: int = BUDGET
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's ``top`` phrases of two to LONGEST words.

    Null texts have no words; a null language is ``und``. Repeated rows count again. A language without a candidate has no rows.
    """
    named = _named(docs, lang, text)
    words = checkpointed(word_counts(named))
    longer = checkpointed(phrase_counts(named, words, least, budget))
    size = F.size(F.split("phrase", GAP))
    of = lambda d: F.array_join(F.slice(F.split("phrase", GAP), *d), GAP)
    candidates = longer.withColumn("words", size)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    # parts of a candidate are as frequent as it is, so they are among the counts
    counts = words.where(F.col("f") >= least).unionByName(longer)
    cuts = candidates.select("*", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", of((F.lit(1), F.col("k"))).alias("left"), of((F.col("k") + 1, F.col("words") - F.col("k"))).alias("right"))
    part = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    met = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}  # products reach 38 digits
    score = met.withColumns({f"{c}_": v for c, v in wide.items()}).withColumn("score", F.expr("bigint(decimal(1000000) * a_ * a_ div (l_ * r_))"))
    lowest = score.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = [
        candidates.where(f"words > {w}").select("lang", F.explode(F.expr(f"transform(sequence(1, words - {w - 1}), i -> array_join(slice(split(phrase, '{GAP}'), i, {w}), '{GAP}'))")).alias("phrase"), F.col("f").alias("longer"))
        for w in range(2, LONGEST)
    ]
    covered = reduce(DataFrame.union, inner).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(covered, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows by listing all phrases, for a DuckDB that sees the table ``documents``.
ORACLE = rf"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split
), counted AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM starts, (VALUES (1), (2), (3)) t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, f AS a, ws, len(ws) AS words, unnest(range(1, len(ws))) AS k
  FROM (SELECT *, string_split(phrase, ' ') AS ws FROM counted WHERE k > 1 AND f >= {LEAST})
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
  SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, a, unnest([1, 2]) AS i FROM cuts WHERE words = 3 AND k = 1) GROUP BY ALL
), ranked AS (
  SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= {TOP}
"""
