"""Removing long word sequences that occur more than once, over a compacted de Bruijn graph of word k-mers.

A window is WINDOW consecutive words; windows are the edges of the graph. They are kept in runs: of the word k-mers inside a
window the one with the least hash, its minimiser, stands for it, and the windows in a row that one occurrence of a minimiser
stands for are one run. Equal windows choose the same k-mer, so they meet under it. Where a text goes round in a short circle,
equal runs follow each other: they are one row with the number of laps, not a row per lap.

1. Runs whose k-mer occurs once hold no repeated window. These are most of all and go no further.
2. The others are counted by their words. A run that occurs twice or more is repeated whole.
3. Compaction: if a repeated run is followed by one and the same run wherever it occurs, and that one occurs as often, the
   two don't branch and belong to one path. A join finds these links. As links keep the order of occurrences, the runs of a
   path lie one behind the other in the text where the path occurs first, and its coordinates there join them to one row.
4. Verification: the words at a path's source coordinates are read and digested. Occurrences of a path's first run get one
   span, as long as the path, with that digest; before a span is cut, the words at its own coordinates have to match it.
5. Where the graph branches (a k-mer has unlike runs: a repeat begins or ends, or a word differs), the windows of each
   different run are read at its source coordinates and counted; of a run that occurs once those windows go that others have.

Spans that touch or overlap are one span in the end. k-mers, runs and windows meet in joins and grouped sums only; no
occurrences of a hot passage are gathered. A window of step 5 is a 64-bit hash, compared among those of one k-mer (64 bits
too); whole paths are also compared by 128 bits of SHA-256 over their words.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_slices, quoted, unused, words_of

#: Words of a window whose repetition removes it, and of a k-mer.
WINDOW, KMER = 35, 6
#: Occurrences of a k-mer that one salt takes in the joins where it branches.
SALTED = 1 << 16
#: k-mers of a window.
SPAN = WINDOW - KMER + 1
#: Fixed odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    powers = [np.cumprod(np.concatenate((one, np.full(size, x, np.uint64))), dtype=np.uint64) for x in (BASE, INVERSE)]
    return powers[0], powers[1]


class Rolling:
    """Hashes of any run of words of a sequence."""

    def __init__(self, words: list[bytes]):
        ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        up, self.down = _powers(1 << max(16, len(words).bit_length()))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * up[: len(ids)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values the place of the least, the first of equals."""
    at, width = np.arange(len(values), dtype=np.int64), 1
    while width < span:
        step = min(width, span - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        width += step
    return at


def paths(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The runs of some texts: ``row``, ``kmer``, ``path`` (hash of the words), ``next`` (the text's next run's ``path``,
    masked in the last), ``first`` and ``last`` window, and ``laps``: equal runs in a row are one row, of the first one's
    windows, and masked in ``next`` too, as some are followed by themselves and the last isn't."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = [w for words in split for w in words]
    nothing = {name: np.zeros(0, np.int64) for name in ("row", "kmer", "path", "next", "first", "last", "laps")}
    if len(flat) < WINDOW:
        return nothing
    rolling, starts = Rolling(flat), np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(len(flat) - KMER + 1)
    kmers = rolling.of(at, at + KMER)
    least = _leftmost_least(kmers, SPAN)
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(row[: len(least)] == row[WINDOW - 1 :])  # windows of one text
    chosen = least[inside]
    if not len(chosen):
        return nothing
    turns = np.flatnonzero(chosen[1:] != chosen[:-1])
    first, last = inside[np.concatenate(([0], turns + 1))], inside[np.concatenate((turns, [len(chosen) - 1]))]
    path, of = rolling.of(first, last + WINDOW).view(np.int64), row[first]
    again = (of[1:] == of[:-1]) & (path[1:] == path[:-1]) & (np.diff(last - first) == 0)
    begin = np.flatnonzero(np.append(True, ~again))
    laps = np.diff(np.append(begin, len(path)))
    first, last, path, of = first[begin], last[begin], path[begin], of[begin]
    return {
        "row": of, "kmer": kmers[least[first]].view(np.int64), "path": path,
        "next": np.ma.array(np.roll(path, -1), mask=np.append(of[1:] != of[:-1], True) | (laps > 1)),
        "first": first - starts[row[first]], "last": last - starts[row[first]], "laps": laps,
    }


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``text`` and a key of two hashes; rows with equal keys are repeated rows and have equal results."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"),
    )


def _occurrences(keyed: DataFrame) -> DataFrame:
    def work(part: pa.RecordBatch) -> dict:
        found = paths(part.column("text").to_pylist())
        row = pa.array(found["row"])
        return {
            "k1": part.column("k1").take(row), "k2": part.column("k2").take(row), "kmer": found["kmer"],
            "path": found["path"], "next": pa.array(found["next"]),
            "place": found["first"] * 64 + (found["last"] - found["first"]), "laps": found["laps"],
        }

    schema = "k1 long, k2 long, kmer long, path long, next long, place long, laps long"
    return map_slices(keyed.select("text", "k1", "k2"), "text", work, schema)


def compacted(runs: DataFrame) -> DataFrame:
    """Nonbranching paths of repeated runs: ``k1``, ``k2``, ``start``, ``end`` at the source, ``kmer``, ``path``, ``n`` of the first run.

    ``runs`` has a row per different run with ``times``, ``source`` and the one ``next`` of its occurrences (null: none or several).
    """
    repeated = runs.where("times > 1")
    links = repeated.where("next is not null").select(F.col("next").alias("path"), "times").distinct()
    marked = repeated.join(links.withColumn("linked", F.lit(True)), ["path", "times"], "left")
    # one group is the runs that have their source in one text
    along = Window.partitionBy("source.k1", "source.k2").orderBy("source.place")
    return (
        marked.withColumn("chain", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(along))
        .groupBy("source.k1", "source.k2", "chain")
        .agg(
            F.min(F.struct("source.place", "kmer", "path", "n")).alias("head"),
            F.max(F.expr("(source.place >> 6) + (source.place & 63)")).alias("last"),
        )
        .select("k1", "k2", F.expr("head.place >> 6").alias("start"), (F.col("last") + WINDOW).alias("end"),
                "head.kmer", "head.path", "head.n")
    )


def digest(words: list[bytes], start: int, end: int) -> bytes:
    """What words have to match to be taken for the same: half of the SHA-256 of them joined by a space."""
    return hashlib.sha256(b" ".join(words[start:end])).digest()[:16]


def _at_sources(met: DataFrame, whole: bool) -> DataFrame:
    """What the texts hold at the coordinates in ``given``: digests of whole paths, or the hashes of single runs' windows."""
    names = ("kmer", "path", "n", "times", "start", "end")

    def work(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("k1", "k2", *names, "held")}
        columns = (part.column(c).to_pylist() for c in ("k1", "k2", "text", "given"))
        for k1, k2, text, given in zip(*columns, strict=True):
            wanted = [g for g in given if g["whole"] == whole]
            words = words_of(text) if wanted else []
            rolling = None if whole or not wanted else Rolling(words)
            for g in wanted:
                at = np.arange(g["start"], g["end"] - WINDOW + 1)
                held = digest(words, g["start"], g["end"]) if whole else rolling.of(at, at + WINDOW).view(np.int64)
                for name, value in ({"k1": k1, "k2": k2, "held": held} | {c: g[c] for c in names}).items():
                    out[name].append(value)
        return out

    schema = "k1 long, k2 long, kmer long, path long, n long, times long, start long, end long, held "
    return map_slices(met, "text", work, schema + ("binary" if whole else "array<long>"))


def spans(keyed: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``spans``: an array of (start, end, digest) word places to remove, for rows that have any.

    The digest is null for single windows, which were compared by hash.
    """
    occurrences = _occurrences(keyed)
    nodes = occurrences.groupBy("kmer").agg(F.sum("laps").alias("n"))
    found = checkpointed(occurrences.join(checkpointed(nodes.where("n > 1")), "kmer"))
    first, last = F.expr("place >> 6"), F.expr("(place >> 6) + (place & 63)")
    runs = checkpointed(found.groupBy("kmer", "path", "n").agg(
        F.sum("laps").alias("times"), F.min(F.struct("k1", "k2", "place")).alias("source"),
        F.when((F.min("next") == F.max("next")) & (F.count("next") == F.count("*")), F.min("next")).alias("next"),
    ))
    given = ("kmer", "path", "n", "times", "start", "end", "whole")
    whole = compacted(runs).withColumns({"times": F.lit(None).cast("long"), "whole": F.lit(True)})
    branching = runs.where("times < n").select("source.*", "kmer", "path", "n", "times").select(
        "k1", "k2", first.alias("start"), (last + WINDOW).alias("end"), "kmer", "path", "n", "times", F.lit(False).alias("whole")
    )
    asked = whole.unionByName(branching).groupBy("k1", "k2").agg(F.collect_list(F.struct(*given)).alias("given"))
    # no checkpoint here: in one plan with the join that cuts the spans, the texts are shuffled once for both
    met = keyed.join(asked, ["k1", "k2"])

    # A frequent k-mer's rows are dealt over as many salts as its count asks for; its other side is repeated per salt.
    salt = lambda *by: F.pmod(F.xxhash64(*by), F.expr(f"1 + n div {SALTED}")).alias("salt")
    salts = F.explode(F.expr(f"sequence(0L, n div {SALTED})")).alias("salt")
    heads = _at_sources(met, True).select(
        "kmer", "path", (F.col("end") - F.col("start")).alias("words"), F.col("held").alias("digest"), "n"
    ).distinct()
    repeats = (
        found.select("k1", "k2", "kmer", "path", first.alias("start"), F.expr("(place & 63) + 1").alias("lap"), "laps", salt("k1"))
        .join(heads.select("kmer", "path", "words", "digest", salts), ["kmer", "path", "salt"])
        .select("k1", "k2", "start", (F.col("start") + F.col("words")).alias("end"), "digest", "lap", "laps")
    )
    # of a run that occurs once, those windows are repeated that other runs have too
    windows = _at_sources(met, False).select(
        "k1", "k2", "kmer", "n", "times", F.col("start").alias("first"), F.posexplode("held").alias("j", "h")
    )
    twice = windows.groupBy("kmer", "h", "n").agg(F.sum("times").alias("total")).where("total > 1").select("kmer", "h", salts)
    start = F.col("first") + F.col("j")
    alone = (
        windows.where("times = 1").select("k1", "k2", "kmer", "h", start.alias("start"), salt("k1", "first"))
        .join(twice, ["kmer", "h", "salt"])
        .select("k1", "k2", "start", (F.col("start") + WINDOW).alias("end"), F.lit(None).cast("binary").alias("digest"),
                F.lit(1).cast("long").alias("lap"), F.lit(1).cast("long").alias("laps"))
    )
    found_in = repeats.union(alone).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end", "digest", "lap", "laps")).alias("every"))
    return found_in.select("k1", "k2", F.expr("""flatten(transform(every, s -> transform(sequence(0L, s.laps - 1), i ->
        named_struct('start', s.start + i * s.lap, 'end', s.end + i * s.lap, 'digest', s.digest))))""").alias("spans"))


def kept_words(text: str | None, cut: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and the number of words that go. A span whose words differ from its source's stays."""
    words = words_of(text)
    cut = [c for c in cut or () if c["digest"] is None or c["digest"] == digest(words, c["start"], c["end"])]
    if not cut:
        return words, 0
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, [c["start"] for c in cut], 1)
    np.add.at(depth, [c["end"] for c in cut], -1)
    stays = np.cumsum(depth[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stays)], int(len(words) - stays.sum())


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of the kept words joined by a space.

    Every word covered by a window that also starts anywhere else, in the same text or another, goes; the first occurrence
    too. Null and empty texts have no words; a text under WINDOW words loses none. Repeated rows repeat each other's windows.
    """
    keyed = _keyed(docs, doc_id, text)

    def work(part: pa.RecordBatch) -> dict:
        kept = [kept_words(t, c) for t, c in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True)]
        return {
            "doc_id": part.column("doc_id"), "n_words": [len(w) + n for w, n in kept], "n_removed": [n for _, n in kept],
            "kept_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in kept],
        }

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return map_slices(
        keyed.join(spans(keyed), ["k1", "k2"], "left"), "text", work,
        f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string",
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut from the texts; texts that lose none stay as they are, to the byte.

    A shortened text is its kept words joined by a space, and ``n_chars``, where there is such a column, its new length.
    """
    keyed = _keyed(docs, doc_id, text)
    cut = spans(keyed)
    schema = docs.schema
    k1, k2, found = unused(docs, "k1", "k2", "spans")
    own_text = F.col(quoted(text))
    rows = docs.withColumns({k1: F.xxhash64(F.col(quoted(doc_id)), own_text), k2: F.xxhash64(own_text)})
    met = rows.join(cut.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(found)), [k1, k2], "left")

    def work(part: pa.RecordBatch) -> dict:
        out = {f.name: part.column(f.name) for f in schema}
        texts = part.column(text).to_pylist()
        for i, c in enumerate(part.column(found).to_pylist()):
            if c:
                texts[i] = b" ".join(kept_words(texts[i], c)[0]).decode("utf-8", "surrogatepass")
        out[text] = texts
        if n_chars in out:
            given = part.column(n_chars).to_pylist()
            out[n_chars] = [
                len(t) if c else n for t, n, c in zip(texts, given, part.column(found).to_pylist(), strict=True)
            ]
        return out

    return map_slices(met.select(*[F.col(quoted(c)) for c in docs.columns], found), text, work, schema)
