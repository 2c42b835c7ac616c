"""Grouping of spelling variants: words that differ by one edit, each with the frequent word it most likely stands for.

Who is near whom is found by scanning sorted lists of words. One word is compared with the words after it, letter by letter,
by three cells of the edit matrix (the band of one edit). Neighbours in a sorted list share a prefix, so the rows of the matrix
of their longest common prefix (LCP) are kept, and if a prefix is beyond one edit, all words that share it are passed over.

No list is the whole vocabulary. Let m be the length of the shorter of two near words, and e the place where they first
differ (0 to m). The places are cut into windows; a list has the words that agree before and behind a window, and a pair counts
in the one list whose window has its e. So each pair is found once, and a word is in a few lists. A list of more than CROWD
words (many words that share a long prefix and suffix) isn't scanned; its window is halved, again and again, down to one place.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted, slices

#: Letters of a word, as a class of a regular expression; only A-Z are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: One in so many (document, word) pairs loses a letter, by its hash.
ONE_IN = 31
#: Least letters and occurrences of a word, and how many times as frequent a form is.
LEAST_LETTERS, LEAST_TIMES, FORM_TIMES = 7, 2, 10
#: Windows of a word at first, as a power of two, and the most words of a list that isn't cut again.
LEVEL, CROWD = 2, 32
#: Distinct words that a task counts before it hands its counts on.
HELD = 400_000
#: Keys of crowded lists (8 bytes each) up to which they are broadcast; more are met by a shuffle.
FEW = 200_000


def words(text: str | None, doc_id: str, found: re.Pattern) -> Counter:
    """The words of a text with their counts, lower-cased and with the letters that hashes choose deleted."""
    raw: Counter = Counter()
    for run, n in Counter(found.findall(text or "")).items():
        raw[run.lower() if run.isascii() else run.translate(LOWER)] += n
    begun, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in raw.items():
        h = zlib.crc32(run.encode(), begun)
        if h % ONE_IN == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= LEAST_LETTERS:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of every word that occurs LEAST_TIMES times or more over all whole texts.

    Null texts have no words; a null id counts as the empty string where a letter is deleted. Repeated rows count again.
    """
    named = docs.select(F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit("")).alias("id"), F.col(quoted(text)).alias("text"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        found = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")  # shorter runs can't become words
        hand_on = lambda: pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, whole in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    held.update(words(whole, doc, found))
                    if len(held) > HELD:
                        yield hand_on()
                        held.clear()
        yield hand_on()

    counted = named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_TIMES)


def _windows(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` (``word``, ``n``, ``m`` and the window's number ``w`` of 2**level) as rows of lists, by ``key``.

    ``m`` is the length of the shorter word of a pair, the word's own or one less; ``span`` has the window's two ends.
    """
    start, end = f"(w * (m + 1L)) div {1 << level}", f"((w + 1) * (m + 1L)) div {1 << level}"
    cut = rows.withColumns({"start": F.expr(start), "end": F.expr(end)}).where("start < end")
    key = "xxhash64(m, start, end, substring(word, 1, int(start)), right(word, int(greatest(m - end, 0))))"
    return cut.select(F.expr(key).alias("key"), "word", "n", "m", "w", F.expr("shiftleft(start, 32) + end").alias("span"))


def near_in_list(listed: list[str], m: int, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in a sorted list whose words are one edit apart, the shorter one of ``m`` letters, first unlike in the window."""
    n = len(listed)
    shared = [0] * n  # with the word before
    for j in range(1, n):
        a, b = listed[j - 1], listed[j]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        shared[j] = k
    for i in range(n - 1):
        own = len(listed[i])
        q = "\0" + listed[i] + "\0\0\0"
        j, known = i + 1, shared[i + 1]
        first_unlike = known
        rows = [(1, 0, 1)] * (known + 1)  # what both share costs nothing
        while j < n:
            word, d = listed[j], known
            del rows[d + 1 :]
            x, y, z = rows[d]
            for c in word[d:]:
                left = min(y + 1, x + (c != q[d]))
                here = min(y + (c != q[d + 1]), z + 1, left + 1)
                right = min(z + (c != q[d + 2]), here + 1)
                x, y, z = left, here, right
                d += 1
                rows.append((x, y, z))
                if x > 1 and y > 1 and z > 1:
                    break
            else:
                longer = len(word) - own
                if -1 <= longer <= 1 and (z, y, x)[longer + 1] == 1 and start <= first_unlike < end and min(own, len(word)) == m:
                    yield i, j
                d += 1  # only this very word is left behind
            j += 1
            while j < n and shared[j] >= d:
                j += 1
            if j < n:
                known = shared[j]
                first_unlike = min(first_unlike, known)


def _scanned(lists: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (the most frequent near word, with its count) of every list's words that have one."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def judged(rows: pa.Table) -> pa.RecordBatch:
        key, span, m = (rows.column(c).to_numpy() for c in ("key", "span", "m"))
        turns = np.flatnonzero((key[1:] != key[:-1]) | (span[1:] != span[:-1]) | (m[1:] != m[:-1])) + 1
        starts, ends = np.concatenate(([0], turns)), np.concatenate((turns, [len(key)]))
        several = ends - starts > 1
        word, times = rows.column("word"), rows.column("n").to_numpy()
        out: dict[str, list] = {c: [] for c in schema.names}
        for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            listed, found = word.slice(s, e - s).to_pylist(), {}
            for pair in near_in_list(listed, int(m[s]), int(span[s]) >> 32, int(span[s]) & 0xFFFFFFFF):
                for a, b in (pair, pair[::-1]):
                    count, best = found.get(a, (0, None))
                    rank = (-int(times[s + b]), listed[b])
                    found[a] = count + 1, rank if best is None or rank < best else best
            for a, (count, best) in found.items():
                for name, value in zip(schema.names, (listed[a], count, -best[0], best[1]), strict=True):
                    out[name].append(value)
        return pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not len(rows):
                continue
            key = rows.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
            if whole:
                yield judged(rows.slice(0, whole).combine_chunks())
            rest = rows.slice(whole)
        if rest is not None and len(rest):
            yield judged(rest.combine_chunks())

    dealt = lists.select("key", "span", "m", "word", "n").repartition("key").sortWithinPartitions("key", "span", "m", "word")
    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")


def near_words(vocab: DataFrame) -> DataFrame:
    """``word``, ``n_near`` (how many words are near) and ``best_n``, ``best`` (the most frequent of them, ties: the least)."""
    roles = "array(bigint(length(word)), bigint(length(word)) - 1)"
    rows = vocab.select("word", "n", F.explode(F.expr(roles)).alias("m")).where(f"m >= {LEAST_LETTERS}")
    rows = rows.select("*", F.explode(F.expr(f"sequence(0L, {(1 << LEVEL) - 1}L)")).alias("w"))
    level, parts = LEVEL, []
    while True:
        lists = _windows(rows, level)
        sizes = lists.groupBy("key").agg(F.count("*").alias("size"), F.max(F.expr("(span & 4294967295) - shiftright(span, 32)")).alias("wide"))
        crowded = checkpointed(sizes.where(f"size > {CROWD} AND wide > 1").select("key"))
        many = crowded.count()
        if not many:
            parts.append(_scanned(lists))
            break
        crowded = F.broadcast(crowded) if many <= FEW else crowded
        parts.append(_scanned(lists.join(crowded, "key", "left_anti")))
        halves = F.explode(F.expr("array(2 * w, 2 * w + 1)")).alias("w")
        rows = checkpointed(lists.join(crowded, "key", "left_semi").select("word", "n", "m", halves))
        level += 1
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    found = reduce(DataFrame.union, parts).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word with the largest count (ties: the least in code-point order) if it occurs FORM_TIMES times as
    often, else null; ``root`` follows forms to the last one. No words, no rows.
    """
    vocab = checkpointed(vocabulary(docs, doc_id, text))
    joined = vocab.join(near_words(vocab), "word", "left")
    good = F.col("best_n") >= FORM_TIMES * F.col("n")
    out = checkpointed(joined.select(
        "word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best_n")).alias("form_n"),
    ))
    # counts grow tenfold from form to form, so a chain has a dozen words at most; each round doubles the step
    roots = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = checkpointed(roots)
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = roots.join(onward, "root", "left")
        if not met.where("further IS NOT NULL").limit(1).count():
            break
        roots = met.select("word", F.coalesce("further", "root").alias("root"))
    done = out.join(roots, "word", "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
