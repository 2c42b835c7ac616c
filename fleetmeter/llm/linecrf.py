"""Quality rules: base counts of a text, and a linear-chain conditional random field over its lines.

Each line of a text with a word is content or boilerplate. The field has a weight per feature of a line and state, one for
neighbours of the same state and one for neighbours of two; Viterbi decoding gives the likeliest sequence, and the share of words on content lines decides
whether the text stays. The field is fitted by likelihood on a bounded sample of labelled texts, in which the lines of good
texts count as content and those of bad ones as boilerplate; a line that both kinds have gets a state by its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_texts, map_slices, words_of

#: Most labelled texts that the field is fitted on, and passes over them.
SAMPLE, EPOCHS = 3000, 6
#: Step size of the first pass, and the weight of the squared weights.
STEP, DECAY = 0.5, 1e-4
#: Base rules: fewest words, and the most percent of words in repeated windows of three.
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: Least share of words on content lines.
CONTENT_SHARE = 0.5
#: The marks counted as symbols.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
UPPER, LOWER, DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
#: Features of a line, in the order of ``measure``.
FEATURES = (
    "bias", "few symbols", "many symbols", "exclamations", "upper case", "digits", "ends a sentence", "few words",
    "many words", "copy of a line", "some repeats", "many repeats",
)


@dataclass
class Measured:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    words: np.ndarray  # of each line with a word
    features: np.ndarray  # a row per line with a word


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def _repeated(words: list[bytes]) -> np.ndarray:
    """Whether each word lies in a window of three words that the text has twice or more."""
    n = len(words)
    inside = np.zeros(n, bool)
    if n < 4:
        return inside
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, which, count = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    for shift in range(3):
        inside[shift : n - 2 + shift] |= twice
    return inside


def measure(text: str | None) -> Measured:
    data = (text or "").encode("utf-8", "surrogatepass")
    lines = [(line, words) for line in data.split(b"\n") if (words := line.split())]
    sizes = np.array([len(w) for _, w in lines], np.int64)
    words = [w for _, own in lines for w in own]
    repeated = _repeated(words)
    of_lines = np.add.reduceat(repeated, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64) if lines else sizes
    seen: set[bytes] = set()
    rows, n_symbols, copies = np.zeros((len(lines), len(FEATURES))), 0, 0
    for i, (line, own) in enumerate(lines):
        n, size = len(own), len(line)
        symbols = size - len(line.translate(None, SYMBOLS))
        upper, lower = size - len(line.translate(None, UPPER)), size - len(line.translate(None, LOWER))
        copy = line in seen
        seen.add(line)
        n_symbols += symbols
        copies += copy
        again = _share(of_lines[i], n)
        rows[i] = (
            1, 0 < symbols < 0.3 * n, symbols >= 0.3 * n, line.count(b"!") >= 0.2 * n, upper > lower,
            size - len(line.translate(None, DIGITS)) >= 0.2 * size, own[-1][-1:] in b".!?:;", n <= 3, n >= 30, copy,
            0.1 <= again < 0.5, again >= 0.5,
        )
    return Measured(
        len(words), len(text or "") - (len(data) - len(data.translate(None, WHITE))), n_symbols, copies,
        int(repeated.sum()), sizes, rows,
    )


def viterbi(features: np.ndarray, field: np.ndarray) -> list[int]:
    """The likeliest states (1: content); of equal ones content. ``field``: weights per state, then a row per state before."""
    emitted = (features @ field[:, : features.shape[1]].T).tolist()
    (stay0, to1), (to0, stay1) = field[:, features.shape[1] :].tolist()
    back, a, b = [], *emitted[0]
    for e0, e1 in emitted[1:]:
        from0, from1 = (a + stay0 > b + to0), (a + to1 > b + stay1)
        back.append((not from0, not from1))
        a, b = (a + stay0 if from0 else b + to0) + e0, (a + to1 if from1 else b + stay1) + e1
    states = [int(b >= a)]
    for step in reversed(back):
        states.append(int(step[states[-1]]))
    return states[::-1]


def _expected(features: np.ndarray, field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of each line and the summed probabilities of neighbouring states, by forward and backward sums."""
    k = features.shape[1]
    emitted, moves = features @ field[:, :k].T, field[:, k:]
    n = len(emitted)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = emitted[0]
    for i in range(1, n):
        ahead[i] = emitted[i] + np.logaddexp(ahead[i - 1, 0] + moves[0], ahead[i - 1, 1] + moves[1])
    for i in range(n - 2, -1, -1):
        after = emitted[i + 1] + behind[i + 1]
        behind[i] = np.logaddexp(moves[:, 0] + after[0], moves[:, 1] + after[1])
    total = np.logaddexp(*ahead[-1])
    states = np.exp(ahead + behind - total)
    pairs = np.zeros((2, 2))
    if n > 1:
        pairs = np.exp(ahead[:-1, :, None] + moves + (emitted[1:] + behind[1:])[:, None, :] - total).sum(axis=0)
    return states, pairs


def fit(texts: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """The field's weights: stochastic steps up the likelihood of the labelled texts, in the order given."""
    k = len(FEATURES)
    field, seen = np.zeros((2, k + 2)), np.full((2, k + 2), 1e-6)
    for _ in range(EPOCHS):
        for features, label in texts:
            if not len(features):
                continue
            states, pairs = _expected(features, field)
            given = np.zeros_like(states)
            given[:, label] = 1
            slope = np.zeros_like(field)
            slope[:, :k] = (given - states).T @ features / len(features)
            slope[:, k:] = -pairs / len(features)
            slope[label, k + label] += (len(features) - 1) / len(features)
            # staying in a state weighs the same in both, as does changing: else a long text's length would be a feature
            slope[:, k:] = (slope[:, k:] + slope[::-1, k:][:, ::-1]) / 2
            slope -= DECAY * field
            seen += slope * slope
            field += STEP * slope / np.sqrt(seen)
    return field


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Fit on at most SAMPLE labelled texts, those with the least hashes of their ids; without any every line is content.

    Of repeated rows of an id the text with the least hash is its one example.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = least_texts(texts)

    def work(part: pa.RecordBatch) -> dict:
        rows = [measure(t).features for t in part.column("text").to_pylist()]
        # a line's features are 0 or 1: one integer each
        packed = [(r.astype(np.int64) << np.arange(len(FEATURES))).sum(axis=1).astype(np.int32) for r in rows]
        return {"doc_id": part.column("doc_id"), "label": part.column("label"), "lines": packed}

    kind = texts.schema["doc_id"].dataType.simpleString()
    sample = map_slices(texts, "text", work, f"doc_id {kind}, label int, lines array<int>")
    ordered = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # in one partition

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _Packed()
        for batch in batches:
            lines = batch.column("lines")
            packed += [(x.values.to_numpy(), y) for x, y in zip(lines, batch.column("label").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(packed).tobytes()], pa.binary())], ["field"])

    # one model's training is sequential: one task fits it to the bounded sample, and the field alone reaches the driver
    made = ordered.mapInArrow(learn, "field binary").collect()
    return np.frombuffer(bytes(made[0].field)).reshape(2, -1) if made else fit([])


class _Packed(list):
    """Lines as one integer each with their label, unpacked a text at a time."""

    def __iter__(self):
        for lines, label in super().__iter__():
            yield (lines.astype(np.int64)[:, None] >> np.arange(len(FEATURES)) & 1).astype(float), label


def judge(text: str | None, field: np.ndarray) -> tuple[Measured, bool, float, bool]:
    """The measures, whether the base rules fail, the share of words on content lines (1 without words) and the verdict."""
    m = measure(text)
    failed = m.n_words < FEWEST_WORDS or 100 * m.n_repeat_words > MOST_REPEATED * m.n_words
    share = _share(int((np.array(viterbi(m.features, field)) * m.words).sum()), m.n_words) if m.n_words else 1.0
    return m, failed, share, not failed and share >= CONTENT_SHARE


def verdicts(docs: DataFrame, field: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept`` and ``content_share``.

    Null and empty texts have no words and fail. Lines end at \\n only; a line without a word counts for nothing. Texts are
    judged where they lie, one at a time.
    """

    def work(part: pa.RecordBatch) -> dict:
        found = [judge(t, field) for t in part.column("text").to_pylist()]
        out = {c: [getattr(m, c) for m, *_ in found] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        return out | {
            "doc_id": part.column("doc_id"), "base_failed": [f for _, f, _, _ in found], "kept": [k for *_, k in found],
            "content_share": [s for _, _, s, _ in found],
        }

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_slices(
        rows, "text", work,
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double",
    )


def content_lines(text: str | None, field: np.ndarray) -> list[str]:
    """The lines decoded as content, in order."""
    m = measure(text)
    if not m.n_words:
        return []
    lines = [line for line in (text or "").split("\n") if words_of(line)]
    return [line for line, state in zip(lines, viterbi(m.features, field), strict=True) if state]
