"""Quality classification: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

The model is fitted on a bounded sample of labelled rows (SAMPLE, the least hashes of their ids, so the choice is the same on
every run) and is a fixed number of weights. Scoring reads every whole text where it lies: a sum of weights per text, without
a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_texts, map_slices

#: Most labelled rows that the model is fitted on; documented bound of the sample.
SAMPLE = 6000
#: Hashed features, and passes over the sample.
DIMENSIONS, EPOCHS = 1 << 18, 5
#: Step size, its offset, and the two regularisations of the updates.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
#: Scores from here on are predicted to be good.
THRESHOLD = 0.3
#: What the values of a text's features add up to, whatever its length.
SCALE = 20.0
#: What every pair of equal tokens becomes.
DOUBLED = np.uint64(0x5851F42D4C957F2D)
TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+")


def features(text: str | None) -> np.ndarray:
    """Hashed features of the text's tokens and pairs of neighbours, repeats included.

    Tokens are runs of letters and digits and runs of other marks; case counts. A pair of equal tokens is one and the same
    feature whatever the token is.
    """
    tokens = TOKENS.findall(text.encode("utf-8", "surrogatepass")) if text else []
    one = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    one = (one + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[1:] >> np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)
    two[one[:-1] == one[1:]] = DOUBLED
    shift = np.uint64(64 - (DIMENSIONS.bit_length() - 1))
    return (np.concatenate((one, two)) >> shift).astype(np.int64)


def _row(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text as sparse row: distinct features and their share of all, scaled so that its length doesn't matter."""
    found = features(text)
    at, n = np.unique(found, return_counts=True)
    return at, SCALE * n / max(1, len(found))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights, and last the intercept, after EPOCHS passes of FTRL-proximal updates in the order given."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(at):
        bare = z[at]
        w = -(bare - np.sign(bare) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(bare) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for at, x, label in rows:
            at, x = np.append(at, DIMENSIONS), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(DIMENSIONS + 1))


def score(text: str | None, weights: np.ndarray) -> float:
    found = features(text)
    margin = weights[DIMENSIONS] + (SCALE * weights[found].sum(dtype=np.float64) / len(found) if len(found) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Fit on at most SAMPLE labelled rows that are not held out; without any, every weight is 0 and every score 0.5.

    Labels other than 0 and 1 are left aside. Of repeated labels of an id the least counts; of repeated rows of an id the text
    with the least hash is its one example, so that no id takes the place of others.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & (remainder(F.col(doc_id)) != 0))
        .groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = least_texts(texts)

    def work(part: pa.RecordBatch) -> dict:
        rows = [_row(t) for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "label": part.column("label"), "at": [a.astype(np.int32) for a, _ in rows], "x": [x.astype(np.float32) for _, x in rows]}

    kind = texts.schema["doc_id"].dataType.simpleString()
    sample = map_slices(texts, "text", work, f"doc_id {kind}, label int, at array<int>, x array<float>")
    ordered = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # in one partition

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            cuts = np.cumsum(pc.list_value_length(batch.column("at")).to_numpy())[:-1]
            at, x = (np.split(batch.column(c).flatten().to_numpy(), cuts) for c in ("at", "x"))
            rows += zip(at, x, batch.column("label").to_pylist(), strict=True) if batch.num_rows else ()
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).astype(np.float32).tobytes()], pa.binary())], ["weights"])

    # one model's training is sequential: one task fits it to the bounded sample, and the weights alone reach the driver
    made = ordered.mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(bytes(made[0].weights), np.float32) if made else np.zeros(DIMENSIONS + 1, np.float32)


def scored(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from THRESHOLD on) of every row.

    Null and empty texts have the score of the intercept alone. Equal texts have equal scores.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def work(part: pa.RecordBatch) -> dict:
        scores = [score(t, model.value) for t in part.column("text").to_pylist()]
        return {
            "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": scores,
            "predicted": [int(s >= THRESHOLD) for s in scores],
        }

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (remainder(F.col(doc_id)) == 0).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_slices(rows, "text", work, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be good, as they are."""
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    names = docs.columns

    def work(part: pa.RecordBatch) -> dict:
        good = pa.array([score(t, model.value) >= THRESHOLD for t in part.column(text).to_pylist()], pa.bool_())
        kept = part.filter(good)
        return {n: kept.column(n) for n in names}

    return map_slices(docs, text, work, docs.schema)
