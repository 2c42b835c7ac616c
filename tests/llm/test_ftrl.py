"""Held-out accuracy, the fixed sample, and awkward tables."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetmeter.llm import ftrl, queries


def test_held_out_accuracy(spark, sf):
    sf = os.path.join(os.path.dirname(sf), "sf0.01")  # the smallest table has three bad held-out rows
    out = queries.queries()["op7_ftrl_quality"](spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    test = [i for i in label if rows[i]["held_out"]]
    assert all(rows[i]["predicted"] for i in test if label[i])
    assert sum(rows[i]["predicted"] == label[i] for i in test) >= 0.95 * len(test)


def test_training_leaves_out_what_is_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - quality, quality) AS quality")
    assert np.array_equal(ftrl.train(docs, labels), ftrl.train(docs, turned))


def test_updates_against_the_closed_form():
    """One example: the weight is the closed form of the accumulated slope."""
    at, x = np.array([3]), np.array([2.0])
    epochs, ftrl.EPOCHS = ftrl.EPOCHS, 1
    try:
        w = ftrl.fit([(at, x, 1)])
    finally:
        ftrl.EPOCHS = epochs
    slope = (0.5 - 1) * 2.0
    assert w[3] == pytest.approx(-(slope + ftrl.L1) / ((ftrl.BETA + abs(slope)) / ftrl.ALPHA + ftrl.L2))
    assert np.count_nonzero(w) == 2


def test_awkward_rows(documents, spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 100_000), (None, "a b"), (6, "same"), (6, "same"), (7, "Ünï çødé \U0001f600")]
    rows += [(100 + i, "fine words here" if i % 2 else "bad&&& words%%%") for i in range(60)]
    docs = documents([(i, t, "s") for i, t in rows])
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(60)] + [(1, None), (None, 0), (2, 7), (101, 1)], "doc_id long, quality int")
    weights = ftrl.train(docs, labels)
    out = ftrl.scored(docs, weights).collect()
    assert len(out) == len(rows)
    score = {r["doc_id"]: r["score"] for r in out}
    assert score[1] == score[2] == score[3] and score[101] > 0.7 > 0.3 > score[100]
    kept = ftrl.accepted(docs, weights)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id >= 100").collect()) == list(range(101, 160, 2))
    none = ftrl.train(docs, labels.limit(0))
    assert not none.any() and {r["score"] for r in ftrl.scored(docs, none).collect()} == {0.5}
    assert ftrl.scored(docs.limit(0), weights).collect() == [] and ftrl.accepted(docs.limit(0), weights).collect() == []


def test_sample_bound(documents, spark, monkeypatch):
    monkeypatch.setattr(ftrl, "SAMPLE", 10)
    docs = documents([(i, f"word{i}", "s") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert 10 <= np.count_nonzero(ftrl.train(docs, labels)) <= 11


def test_a_hot_id_leaves_other_labels_their_place(documents, spark, monkeypatch):
    monkeypatch.setattr(ftrl, "SAMPLE", 20)
    rows = [(i, "This is a line, and it ends." if i % 2 else "x&&& y%%% z***") for i in range(1, 21)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    once = ftrl.train(documents([(i, t, "s") for i, t in rows]), labels)
    hot = labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 != 0").orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    many = ftrl.train(documents([(i, t, "s") for i, t in rows for _ in range(100 if i == hot else 1)]), labels)
    assert once.any() and np.array_equal(once, many)
