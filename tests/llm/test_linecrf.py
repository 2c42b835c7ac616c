"""Base counts against a plain version, decoding and learning against enumeration, verdicts against labels."""

import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetmeter.llm import linecrf, queries


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(inside),
    )


def counts(m):
    return m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab#| \n\t\x0b\x85é", max_size=80))
def test_counts(text):
    assert counts(linecrf.measure(text)) == plain(text)


def test_decoding_is_the_best_sequence():
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 9):
        features, field = r.integers(0, 2, (n, len(linecrf.FEATURES))).astype(float), r.normal(size=(2, len(linecrf.FEATURES) + 2))
        k = features.shape[1]

        def worth(s):
            return sum(features[i] @ field[x, :k] for i, x in enumerate(s)) + sum(field[a, k + b] for a, b in zip(s, s[1:]))

        every = list(itertools.product((0, 1), repeat=n))
        assert worth(linecrf.viterbi(features, field)) >= max(map(worth, every)) - 1e-9
        total = sum(np.exp(worth(s)) for s in every)
        states, pairs = linecrf._expected(features, field)
        for i in range(n):
            assert np.isclose(states[i, 1], sum(np.exp(worth(s)) for s in every if s[i]) / total)
        assert np.isclose(pairs[1, 0], sum(np.exp(worth(s)) * sum(p == (1, 0) for p in zip(s, s[1:])) for s in every) / total)


def test_verdicts_follow_the_labels(spark, sf):
    out = queries.queries()["op8_line_crf_rules"](spark, sf)
    assert out.columns[:8] == [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    ]
    found = {r["doc_id"]: r for r in out.collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert found.keys() == docs.keys()
    for i, r in found.items():
        want = plain(docs[i])
        assert tuple(r[c] for c in out.columns[1:6]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    judged = [i for i in label if not found[i]["base_failed"]]
    assert sum(found[i]["kept"] == label[i] for i in judged) >= 0.97 * len(judged)
    assert all(found[i]["kept"] for i in judged if label[i])


def test_awkward_rows(documents, spark):
    good, bad = "This is a line, and it ends.\n" + "Word after word " * 3 + "here it is.", "A&&& B%%% C### D***\nBUY!! NOW!! HERE!!"
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "x " * 60_000), (5, "\n".join(f"a{i} b{i} c{i} d{i} e{i}." for i in range(20_000)))]
    rows += [(None, good), (7, "a\n\na\nb \nb"), (7, "a\n\na\nb \nb")] + [(10 + i, (good, bad)[i % 2] + f" {i}") for i in range(40)]
    docs = documents([(i, t, "s") for i, t in rows])
    labels = spark.createDataFrame(
        [(10 + i, 1 - i % 2) for i in range(40)] + [(7, None), (None, 1), (8, 5), (10, 1)], "doc_id long, quality int"
    )
    out = linecrf.verdicts(docs, linecrf.train(docs, labels)).collect()
    assert len(out) == len(rows)
    assert not any(r["kept"] for r in out if r["doc_id"] in (1, 2, 3, 4, 7))
    assert next(r["kept"] for r in out if r["doc_id"] == 5)
    assert linecrf.verdicts(docs.limit(0), linecrf.train(docs.limit(0), labels.limit(0))).collect() == []


def test_content_lines():
    r, k = random.Random(1), len(linecrf.FEATURES)
    texts = [("\n".join("word " * r.randrange(4, 9) + "end." for _ in range(5)), 1) for _ in range(60)]
    texts += [("\n".join("x&&& " * 6 for _ in range(5)), 0) for _ in range(60)]
    r.shuffle(texts)
    field = linecrf.fit([(linecrf.measure(t).features, y) for t, y in texts])
    assert field.shape == (2, k + 2)
    assert linecrf.content_lines("A line that has words.\n\nAnd one more, it ends.", field) == ["A line that has words.", "And one more, it ends."]
    assert linecrf.content_lines("x&&& y&&&\nz&&& w%%%", field) == [] == linecrf.content_lines(None, field)


def test_a_hot_id_leaves_other_labels_their_place(documents, spark, monkeypatch):
    monkeypatch.setattr(linecrf, "SAMPLE", 20)
    rows = [(i, "This is a line, and it ends." if i % 2 else "x&&& y%%% z***") for i in range(1, 21)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    once = linecrf.train(documents([(i, t, "s") for i, t in rows]), labels)
    hot = labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 != 0").orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    many = linecrf.train(documents([(i, t, "s") for i, t in rows for _ in range(100 if i == hot else 1)]), labels)
    assert once.any() and np.array_equal(once, many)


def test_only_the_field_reaches_the_driver(documents, spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self):
        raise AssertionError("lines reach the driver")

    monkeypatch.setattr(DataFrame, "toArrow", refuse)
    rows = [(i, "\n".join(["This is a line, and it ends.", "x&&& y%%% z***"][i % 2] + f" {k}" for k in range(1 + i))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = documents([(i, t, "s") for i, t in rows])
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want = linecrf.fit([(linecrf.measure(rows[i][1]).features, 1 - i % 2) for i in order])
    assert np.allclose(linecrf.train(docs, labels), want)
