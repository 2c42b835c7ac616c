"""Targets and thresholds of the mix, against plain Python and on awkward tables."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetmeter.llm import mixing, queries


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights, most):
    """Targets by repeated resharing: whoever is above the cap stops there, the rest share what is left."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        got = {s: most * sizes[s] if s in capped else left * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in capped and got[s] > most * sizes[s] + 1e-9}
        if not over:
            return got
        capped |= over


def check(rows, out):
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += count(text)
        largest[source] = max(largest[source], count(text))
    want = fill(sizes, (5, 2, 1), 3)
    for r in out:
        assert r["size"] * 3 >= r["taken"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= largest[s] / 2 + 1e-6


def run(docs):
    mix = mixing.plan(docs)
    return mixing.with_mix(docs, mix).select("doc_id", "source", "_mix.*").collect()


def test_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    check(rows, run(docs))


def test_small_and_awkward_rows(documents):
    long = "w " * 50_000
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "b"), (None, "x y z", None), (4, "eins zwei", "ä"), (5, long, "b")]
    rows += [(100 + i, "p q r s", "c") for i in range(40)] + [(7, "same row here", "d")] * 30
    docs = documents(rows)
    out = run(docs)
    assert len(out) == len(rows)
    sizes = {r["doc_id"]: r["size"] for r in out}
    assert sizes[1] == sizes[2] == sizes[3] == 0 and sizes[5] == 50_000 and sizes[None] == 3
    same = [r["taken"] for r in out if r["doc_id"] == 7]
    assert len(same) == 30 and len(set(same)) == 1
    for s in ("a", "b", "c", "ä"):
        n = sum(r["taken"] for r in out if r["source"] == s)
        target = next(r["target"] for r in out if r["source"] == s)
        assert abs(n - target) <= max(r["size"] for r in out if r["source"] == s) / 2 + 1e-6


def test_rows_follow_the_copies(documents):
    docs = documents([(i, "a b c", f"s{i % 4}") for i in range(200)])
    mix = mixing.plan(docs)
    copies = {r["doc_id"]: r["copies"] for r in mixing.with_mix(docs, mix).select("doc_id", "_mix.copies").collect()}
    out = mixing.mixed(docs, mix)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}


def test_runs_agree_and_budgets_nest(documents):
    docs = documents([(i, "a " * (1 + i % 9), "s") for i in range(300)] + [(1000 + i, "b " * 40, "t") for i in range(90)])
    one, two = (sorted((r["doc_id"], r["taken"]) for r in run(docs)) for _ in range(2))
    assert one == two
    small = mixing.with_mix(docs, mixing.plan(docs, weights=(1, 9), most=9)).where("_mix.copies > 0 and source = 's'")
    large = mixing.with_mix(docs, mixing.plan(docs, weights=(4, 9), most=9)).where("_mix.copies > 0 and source = 's'")
    assert small.select("doc_id").subtract(large.select("doc_id")).isEmpty()
    assert 0 < small.count() < large.count()


def test_empty_table(documents):
    docs = documents([(1, "a", "s")]).limit(0)
    assert run(docs) == [] and mixing.mixed(docs, mixing.plan(docs)).count() == 0


def test_salted_join_gives_the_same(documents, monkeypatch):
    docs = documents([(i, "a b " * (i % 7), f"s{i % 5}") for i in range(120)])
    want = sorted(map(str, run(docs)))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, run(docs))) == want


def test_word_count_matches_python(spark):
    from fleetmeter.llm.common import word_count

    texts = ["", " ", "a", " a ", "a b c\x0bd\x1ce", " x y\r\nz\t", None, "\U0001f600 \U0001f600"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [count(t) for t in texts]
    assert math.isfinite(sum(r[0] for r in got))


def test_query_columns(spark, sf):
    assert queries.queries()["op1_mix_sources"](spark, sf).columns == ["doc_id", "size", "source_size", "target", "taken"]
