"""Collocations against plain counting of all phrases, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import difference, duck
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetmeter.llm import phrases, queries


def plain(rows, least=10, share=50, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        drop = {q for p, c in candidates.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * c >= share * f[q]}
        found = []
        for p, a in candidates.items():
            if p not in drop:
                score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    want = plain(rows)
    out = queries.queries()["op11_phrase_collocations"](spark, sf)
    assert [t for _, t in out.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    assert got(out) == want and len(want) > 100


def test_sql(spark, sf):
    assert difference(queries.queries()["op11_phrase_collocations"](spark, sf), duck(sf), queries.oracle_sql()["op11_phrase_collocations"]) is None


@pytest.mark.parametrize(("budget", "held", "full"), [(1 << 20, 400_000, 8), (40, 50, 8), (1, 10, 1), (3, 3, 1)])
def test_groups_of_any_size(spark, monkeypatch, budget, held, full):
    """Small budgets deal most prefixes over several groups, and full groups again."""
    for name, value in (("SMALL", 1), ("HELD", held), ("HELD_WORDS", held), ("FULL", full)):
        monkeypatch.setattr(phrases, name, value)
    r = random.Random(budget)
    rows = []
    for lang in ("en", "de", None):
        for _ in range(12):
            words = r.choices(["the", "of", "Ab", "c\x01", "\x02", "é", "x-y", "the z"], weights=[9, 5, 3, 1, 1, 2, 2, 1], k=r.randrange(60))
            rows.append((lang, "".join(w + r.choice([" ", " ", " ", "\t ", ". ", "\n", ","]) for w in words)))
    rows += [("en", None), ("en", ""), (None, " .. "), ("xx", "a a a a a A a a"), ("zz", "one two")]
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "lang string, text string, f long, phrase string").repartition(3)
    assert got(phrases.collocations(docs, least=2, top=20, budget=budget)) == plain(rows, least=2, top=20)


def test_empty_table(spark):
    assert got(phrases.collocations(spark.createDataFrame([], "lang string, text string"))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=3), max_size=30), st.booleans())
def test_totals_of_leaves(leaves, partial):
    want = Counter()
    for x in leaves:
        want.update(tuple(x[:k]) for k in range(2, len(x) + 1))
    want = {p: n for p, n in want.items() if n >= 2 or partial and len(p) == 2}
    path = np.array([x + [0] * (3 - len(x)) for x in leaves], np.int64).reshape(-1, 3).T
    found = phrases.subtree_counts(*phrases.summed(path, np.ones(len(leaves), np.int64)), 2, partial)
    assert {tuple(p): n for p, n in found} == want


@given(st.lists(st.lists(st.binary(min_size=1, max_size=3).filter(lambda b: b"\n" not in b), min_size=1, max_size=3), min_size=1, max_size=9))
def test_leaves_are_packed_whole(leaves):
    words = sorted({w for x in leaves for w in x})
    path = np.array([[words.index(w) + 1 for w in x] + [0] * (3 - len(x)) for x in leaves], np.int64).T
    times = np.arange(1, len(leaves) + 1) * 10**10
    which = np.arange(0, len(leaves), 2)
    got = phrases.Leaves.unpacked(*phrases.Leaves(words, path, times).packed(which))
    read = [tuple(got.words[i - 1] for i in p if i) for p in got.path.T.tolist()]
    assert read == [tuple(leaves[i]) for i in which] and got.times.tolist() == times[which].tolist()
