"""Spelling variants against a plain version that looks up every deletion and replacement."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetmeter.llm import queries, spelling


def plain_words(rows):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[k, w[:k], w[k + 1 :]].add(w)
            if (less := w[:k] + w[k + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
    for some in holes.values():
        for w in some:
            near[w] |= some - {w}
    return near


def plain(rows):
    n = plain_words(rows)
    near, form = plain_near(set(n)), {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near.get(w, ())), n.get(form.get(w))))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert got(queries.queries()["op12_spelling_variants"](spark, sf)) == want and any(r[1] for r in want)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=2, max_size=6), max_size=40), st.integers(1, 6), st.integers(0, 3), st.integers(1, 7))
def test_scan_of_a_sorted_list(words, m, start, end):
    listed = sorted(words)
    near = plain_near(words)

    def lcp(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = {
        (i, j) for i, a in enumerate(listed) for j, b in enumerate(listed)
        if i < j and b in near[a] and min(len(a), len(b)) == m and start <= lcp(a, b) < end
    }
    found = list(spelling.near_in_list(listed, m, start, end))
    assert set(found) == want and len(found) == len(want)


@pytest.mark.parametrize(("crowd", "level"), [(1, 0), (2, 2), (32, 2)])
def test_crowded_lists_are_cut(spark, monkeypatch, crowd, level):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "LEVEL", level)
    monkeypatch.setattr(spelling, "FEW", 5)
    r, words = random.Random(crowd), set()
    for base in ("aaaaaaa", "commonprefixword", "x" * 40, "abcdefgé"):
        for _ in range(60):
            w = list(base)
            for _ in range(r.randrange(3)):
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = r.choice(["", "a", "b", "é", "xy"])
            words.add("".join(w))
    words = {w for w in words if len(w) >= 7}
    vocab = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    near = plain_near(words)
    found = {x["word"]: (x["n_near"], x["best"]) for x in spelling.near_words(vocab).collect()}
    assert found == {w: (len(s), min(s)) for w, s in near.items() if s}


def test_awkward_rows(documents):
    many = " ".join(["spelling"] * 1000 + ["spellingx"] * 90 + ["spellingxy"] * 8 + ["Über" + "ÄÖ×" * 9] * 3 + ["z" * 3000] * 2)
    rows = [(None, many), (1, None), (2, ""), (2, many + "1speling " * 2), (2, many), (3, " \x00 ")]
    assert got(spelling.variants(documents([(i, t, "s") for i, t in rows]))) == plain(rows)
    assert got(spelling.variants(documents([(1, "a", "s")]).limit(0))) == []
