"""Removed words against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from fleetmeter.llm import queries, substrings


def plain(texts):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def check(docs, out=None):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted([(i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows]))], key=str)
    got = sorted(map(tuple, (out or substrings.digests(docs)).collect()), key=str)
    assert got == want
    return got


def test_given_table(spark, sf):
    out = queries.queries()["op5_substring_dedup"](spark, sf)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = check(spark.read.parquet(f"{sf}/documents.parquet"), out)
    assert any(0 < r[2] < r[1] for r in got)


@pytest.mark.parametrize("salted", [1 << 16, 4])
def test_passages_of_every_length_and_place(documents, monkeypatch, salted):
    monkeypatch.setattr(substrings, "SALTED", salted)
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the"] * 20

    def some(n):
        return r.choices(words, k=n)

    passages = [some(n) for n in (34, 35, 36, 50, 90, 200)]
    rows = []
    for i in range(160):
        text = some(r.randrange(0, 80))
        for p in r.sample(passages, r.randrange(0, 3)):
            cut = p[r.randrange(0, 3) : len(p) - r.randrange(0, 3)]
            text += cut + some(r.randrange(0, 40))
        if i % 9 == 0:  # copies with one word changed
            text = list(rows[-1][1].split()) if rows else text
            if text:
                text[r.randrange(len(text))] = "other"
        rows.append((i, " ".join(text), "s"))
    got = check(documents(rows))
    assert sum(1 for g in got if g[2]) > 40


def test_awkward_rows(documents):
    loop, ab = "a " * 60, "a b " * 60
    long = " ".join(str(i) for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t"), (4, loop), (5, ab), (6, " ".join(map(str, range(34)))), (7, long), (7, long),
        (None, "x " + long), (None, None), (8, " ".join(f"u{i}" for i in range(70))), (9, "ä ö " * 40),
        (10, " ".join(f"u{i}" for i in range(20, 55))),
    ]
    check(documents([(i, t, "s") for i, t in rows]))


def test_empty_table(documents):
    docs = documents([(1, "a", "s")]).limit(0)
    assert substrings.digests(docs).collect() == [] and substrings.deduplicated(docs).collect() == []


def test_rows_after_the_cut(documents):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = documents([(1, f"one\n{passage} end", "s"), (2, f"two {passage}", "s"), (3, " kept  as\tit is ", "s"), (4, None, "s")])
    out = substrings.deduplicated(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {
        1: ("one end", 7), 2: ("two", 3), 3: (" kept  as\tit is ", 16), 4: (None, None)
    }


def test_long_passages_become_one_span_each(documents):
    passage = [f"p{i}" for i in range(3000)]
    rows = [(i, " ".join([f"a{i}_{j}" for j in range(40)] + passage + [f"b{i}_{j}" for j in range(40)]), "s") for i in range(4)]
    docs = documents([*rows, (9, " ".join(passage[500:900]), "s")])
    check(docs)
    keyed = substrings._keyed(docs, "doc_id", "text")
    found = {r.doc_id: sorted(map(tuple, r.spans)) for r in keyed.join(substrings.spans(keyed), ["k1", "k2"]).collect()}
    # paths end where document 9's text begins and ends; each has about 200 runs of windows
    whole = {i: [s for s in found[i] if s[2] is not None] for i in range(4)}
    assert all(len(w) <= 8 and max(e - s for s, e, _ in w) > 1500 for w in whole.values())
    assert all(sum(e - s > 300 for s, e, _ in w) <= 4 for w in whole.values())


def test_circles_are_a_row_each(documents):
    """Texts that repeat a line, alone, beside other words, with a broken lap, and with a circle of many words."""
    line, wide = "is one. " * 300, " ".join(f"c{i}" for i in range(45)) + " "
    rows = [(i, f"{' '.join(f'a{i}_{j}' for j in range(i * 9))} {line} {' '.join(f'b{i}_{j}' for j in range(i * 7))}", "s") for i in range(8)]
    rows += [(20, line * 2, "s"), (21, "is one. " * 20 + "odd " + line, "s"), (22, "w x y " * 40, "s"), (23, wide * 3, "s"), (24, "z y x " * 12, "s")]
    docs = documents(rows)
    assert sum(1 for g in check(docs) if g[2]) == 12
    lone = substrings.paths([line])
    assert len(lone["row"]) <= 3 and lone["laps"].sum() > 250
    found = substrings._occurrences(substrings._keyed(docs, "doc_id", "text"))
    assert found.count() < 250 < 2500 < found.agg({"laps": "sum"}).first()[0]


def test_a_span_unlike_its_source_stays():
    words = " ".join(f"w{i}" for i in range(50))
    same = substrings.digest(words.encode().split(), 5, 45)
    assert substrings.kept_words(words, [{"start": 5, "end": 45, "digest": same}])[1] == 40
    assert substrings.kept_words(words, [{"start": 6, "end": 46, "digest": same}])[1] == 0
    assert substrings.kept_words(words, [{"start": 0, "end": 35, "digest": None}])[1] == 35
