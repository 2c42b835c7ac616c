"""Chunks, fingerprints and the order of documents against plain versions."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetmeter.llm import chunking, queries


def plain_cuts(data):
    ends, start = [], 0
    while start < len(data):
        if len(data) - start <= chunking.SHORTEST:
            ends.append(len(data))
            break
        end = min(start + chunking.LONGEST, len(data))
        for at in range(start + chunking.SHORTEST, end):
            h = 0
            for b in data[max(0, at - 32) : at]:
                h = (h * 2 + int(chunking.GEAR[b])) % (1 << 32)
            bits = chunking.STRICT_BITS if at < start + chunking.NORMAL else chunking.LOOSE_BITS
            if h >> (32 - bits) == 0:
                end = at
                break
        ends.append(end)
        start = end
    return ends


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2000), st.integers(1, 9))
def test_cuts(size, seed):
    data = bytes(random.Random(seed).choices(range(97, 97 + seed * 3), k=size))
    assert chunking.cuts(data) == plain_cuts(data) if data else True


def test_shift_resistance():
    r = random.Random(5)
    text = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(600))
    assert chunking.containment(chunking.fingerprint(text), chunking.fingerprint("some words before " + text)) > 0.9
    other = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(600))
    assert chunking.containment(chunking.fingerprint(text), chunking.fingerprint(other)) == 0
    half = chunking.containment(chunking.fingerprint(text), chunking.fingerprint(chunking.edited(text, other)))
    assert 0.4 < half < 0.6
    assert chunking.containment("", "") == 1 and chunking.containment("", chunking.fingerprint("a")) == 0


def plain(rows):
    """Documents in order, each with the next one; null ids last, equal ids in any order of equal outcome here."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, e, n = (chunking.fingerprint(t) for t in (text, changed, following))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, e, chunking.containment(a, e), chunking.containment(a, n)))
    return sorted(out, key=str)


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.queries()["op9_chunk_fingerprints"](spark, sf)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows)


def test_awkward_rows(documents):
    rows = [(1, None), (-5, ""), (3, "x"), (1 << 62, "ä" * 70_001), (-(1 << 63), "b" * 300), (2, " \n "), (9, "same"), (9, "same"), (None, "no id")]
    out = chunking.edit_report(documents([(i, t, "s") for i, t in rows])).collect()
    assert sorted(map(tuple, out), key=str) == plain(rows)


def test_one_row_and_none(documents):
    docs = documents([(1, "lone document here", "s")])
    assert sorted(map(tuple, chunking.edit_report(docs).collect())) == plain([(1, "lone document here")])
    assert chunking.edit_report(docs.limit(0)).collect() == []
