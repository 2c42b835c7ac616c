"""Fingerprints and groups against a plain version that compares all pairs."""

import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetmeter.llm import queries, simhash
from fleetmeter.llm.components import components


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def check(rows, out):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root = plain_components([f for _, f in prints])
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in prints), key=str)
    assert sorted(map(tuple, out), key=str) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÄ \n\x0b\x1c\x85z", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices(["ab", "cd", "ef", "gh"], k=5000))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == want


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.queries()["op2_simhash_near_dedup"](spark, sf)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    check(rows, out.collect())


def test_awkward_rows(documents):
    long = "lorem ipsum dolor " * 20_000
    rows = [(9, None), (8, ""), (7, " \n"), (None, "a b c d"), (3, "A B C D"), (3, "A B C D"), (5, "ä b"), (4, long), (2, long + "x")]
    docs = documents([(i, t, "s") for i, t in rows])
    check(rows, simhash.near_duplicates(docs).collect())
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.where("doc_id is not null").collect()) == [
        (False, i) for i in sorted({r.component_id for r in simhash.near_duplicates(docs).collect() if r.component_id is not None})
    ]
    assert kept.where("doc_id is null").count() == 1


def test_unlike_texts_of_one_id_are_judged_each(documents):
    r = random.Random(5)
    near, alone, other = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    docs = documents([(3, near, "s"), (5, near, "s"), (5, alone, "s"), (5, other, "s"), (5, other, "t"), (5, other, "t")])
    keep = simhash.without_near_duplicates
    kept = sorted((x["doc_id"], x["text"]) for x in keep(docs).collect())
    assert kept == sorted([(3, near), (5, alone), (5, other)])
    assert len({keep(docs.orderBy(by)).where(F.col("text") == other).first()["source"] for by in ("source", F.desc("source"))}) == 1


def test_clashing_names_and_maps(spark):
    rows = [(1, "a b c d", {"k": 1}, 7, 8, 9), (1, "a b c d", {"k": 1}, 7, 8, 9), (2, "a b c d", {"k": 2}, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` map<string,int>, node int, `_row` int, times int")
    assert [tuple(x) for x in simhash.without_near_duplicates(docs).collect()] == [rows[0]]


def test_empty_table(documents):
    docs = documents([(1, "a", "s")]).limit(0)
    assert simhash.near_duplicates(docs).collect() == [] and simhash.without_near_duplicates(docs).collect() == []


@pytest.mark.parametrize(("distance", "crowd"), [(2, 64), (2, 3), (3, 64), (3, 1), (1, 2), (0, 1), (4, 4)])
def test_links_connect_exactly_what_is_near(spark, monkeypatch, distance, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(distance)
    prints = {r.getrandbits(64) for _ in range(20)}
    for f in list(prints):  # chains within a segment and across segments, and near misses
        for n in (1, 2, 2, 3, 4):
            prints.add(f := f ^ sum(1 << b for b in r.sample(range(64), n)))
    half = r.getrandbits(32)  # a crowded segment: unlike fingerprints, and near ones among them
    prints |= {f for _ in range(8) for g in [r.getrandbits(32) << 32 | half] for f in (g, g ^ 1 << 40, g ^ 3 << 50, g ^ 1 << 33 ^ 1)}
    prints |= {1 << 63, 0, (1 << 64) - 1}
    signed = {f - (1 << 64) if f >> 63 else f: f for f in prints}
    found = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance)).collect()
    root = {f: f for f in prints} | {signed[a]: signed[b] for a, b in found}
    want = plain_components(prints, distance)
    groups = lambda by: sorted(sorted(f for f in prints if by[f] == g) for g in set(by.values()))
    assert groups(root) == groups(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 500 + i) for i in range(50)] + [(3, 3), (540, 900)]
    got = {a: b for a, b in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[500 + i] == 7 for i in range(50))
    assert got[900] == 7 and 3 not in got and 7 not in got
