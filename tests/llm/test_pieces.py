"""Sampled segmentations against enumeration; encoding and decoding against the library; awkward rows."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetmeter.llm import pieces, queries

BYTES = [f"<0x{b:02X}>" for b in range(256)]
WORDS = ["▁", "a", "b", "▁a", "ab", "ba", "aa", "aba", "▁ab", "bb"]
LOGS = np.log(np.array([5, 8, 6, 4, 3, 2, 2, 1, 1, 2]) / 34)
TINY = pieces.Vocabulary(["<unk>", *BYTES, *WORDS], np.concatenate((np.full(257, -np.inf), LOGS)), list(range(1, 257)))
REAL = pieces.Vocabulary.load()


def every(vocabulary, text):
    """All segmentations with their probabilities, by recursion."""
    known = {p: (i, math.exp(w)) for i, (p, w) in enumerate(zip(vocabulary.pieces, vocabulary.logs, strict=True)) if w > -math.inf}
    marked = "▁" + text.replace(" ", "▁")
    found = {}

    def walk(at, ids, p):
        if at == len(marked):
            found[tuple(ids)] = found.get(tuple(ids), 0) + p
            return
        for size in range(1, 4):
            piece = marked[at : at + size]
            if len(piece) == size and piece in known:
                walk(at + size, [*ids, known[piece][0]], p * known[piece][1])
        if marked[at] not in known:
            walk(at + 1, ids + [vocabulary.byte_ids[b] for b in marked[at].encode()], p * math.exp(vocabulary.byte_log) ** len(marked[at].encode()))

    walk(0, [], 1.0)
    total = sum(found.values())
    return {k: p / total for k, p in found.items()}


@pytest.mark.parametrize("text", ["a", "ab", "aba b", "é\nab", "abab ba"])
def test_samples_are_segmentations_with_their_probability(text):
    want = every(TINY, text)
    for paths in pieces.sample(TINY, [text] * 40, [str(i) for i in range(40)], samples=4):
        ids = [tuple(p["ids"].tolist()) for p in paths]
        assert len(set(ids)) == len(ids) == min(4, len(want))
        assert all(math.isclose(p["log_prob"], math.log(want[k]), abs_tol=1e-9) for k, p in zip(ids, paths, strict=True))
        values = [p["perturbed"] for p in paths]
        assert values == sorted(values, reverse=True)
        assert all(0 < p["inclusion"] <= 1 for p in paths) and (len(want) > 4 or all(p["inclusion"] == 1 for p in paths))
        assert all(TINY.decode(p["ids"].tolist()) == text for p in paths)


def test_draws_follow_sampling_without_replacement():
    text, n = "ab a", 20_000
    want = every(TINY, text)
    first, both = Counter(), Counter()
    for paths in pieces.sample(TINY, [text] * n, [str(i) for i in range(n)], samples=2):
        a, b = (tuple(p["ids"].tolist()) for p in paths)
        first[a] += 1
        both[a, b] += 1
    for k, p in want.items():
        assert abs(first[k] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1
    for a, b in itertools.permutations(want, 2):
        p = want[a] * want[b] / (1 - want[a])
        assert abs(both[a, b] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1


def test_inclusion_scores_are_unbiased_weights():
    """Summing probability over inclusion estimates 1, whatever the number of samples."""
    text, n = "abab ba", 4000
    sums = [
        sum(math.exp(p["log_prob"]) / p["inclusion"] for p in paths)
        for paths in pieces.sample(TINY, [text] * n, [str(i) for i in range(n)], samples=3)
    ]
    assert abs(np.mean(sums) - 1) < 5 * np.std(sums) / math.sqrt(n)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_round_trip(texts):
    for text, paths in zip(texts, pieces.sample(REAL, texts, [str(len(t)) for t in texts], samples=3), strict=True):
        assert all(REAL.decode(p["ids"].tolist()) == text for p in paths)
        assert len({tuple(p["ids"].tolist()) for p in paths}) == len(paths)


def test_rows_do_not_depend_on_their_company():
    r = random.Random(1)
    texts = [" ".join(r.choices(["the", "thought", "unlikely", "x\ny", "Zürich"], k=r.randrange(0, 30))) for _ in range(20)]
    keys = [str(i) for i in range(20)]
    together = pieces.sample(REAL, texts, keys, samples=3)
    alone = [pieces.sample(REAL, [t], [k], samples=3)[0] for t, k in zip(texts, keys, strict=True)]
    assert str(together) == str(alone)
    assert str(pieces.sample(REAL, texts, keys, samples=1)) != str([a[:1] for a in alone])  # thresholds differ
    assert [p[0]["ids"].tolist() for p in pieces.sample(REAL, texts, keys, samples=1)] == [a[0]["ids"].tolist() for a in alone]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n▁é", max_size=20))
def test_keys_are_the_chunks_in_short(text):
    for vocabulary in (TINY, REAL):
        keys = vocabulary.keys(text)
        assert [k[1:] if k[0] == "\n" else "▁" + k for k in keys] == vocabulary.chunks(text)


def test_cuts_only_between_words():
    odd = pieces.Vocabulary(["<unk>", "a▁b", "a", "b", "▁"], np.array([-np.inf, -1, -1, -1, -1.0]), [0] * 256)
    assert odd.chunks("a b\na") == ["▁a▁b\na"] and TINY.chunks("a  b\na") == ["▁a", "▁▁b", "\n", "a"]


def test_given_table(spark, sf):
    out = queries.queries()["op6_gumbel_segmentations"](spark, sf)
    rows = out.collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == 2 * len(docs) and all(r["round_trip"] for r in rows)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        assert r["n_pieces"] == len(r["ids"])
    for i, text in list(docs.items())[:60]:
        one, two = sorted(by[i], key=lambda r: r["sample"])
        assert one["ids"] != two["ids"] and one["perturbed"] > two["perturbed"]
        assert library.decode(one["ids"]) == text == library.decode(two["ids"])


def test_awkward_rows(documents):
    long = "word " * 30_000
    rows = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, long), (5, "same"), (5, "same"), (6, "x" * 3000), (7, "▁ \U0001f600 \t\x00\n\n")]
    out = pieces.segmentations(documents([(i, t, "s") for i, t in rows])).collect()
    assert all(r["round_trip"] for r in out)
    ids = {}
    for r in out:
        ids.setdefault(r["doc_id"], []).append(r["ids"])
    assert ids[1] == ids[2] == [[]] and len(ids[4]) == 2 and len(ids[5]) == 4 and len({str(x) for x in ids[5]}) == 2
    assert pieces.segmentations(documents([(1, "a", "s")]).limit(0)).collect() == []


def test_library_encoding_and_decoding(documents):
    rows = [(1, None), (2, ""), (3, "two words\n\nand é \U0001f600"), (4, "  spaces  ")]
    docs = documents([(i, t, "s") for i, t in rows])
    coded = pieces.encoded(docs)
    assert coded.columns == [*docs.columns, "ids"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: None if t is None else library.encode(t) for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(coded.drop("text")).collect()} == dict(rows)


def test_trie_by_hash_and_many_round_trips():
    """Hashed steps lead where the sorted keys do; ids are compared to many texts at once as one by one."""
    v = pieces.Vocabulary.load()
    keys, nodes, _, _ = v.trie
    asked = np.concatenate((keys, np.arange(0, int(keys[-1]), 997, dtype=keys.dtype)))
    at = np.searchsorted(keys, asked)
    assert np.array_equal(v.nodes_at(asked), np.where(keys[at] == asked, nodes[at], 0))
    texts = ["", " ", "plain words", "▁ raw", "line\nend\n", "ä \U0001f600 �", "\x00"]
    wrong = ["x", "", "plain word", " raw", "line end\n", "ä", ""]
    ids = [np.array(s["ids"], np.int64) for t in texts for s in pieces.sample(v, [t], ["k"], 1)[0]]
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
    values = np.concatenate(ids).astype(np.int32)
    for given in (texts, wrong):
        assert v.same(given, values, offsets) == [v.decode(i.tolist()) == t for i, t in zip(ids, given, strict=True)]
    assert v.same([""], values[:0], np.zeros(2, np.int32)) == [True]
