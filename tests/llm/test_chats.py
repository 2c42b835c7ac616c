"""Maximal conversations and their text against a plain version and against SQL."""

import random
import re

from compare import difference, duck

from fleetmeter.llm import chats, queries

DDL = "conv_id long, turn int, role string, text string, key string, part long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], DDL)


def plain(rows):
    """Conversations as sequences of distinct (role, text) rows by turn; maximal ones with copies, least id first."""
    convs = {}
    for conv, turn, role, text in set(rows):
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    seqs = {c: tuple(t[2:] for t in sorted(v, key=lambda t: t[:2])) for c, v in convs.items()}
    begun = {s[:i] for s in seqs.values() for i in range(1, len(s))}
    groups = {}
    for c, s in seqs.items():
        groups.setdefault(s, []).append(c)
    return {
        min((c for c in ids if c is not None), default=None): (s, len(ids)) for s, ids in groups.items() if s not in begun
    }


def joined(out):
    text, n, copies = {}, {}, {}
    for r in sorted(out, key=lambda r: r["part"]):
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["text"]
        n[r["conv_id"]] = n.get(r["conv_id"], 0) + r["n_turns"]
        copies[r["conv_id"]] = r["n_copies"]
    return {c: (text[c], n[c], copies[c]) for c in text}


def want(rows):
    clean = lambda s: s.replace("<|", "< |")
    line = lambda role, text: f"<|im_start|>{clean('unknown' if role is None else role)}\n{clean(text or '')}<|im_end|>\n"
    return {c: ("".join(line(*t) for t in s), len(s), k) for c, (s, k) in plain(rows).items()}


def test_given_table(spark, sf):
    name = "op10_chat_snapshots"
    assert difference(queries.queries()[name](spark, sf), duck(sf), queries.oracle_sql()[name]) is None
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert joined(queries.queries()[name](spark, sf).collect()) == want(rows)


def test_snapshots_copies_and_branches(spark):
    r = random.Random(2)
    rows, conv = [], 0
    for _ in range(25):
        whole = [(("user", "assistant")[i % 2], f"t{r.randrange(4)}") for i in range(r.randrange(1, 9))]
        for _ in range(r.randrange(1, 5)):
            first = r.choice((0, 1, 10))  # logs may count from anywhere
            rows += [(conv, first + i, *t) for i, t in enumerate(whole[: r.randrange(1, len(whole) + 1)])]
            conv += 1
    assert joined(chats.rendered(frame(spark, rows)).collect()) == want(rows)


def test_long_conversation_over_blocks(spark):
    long = [(1, i, "user", f"text {i}") for i in range(300)]
    rows = long + [(2, i, "user", f"text {i}") for i in range(130)] + [(3, i + 7, "user", f"text {i}") for i in range(64)] + [(4, 0, "user", "text 1")]
    out = chats.rendered(frame(spark, rows)).collect()
    assert joined(out) == want(rows) and max(r["n_turns"] for r in out) == 64
    assert sorted(joined(out)) == [1, 4]


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "no id"), (1, None, "system", "no turn"), (1, 0, None, None), (2, 0, "user", ""), (2, 0, "user", ""), (3, 0, "user", None),
        (4, -70, "user", "before"), (4, 2, "user", "a <|im_start|> b"), (5, 0, "", "x" * 200_000), (6, 0, "user", "no id"),
    ]
    got = joined(chats.rendered(frame(spark, rows)).collect())
    assert got == want(rows)
    assert got[6][2] == 2 and "< |im_start|>" in got[4][0]
    assert chats.rendered(frame(spark, rows).limit(0)).collect() == []


def test_repeated_and_null_turn_numbers_in_bounded_parts(spark, monkeypatch):
    rows = [(None, i % 21, "user", f"text {i}") for i in range(1500)] + [(1, None, "user", f"text {i}") for i in range(300)]
    rows += [(2, i % 21, "user", f"text {i}") for i in range(1500)] + [(3, None, "user", f"text {i}") for i in range(300)] + rows[:200]
    outs = []
    for cell in (chats.CELL, 16):
        monkeypatch.setattr(chats, "CELL", cell)
        sizes = chats._placed(frame(spark, rows)).groupBy("key", "cell").count().collect()
        assert max(r["count"] for r in sizes) <= 2 * cell
        outs.append(sorted(chats.rendered(frame(spark, rows)).collect(), key=str))
    assert outs[0] == outs[1] and max(r["n_turns"] for r in outs[0]) == chats.BLOCK
    got, turn = joined(outs[0]), {f"text {i}": i % 21 for i in range(1500)}
    assert {c: (n, copies) for c, (_, n, copies) in got.items()} == {2: (1500, 2), 1: (300, 2)}
    lines = re.findall("text [0-9]+", got[2][0])
    assert sorted(lines) == sorted(turn) and [turn[x] for x in lines] == sorted(turn.values())


def test_no_python_on_executors(spark, sf):
    plan = queries.queries()["op10_chat_snapshots"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
