"""Each stage against its plain version, on all that the stage before kept."""

import re
from collections import Counter

import test_mixing
import test_simhash

import corpus_pipeline
from fleetmeter.llm import ftrl

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut(texts):
    """Texts without the words of repeated windows of 35; a text that loses none stays as it is."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for t, w in zip(texts, split, strict=True):
        gone = {i + k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(35)}
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone) if gone else t)
    return out


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{n}")
        seen.append(spark.read.parquet(f"{tmp_path}/{n}"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "mix", "segment"]
    assert all(d.columns == COLUMNS for d in seen[:-1])
    rows = [{r["doc_id"]: r for r in d.collect()} for d in seen[:4]]

    weights = ftrl.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rows[1] == {i: r for i, r in rows[0].items() if ftrl.score(r["text"], weights.astype("float32")) >= 0.3}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(i in rows[1] for i in label if label[i]) and len(rows[1]) < len(rows[0])

    prints = {i: test_simhash.plain_fingerprint(r["text"]) for i, r in rows[1].items()}
    root = test_simhash.plain_components(list(prints.values()))
    least = {}
    for i in sorted(prints):
        least.setdefault(root[prints[i]], i)
    assert rows[2] == {i: rows[1][i] for i in least.values()} and len(rows[2]) < len(rows[1])

    want = dict(zip(rows[2], cut([r["text"] for r in rows[2].values()]), strict=True))
    assert {i: r["text"] for i, r in rows[3].items()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["source"] == rows[2][i]["source"] for i, r in rows[3].items())

    taken = Counter(r["doc_id"] for r in seen[4].collect())
    size = lambda r: test_mixing.count(r["text"])
    total = Counter()
    largest = Counter()
    for r in rows[3].values():
        total[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    got = Counter()
    for i, n in taken.items():
        assert 1 <= n <= 3
        got[rows[3][i]["source"]] += n * size(rows[3][i])
    for s, target in test_mixing.fill(dict(total), (5, 2, 1), 3).items():
        assert abs(got[s] - target) <= largest[s] / 2 + 1e-6

    last = seen[5].collect()
    assert all(r["round_trip"] for r in last)
    assert {r["doc_id"] for r in last} == set(taken)
    assert Counter(r["doc_id"] for r in last if r["sample"] == 1) == taken


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:3] == ["doc_id", "sample", "n_pieces"] and out.count() > 0


def test_awkward_documents_pass_every_stage(spark, sf, tmp_path):
    passage = " ".join(f"p{i}" for i in range(40))
    one, two = (" ".join(f"{w}{i}" for i in range(90)) for w in ("one", "two"))
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here at all", "en", None, 17), (None, "no id here at all", "en", None, 17),
        (3, long, "en", "a", len(long)), (4, one + " " + passage, None, "b", None), (5, passage + " " + two, "de", "b", 3),
        (6, "same words again", "en", "c", 16), (6, "same words again", "en", "c", 16), (7, "same words again", "fr", "c", 16), (8, " \t ", "en", "ä", 3),
    ]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, score double, spans string"
    docs = spark.createDataFrame([(*r, 1, 2, 0.5, "x") for r in rows], ddl)
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append(docs.collect())
        if n < 4:
            assert docs.columns == [c.split()[0] for c in ddl.split(", ")]
    ids = [sorted((r["doc_id"] for r in k), key=str) for k in kept]
    assert ids[0] == sorted((r[0] for r in rows), key=str)  # nothing here is of bad quality
    assert ids[1] == sorted([1, None, None, 3, 4, 5, 6], key=str)  # empty ones are one group, equal ones too; no id: no group
    texts = {r["doc_id"]: r["text"] for r in kept[2]}
    assert texts[4] == one and texts[5] == two and texts[3] == long and texts[1] is None
    assert all(r["round_trip"] for r in kept[4])


def test_empty_documents_pass_every_stage(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.count() == 0


def test_clashing_columns_pass_the_stages_that_filter(spark, sf):
    """Names of working columns, names with dots and columns that can't be hashed come through as they were."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + " ".join(f"{w}{i}" for i in range(90)) for w in ("one", "two")]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, `_node` int, `_row` int, `_k1` int, k1 int, spans int, `a.b` string, m map<string,int>"
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), 1, 2, 3, 4, 5, "x", {"k": i}) for i, t in enumerate(texts)], ddl)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        got = sorted(docs.collect())
        assert docs.columns[5:] == ["_node", "_row", "_k1", "k1", "spans", "a.b", "m"], name
        assert [tuple(r)[5:] for r in got] == [(1, 2, 3, 4, 5, "x", {"k": i}) for i in range(2)], name
    assert all(passage not in r["text"] for r in got)
