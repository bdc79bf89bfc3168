"""Stages of the corpus pipeline by themselves, on awkward rows and against plain versions."""

import collections

import numpy as np
import pytest

from voxweave.llm import quality_trees

WORDS = [f"{a}{b}x" for a in "abcdefghijklmnopqrst" for b in "uvwxyz"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, k1 long, `odd name` int, leaf int"


def body(seed, n):
    return " ".join(WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n))


def rows():
    shared = body(1, 50)
    texts = [None, "", " \t\n", "one", "\n\n", "é" * 2000, body(2, 20_000), body(3, 40) + " " + shared, shared + "\n" + body(4, 30), body(5, 60), body(5, 60)]
    texts += [f"{body(100 + i, 9)}\nall rights reserved by nobody\n{body(200 + i, 12)}" for i in range(12)]
    made = [(i if i % 4 else None, t) for i, t in enumerate(texts)] + [(9, texts[9]), (9, body(6, 50))]
    return [(i, t, None, f"s{len(t or '') % 3}", len(t or ""), "x", 5, 1, 2) for i, t in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def columns_stay(got, docs):
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    return got.collect()


def test_lines(spark, docs):
    import corpus_pipeline

    got = columns_stay(corpus_pipeline.lines(spark, docs, ""), docs)
    want = [(i, t if t is None else "\n".join(x for x in t.split("\n") if x != "all rights reserved by nobody")) for i, t, *_ in rows()]
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(want)
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in got)


def test_passages(spark, docs):
    import corpus_pipeline

    got = columns_stay(corpus_pipeline.passages(spark, docs, ""), docs)
    texts = [t or "" for _, t, *_ in rows()]
    starts = collections.Counter(tuple(w[i : i + 35]) for w in map(str.split, texts) for i in range(len(w) - 34))
    want = collections.Counter()
    for i, t, *_ in rows():
        w = (t or "").split()
        gone = {k for j in range(len(w) - 34) if starts[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        want[i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t] += 1
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == want


def test_near_copies(spark, docs):
    import corpus_pipeline

    got = columns_stay(corpus_pipeline.near_copies(spark, docs, ""), docs)
    blank = collections.Counter((i, t) for i, t, *_ in rows() if not (t or "").strip(" \t\n"))
    kept = collections.Counter((r["doc_id"], r["text"]) for r in got)
    assert blank - kept == collections.Counter()
    assert len([1 for r in got if r["text"] == body(5, 60)]) == 1 and (9, body(6, 50)) in kept
    assert len(got) == len(rows()) - 2


def test_quality_and_packing(spark, docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = columns_stay(corpus_pipeline.quality(spark, d, sf), d)
    scores = quality_trees.score(d, quality_trees.train(d, labels)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in scores if r["_vw_score"] >= 0.7)
    assert 0 < len(got) <= d.count()
    columns_stay(corpus_pipeline.quality(spark, docs, sf), docs)  # labels of other ids: nothing fails
    pieces = corpus_pipeline.packing(spark, docs, "").toPandas()
    assert pieces[pieces.start == 0].shape[0] == len(rows())  # every row, empty ones too, begins once
