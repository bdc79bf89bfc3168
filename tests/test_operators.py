"""Order-dependent operators against plain models, and documented examples."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxweave.functions import automata as A
from voxweave.functions import text as X
from voxweave.functions.registry import Registry
from voxweave.operators import joins as J
from voxweave.operators import mixing as M
from voxweave.operators import samples as P
from voxweave.operators import segments as S
from voxweave.sources import readers, sinks
from voxweave.streaming import blocks as B


@given(st.lists(st.integers(1, 90), max_size=40), st.booleans())
@settings(max_examples=200, deadline=None)
def test_first_fit(sizes, force):
    got = P.first_fit(sizes, 64, 5, force)
    assert all((b >= 0) == (n <= 64 or force) for b, n in zip(got, sizes))
    for b in set(got) - {-1}:
        inside = [n for n, g in zip(sizes, got) if g == b]
        assert sum(inside) <= 64 or force and sum(inside[1:]) + inside[0] <= max(64, inside[0])


@pytest.mark.parametrize(
    "raw, want",
    [
        ('<think>x</think>```json\n{"a": 1,}\n```', {"a": 1}),
        ("{“a”: “b”}", {"a": "b"}),
        ('{"a": "x\ny"}', {"a": "x\ny"}),
        ('{"a": "he said "no" to me"}', {"a": 'he said "no" to me'}),
        ("{'a': True, 'b': None}", {"a": True, "b": None}),
        ("no object", None),
    ],
)
def test_repair_json(raw, want):
    got = A.repair_json(raw)
    assert (json.loads(got) if got else None) == want


@pytest.mark.parametrize("raw, want", [('{"a":1} tail', {"a": 1}), ('{"a":1},\n{"a":2}', [{"a": 1}, {"a": 2}]), ('\0{"a":1}', {"a": 1}), ("", None), ("{broken", None)])
def test_tolerant_json(raw, want):
    got = A.tolerant_json(raw)
    assert (json.loads(got) if got else None) == want


def test_cut_indices():
    assert A.cut_indices("I cut at [10, 23] here", 30) == [10, 23]
    assert A.cut_indices("[5, 5.0, 3, 99, 0, 2.5]", 30) == [3, 5]
    assert A.cut_indices("nothing", 30) == []


def test_active_spans():
    x = [0.0] * 100 + [0.5] * 100 + [0.0] * 100
    (a, b), = A.active_spans(x, 10, 5)
    assert 90 <= a <= 100 and 200 <= b <= 210
    assert A.active_spans([0.0] * 50, 10, 5) == []


def test_split_long():
    parts = A.split_long(0.0, 70.0, [i % 50 != 0 for i in range(7000)], 0.01)
    assert parts[0][0] == 0.0 and parts[-1][1] == 70.0
    assert all(b == c for (_, b), (c, _) in zip(parts, parts[1:])) and all(b - a <= 30 for a, b in parts)


def test_scene_speakers(spark):
    rows = spark.createDataFrame([("d", 0, i, s) for i, s in enumerate(["Speaker-23", "Speaker-14", None, "Speaker-5", "Speaker-14"])], "doc string, scene long, ord long, speaker string")
    got = {(r["ord"]): r["rank"] for r in S.speakers_by_appearance(rows, ["doc", "scene"], "ord", 0).collect()}
    assert got == {0: 0, 1: 1, 2: None, 3: 2, 4: 1}


def test_modality_mask(spark):
    ids = spark.createDataFrame([([-200, -200, 2, -200, -200, 4, 5, 6, -201, -201],)], "ids array<long>")
    r = ids.select(*(c.alias(k) for k, c in X.mask_tokens(F.col("ids"), {"in": -200, "out": -201}).items())).first()
    assert r["input_ids"] == [0, 0, 2, 0, 0, 4, 5, 6, 0, 0]
    assert r["in_mask"] == [True, True, False, True, True] + [False] * 5 and r["out_mask"] == [False] * 8 + [True, True]


def test_text_functions(spark):
    r = spark.range(1).select(
        X.safe_filename(F.lit('a/b c?"')).alias("f"), X.safe_filename(F.lit("")).alias("u"), X.stem(F.lit("/x/y.tar.gz")).alias("s"), X.speaker_label(F.lit("SPEAKER_00")).alias("l"),
        X.strip(F.lit("　 a b \n")).alias("p"), X.to_float(F.lit("x")).alias("n"), X.parse_float(F.lit(" nan ")).alias("m"), X.after_mark(F.lit("a[Summary] b "), "[Summary]").alias("t"), F.size(X.chunks(F.array(), 3)).alias("c"),
    ).first()
    assert tuple(r) == ("a_b_c__", "unknown", "y.tar", "Speaker-1", "a b", None, None, "b", 0)


def test_fold_short_turns(spark):
    rows = spark.createDataFrame([("d", 0, 0.0, 10.0, "a"), ("d", 1, 10.5, 11.0, "a"), ("d", 2, 12.0, 20.0, "b"), ("d", 3, 20.5, 25.0, "b")], "doc string, ord long, start double, end double, speaker string")
    got = [tuple(r)[1:] for r in S.fold_short_turns(rows, "doc", ["ord"], 1.5, 1.0, 30.0, 1.5, 2.0).orderBy("place").collect()]
    assert got == [(0, 0.0, 11.0, "a"), (1, 12.0, 20.0, "b"), (2, 20.5, 25.0, "b")]


def test_nearest(spark):
    rows = spark.createDataFrame([(1.2,), (2.6,), (5.0,)], "x double")
    grid = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (5.5,)], "p double")
    assert {r["x"]: r["nearest"] for r in J.nearest(rows, "x", grid, "p").collect()} == {1.2: 1.0, 2.6: 3.0, 5.0: 5.5}


def test_mixture_is_checked():
    for bad in ((("a",), (1.0, 2.0)), (("a", "a"), (1.0, 1.0)), (("a",), (0.0,))):
        with pytest.raises(ValueError):
            M.Mixture(*bad)
    with pytest.raises(ValueError):
        M.Mixture(("a",), (1.0,), "other")


def test_registry():
    r = Registry("templates")
    r.register("x")(1)
    with pytest.raises(ValueError):
        r.register("x")(2)
    own = r.local()
    own.register("x")(3)
    assert (r["x"], own["x"]) == (1, 3)
    with pytest.raises(KeyError):
        own["y"]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"segments": [{"sentence": "hi", "language": "en", "start": "1"}, 3, {"text": "yo"}]} trailing')
    (tmp_path / "b.json").write_text('[{"segment_id": "s", "text": "t"}]')
    (tmp_path / "c.json").write_text("")
    rows = {(r["doc"], r["ord"]): r for r in readers.segments_of(readers.json_documents(spark, str(tmp_path))).collect()}
    assert rows["a", 0]["text"] == "hi" and rows["a", 0]["lang"] == "en" and rows["a", 0]["start"] == 1.0 and rows["a", 0]["segment_id"] == "a_000000"
    assert rows["b", 0]["segment_id"] == "s"


def test_tables_of_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("eval_id\toutput_audio\tpath\nx\to.wav\t\n\t\t/d/p.wav\n\t\t\n")
    got = sorted(tuple(r) for r in readers.paths(spark, str(tmp_path / "m.tsv")).collect())
    assert got == [("p", "/d/p.wav"), ("x", f"{tmp_path}/o.wav")]
    with pytest.raises(ValueError):
        readers.tsv(spark, str(tmp_path / "m.tsv"), ("nope",))


def test_resume(spark, tmp_path):
    out = str(tmp_path / "parts")
    assert sinks.write_parts(spark.range(10), out, "id") == 10
    assert sinks.write_parts(spark.range(15), out, "id", "resume") == 5
    assert spark.read.parquet(out).count() == 15


def test_retry_then_fallback(spark):
    rows = spark.createDataFrame([("good",), ("bad",)], "k string")
    score = lambda df: df.withColumn("answer", F.when(F.col("k") == "good", F.lit("ok")))
    got = sinks.retried(rows, score, lambda a: a == "ok", F.lit("fallback"))
    assert {r["k"]: r["answer"] for r in got.collect()} == {"good": "ok", "bad": "fallback"}


def test_stream_state_goes_on(spark, tmp_path):
    folder, check = tmp_path / "in", str(tmp_path / "check")
    schema = "shard long, ord long, n long"
    spark.createDataFrame([(0, 0, 60), (0, 1, 60)], schema).coalesce(1).write.parquet(str(folder))
    rows = lambda: spark.readStream.schema(schema).parquet(str(folder))
    first = B.pack(rows(), "shard", "ord", "n", 100)
    q = first.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.createDataFrame([(0, 2, 30)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    q = B.pack(rows(), "shard", "ord", "n", 100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["ord"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0), (1, 1), (2, 1)]


def test_workers_reduce_and_gather(spark):
    from voxweave.operators import joins

    rows = [(1, 0, 2), (1, 0, 3), (1, 2, 7), (1, 1, None), (2, 1, -4), (None, 0, 1)]
    got = joins.all_reduced(spark.createDataFrame(rows, "step long, worker long, value long"), "step", "worker", "value").collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(
        [(1, 0, 5, 12, 7, 6.0, [5, None, 7]), (1, 1, None, 12, 7, 6.0, [5, None, 7]), (1, 2, 7, 12, 7, 6.0, [5, None, 7]), (2, 1, -4, -4, -4, -4.0, [-4]), (None, 0, 1, 1, 1, 1.0, [1])], key=str
    )
    assert joins.all_reduced(spark.createDataFrame([], "step long, worker long, value long"), "step", "worker", "value").isEmpty()
