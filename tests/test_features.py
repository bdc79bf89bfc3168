"""Placeholders, label spans and positions on awkward rows."""

import pytest
from pyspark.sql import functions as F

from voxweave.functions import conversations as C
from voxweave.operators import features as V


def test_expanded_and_labels(spark):
    rows = [(1, [5, 9, 9, 9], [2, 0]), (2, [], [1]), (3, None, None), (4, [9, 1], None), (5, [1, 901, 2, 3, 902, 4, 902, 901, 5, 901, 6], [])]
    df = spark.createDataFrame(rows, "i int, ids array<long>, n array<long>")
    got = {r["i"]: (r["e"], r["l"]) for r in df.select("i", V.expanded(F.col("ids"), 9, F.col("n")).alias("e"), V.span_labels(F.col("ids"), 901, 902).alias("l")).collect()}
    no = -100
    assert got[1] == ([5, 9, 9, 9], [no] * 4) and got[2] == ([], []) and got[3] == (None, None) and got[4] == ([9, 1], [no, no])
    assert got[5][1] == [no, no, 2, 3, 902, no, no, no, 5, 901, 6]


def test_positions(spark):
    rows = [(1, [7, 9, 9, 9, 9, 7], [[1, 4, 4]]), (2, [], []), (3, None, None), (4, [7, 7], [[1, 4, 4]]), (5, [9, 9, 9], [[1, 2, 2], [2, 2, 2]])]
    df = spark.createDataFrame(rows, "i int, ids array<long>, g array<array<long>>")
    got = {r["i"]: r["p"] for r in df.select("i", V.grid_positions(F.col("ids"), 9, F.col("g")).alias("p")).collect()}
    assert got[1].asDict() == {"t": [0, 1, 1, 1, 1, 3], "h": [0, 1, 1, 2, 2, 3], "w": [0, 1, 2, 1, 2, 3], "next": 4}
    assert got[2]["next"] == 0 and got[3] is None and got[4]["t"] == [0, 1]
    assert got[5]["t"] == [0, 1, 2] and got[5]["h"] == [0, 1, 1]
    bad = spark.createDataFrame([([9, 9, 9], [[1, 4, 4]])], "ids array<long>, g array<array<long>>")
    with pytest.raises(Exception, match="don't make a grid"):
        bad.select(V.grid_positions(F.col("ids"), 9, F.col("g"))).collect()


def test_only_exact_marks_count_as_images(spark):
    said = [("human", " <image>"), ("gpt", "a"), ("human", " <image>"), ("gpt", "b"), ("human", "<image>"), ("gpt", "c")]
    raw = "[" + ",".join(f'{{"from": "{a}", "value": "{b}"}}' for a, b in said) + "]"
    df = spark.createDataFrame([(raw,)], "raw string")
    for most, messages in ((1, 1), (2, 5), (3, 6), (0, 1), (None, 6)):
        parts = df.select(F.aggregate(C.merged_runs(F.col("raw"), F.lit(1), most), F.lit(0), lambda n, m: n + F.size(m["parts"])).alias("n")).first()["n"]
        assert parts == messages


def test_generation_ratio(spark):
    raw = '[{"from": "human", "value": "<image>"}, {"from": "gpt", "value": "a cat"}]'
    df = spark.range(400).select("id", F.lit(raw).alias("raw"))
    first = lambda ratio: [r["p"]["role"] + str(r["n"]) for r in df.select(C.image_then_text(F.col("raw"), F.col("id"), ratio)[0].alias("p"), F.size(C.image_then_text(F.col("raw"), F.col("id"), ratio)).alias("n")).collect()]
    texts = lambda ratio: sum(r["t"] for r in df.select((F.to_json(C.image_then_text(F.col("raw"), F.col("id"), ratio)).contains("caption: a cat")).cast("int").alias("t")).collect())
    assert texts(0.0) == 0 and texts(1.0) == 400 and 60 < texts(0.25) < 140 and set(first(0.5)) == {"user2"}
