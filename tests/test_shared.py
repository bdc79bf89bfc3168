"""Places without one task for all, nearest points however far, markers, parts and encoders."""

import json
import time

import pytest
from pyspark.sql import functions as F

from voxweave.functions.scoring import scored
from voxweave.functions.tokenizing import ByteEncoder, encoded
from voxweave.operators import joins as J
from voxweave.operators import samples as P
from voxweave.sources import sinks
from voxweave.sources.shared import folder, numbered


def test_numbered(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("string")).alias("g"), (-F.col("id")).alias("o")).repartition(7)
    got = numbered(rows, ["o"], "g").collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["o"]):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["number"] == seen[r["g"]]
    assert [r["number"] for r in sorted(numbered(rows, ["o"]).collect(), key=lambda r: r["o"])] == list(range(1, 1001))
    assert numbered(rows.limit(0), ["o"]).count() == 0


def test_nearest_is_found_however_far(spark):
    rows = spark.createDataFrame([(float(x),) for x in (-1e6, 0, 40, 55, 1e9)] + [(None,)], "x double")
    grid = spark.createDataFrame([(0.0,), (10.0,), (100.0,)], "p double")
    got = {r["x"]: r["nearest"] for r in J.nearest(rows.where("x is not null"), "x", grid, "p").collect()}
    assert got == {-1e6: 0.0, 0.0: 0.0, 40.0: 10.0, 55.0: 10.0, 1e9: 100.0}
    assert {r["nearest"] for r in J.nearest(rows.where("x = 0"), "x", grid.limit(0), "p").collect()} == {None}


def test_nearest_sums_no_frame_anew_for_every_row(spark):
    """60,000 rows among 30,000 points in one range: a frame to the range's end took minutes."""
    rows, grid = spark.range(60_000).select((F.col("id") / 2).alias("x")), spark.range(30_000).select((F.col("id") + F.lit(0.25)).alias("p"))
    began = time.monotonic()
    wrong = J.nearest(rows, "x", grid, "p").where(F.col("nearest") != F.greatest(F.lit(0.25), F.ceil(F.col("x") - F.lit(0.75)) + F.lit(0.25)))
    assert wrong.count() == 0 and time.monotonic() - began < 60
    text = J.nearest(rows, "x", grid, "p")._jdf.queryExecution().toString()
    assert "RangeFrame, currentrow$(), unboundedfollowing" not in text


def test_a_hot_expert_fills_many_tasks(spark):
    sent = spark.range(20_000).select("id", F.lit(3).alias("expert"), F.lit(1).alias("w"), F.spark_partition_id().alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = J.through_experts(sent, ["id"], "expert", F.lit(1) * F.pow(F.lit(2), F.spark_partition_id()), "w").select("mixed").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 4


def test_encoding_is_dealt_out_whatever_the_files_are(spark):
    rows = spark.createDataFrame([(i, "ab" if i % 3 else None, {"k": i}) for i in range(500)], "id long, text string, m map<string,int>").coalesce(1)
    got = encoded(rows, "text", ByteEncoder)
    assert got.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert sorted((r["id"], r["ids"], r["m"]["k"]) for r in got.collect()) == [(i, [97, 98] if i % 3 else [], i) for i in range(500)]


def test_counted_parts(spark):
    path, rows = folder(spark, "parts"), spark.range(25).toDF("id")
    assert sinks.write_counted(rows, path, ["id"], "error", 10, most=7) == 7
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_counted(rows, path, ["id"])
    assert sinks.write_counted(rows, path, ["id"], "resume", 10) == 18
    assert sinks.write_counted(rows, path, ["id"], "resume", 10) == 0
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(25))
    assert sinks.write_counted(rows, path, ["id"], "overwrite") == 25 and spark.read.parquet(path).count() == 25


def test_json_files_and_markers(spark):
    path = folder(spark, "json")
    sinks.write_json_files(spark.createDataFrame([("a/b", '{"x": "é"}'), ("", "[1]")], "name string, value string"), path)
    got = {r["f"]: json.loads(r["value"]) for r in spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract("_metadata.file_path", "([^/]*)$", 1).alias("f"), "value").collect()}
    assert got == {"a_b.json": {"x": "é"}, "unknown.json": [1]}
    marks = folder(spark, "marks")
    assert sinks.read_markers(spark, marks, "id", "long").count() == 0
    sinks.write_markers(spark.range(3), marks, "id", "why")
    sinks.write_markers(spark.range(2, 5), marks, "id", "again")
    assert sorted(r["id"] for r in sinks.read_markers(spark, marks, "id", "long").collect()) == [0, 1, 2, 3, 4]


def test_scorer_falls_back_row_by_row(spark):
    class Moody:
        def open(self):
            self.calls = 0

        def score(self, items):
            self.calls += 1
            if "bad" in items:
                raise RuntimeError
            return [f"{x}!" for x in items][: None if "short" not in items or len(items) == 1 else 1]

        def close(self):
            pass

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", None, "short", "b", ""])], "id long, t string").coalesce(1)
    got = {r["id"]: r["s"] for r in scored(rows, "t", Moody, "s", "string", 4).collect()}
    assert got == {0: "a!", 1: None, 2: None, 3: "short!", 4: "b!", 5: "!"}


def test_encoder_and_packing_corners(spark):
    rows = spark.createDataFrame([(1, "aé"), (2, None), (3, "")], "id long, t string")
    assert {r["id"]: r["ids"] for r in encoded(rows, "t", ByteEncoder, batch=1).collect()} == {1: [97, 195, 169], 2: [], 3: []}
    assert P.next_fit([200, 200, 300, 56, 56], 256) == [0, 1, -1, 1, 2]
    assert P.first_fit([200, 100, 56, 156], 256, 2, False) == [0, 1, 1, 2]
    assert P.first_fit([300, 10], 256, 1, True) == [0, 1]
    batches = P.collate(spark.createDataFrame([(0, 1, [5, 6]), (0, 2, [7])], "b int, o int, ids array<long>"), ["b"], "o", "ids")
    r = batches.first()
    assert (r["input_ids"], r["labels"], r["position_ids"], r["cu_seq_lens"], r["max_length"]) == ([5, 6, 7], [5, 6, -100], [0, 1, 0], [0, 2, 3], 2)
    full = P.padded_to(batches, 3).first()
    assert full["input_ids"] == [5, 6, 7] and full["cu_seq_lens"] == [0, 2, 3]
    cut = P.shard_sequence(batches, "input_ids", "position_ids", 2).orderBy("rank").collect()
    assert [(c["shard_ids"], c["shard_labels"]) for c in cut] == [([5, 6], [6, -100]), ([7, 0], [-100, -100])]
