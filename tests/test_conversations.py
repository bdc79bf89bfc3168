"""Conversation sources by example."""

import json

import pytest
from pyspark.sql import functions as F

from voxweave.functions import conversations as C

TALK = [{"from": "human", "value": "<image>\nWhat is it? "}, {"from": "gpt", "value": " A cat."}]
IMAGE, DETAIL = ("image", None), ("text", "Describe the image in detail.")
CASES = {
    "sharegpt4v_pretrain": ([{"from": "gpt", "value": "x"}, *TALK], [("user", IMAGE), ("assistant", ("text", " A cat."))]),
    "sharegpt4v_captioner": (TALK, [("user", IMAGE), ("assistant", ("text", " A cat."))]),
    "sharegpt4v_captioner_sft": (TALK, [("user", IMAGE, ("text", "\nWhat is it? ")), ("assistant", ("text", " A cat."))]),
    "sharegpt4v_sft": (TALK[::-1], [("user", IMAGE, ("text", "\nWhat is it? "))]),
    "LLaVA-Video-178K": (TALK, [("user", ("video", None), ("text", "What is it? ")), ("assistant", ("text", " A cat."))]),
    "wikihow_ct_0904": ([*TALK, {"from": "gpt", "value": " <image>"}], [("user", IMAGE, ("text", "What is it?")), ("assistant", ("text", " A cat.")), ("assistant", IMAGE)]),
    "doom": (
        [{"from": "human", "value": " <image> "}, {"from": "human", "value": "go"}, {"from": "gpt", "value": "a"}, {"from": "gpt", "value": "<image>"}],
        [("user", IMAGE, ("text", "go")), ("assistant", ("text", "a"), ("text", "\n\n"), IMAGE)],
    ),
    "seed_edit": ([{"from": "human", "value": "<image>make it red"}, {"from": "gpt", "value": "<image>"}], [("user", IMAGE, ("text", "make it red")), ("assistant", IMAGE)]),
    "imagenet1k": ("tench", [("user", ("text", "tench")), ("assistant", IMAGE)]),
    "imagenet1k_caption": (" tench ", [("user", IMAGE, ("text", "Describe the image.")), ("assistant", ("text", "tench"))]),
    "fineweb_100BT": ({"text": "words"}, [("assistant", ("text", "words"))]),
    "Detailed_Caption": ([{"from": "gpt", "value": "Answer: A cat. "}], [("user", IMAGE, DETAIL), ("assistant", ("text", "A cat."))]),
    "ArxivQA": (TALK, [("user", IMAGE, ("text", "What is it?")), ("assistant", ("text", "A cat."))]),
    "CHartQA": (TALK, [("user", IMAGE, ("text", "What is it?")), ("assistant", ("text", "A cat."))]),
    "pixelprose": ("A cat.", [("user", IMAGE, DETAIL), ("assistant", ("text", "A cat."))]),
    "sam": ("A cat.", [("user", IMAGE, DETAIL), ("assistant", ("text", "A cat."))]),
    "chart_to_table": ("a|b", [("user", IMAGE, ("text", "Convert the image to a table.")), ("assistant", ("text", "a|b"))]),
    "DenseFusion-1M": (TALK[1:], [("user", IMAGE, DETAIL), ("assistant", ("text", " A cat."))]),
    "DenseFusion-4V-100k": (TALK[1:], [("user", IMAGE, DETAIL), ("assistant", ("text", " A cat."))]),
    "mmsci": ([{"from": "x", "value": "Fig. 12: Growth."}], [("user", IMAGE, DETAIL), ("assistant", ("text", "Growth."))]),
    **{n: ("One", [("user", ("text", "One")), ("assistant", IMAGE)]) for n in ("sam_gen", "pixelprose_gen", "megalith", "journeydb", "dalle3_1m")},
    "wit": (
        {"page_title": "T", "context_page_description": None, "caption_reference_description": "C"},
        [("user", ("text", "T\n")), ("assistant", ("text", "")), ("user", IMAGE), ("assistant", ("text", "C"))],
    ),
    "VoiceAssistant": (TALK, [("user", ("audio", None)), ("assistant", ("text", " A cat."))]),
    "tulu-3-sft-mixture": ({"messages": [{"role": "system", "content": "be"}, {"role": "user", "content": "hi"}]}, [("system", ("text", "be")), ("user", ("text", "hi"))]),
}


def test_every_source(spark):
    assert set(C.SOURCES.items) == set(CASES) and len(CASES) == 28
    rows = spark.createDataFrame([(n, raw if isinstance(raw, str) else json.dumps(raw)) for n, (raw, _) in CASES.items()], "name string, raw string")
    got = {r["name"]: [(m["role"], *((p["type"], p["value"]) for p in m["parts"])) for m in r["c"]] for r in rows.select("name", C.conversation(F.col("name"), F.col("raw"), F.lit(1)).alias("c")).collect()}
    for n, (_, want) in CASES.items():
        assert got[n] == want, n


def test_choices_and_limits(spark):
    rows = spark.range(400).select("id", C.SOURCES["megalith"](F.lit("Short. Long."), F.col("id"))[0]["parts"][0]["value"].alias("v"), C.SOURCES["imagenet1k"](F.lit("a, b,c"), F.col("id"))[0]["parts"][0]["value"].alias("l")).collect()
    assert 60 < sum(r["v"] == "Short" for r in rows) < 140 and {r["v"] for r in rows} == {"Short", "Short. Long."} and {r["l"] for r in rows} == set("abc")
    talk = json.dumps([{"from": "human", "value": "<image>"}, {"from": "gpt", "value": "a"}, {"from": "human", "value": "<image>"}, {"from": "gpt", "value": "b"}])
    got = spark.range(1).select(C.merged_runs(F.lit(talk), F.col("id"), 2).alias("c")).first()["c"]
    assert [m["role"] for m in got] == ["user", "assistant", "user"]
    with pytest.raises(Exception, match="no such source"):
        spark.range(1).select(C.conversation(F.lit("other"), F.lit("x"), F.col("id"))).collect()
