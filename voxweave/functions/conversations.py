"""Conversations of public datasets in one form: messages of a role and parts (text, image, video or audio).

Each source has a builder from its JSON text to array<struct<role, parts: array<struct<type, value>>>>; sources that are alike
share one. Choices (short captions, one of several labels) come from digests of a key, so they are the same everywhere.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Registry
from .text import digits, strip

MESSAGES = "array<struct<from:string,value:string>>"
PART = "struct<type:string,value:string>"
MESSAGE = f"struct<role:string,parts:array<{PART}>>"
#: Asked for a caption and for a table (fixed values).
DESCRIBE, DETAIL, TABLE = "Describe the image.", "Describe the image in detail.", "Convert the image to a table."
MARK = "<image>"
SHORT_PERCENT = 25

SOURCES = Registry("conversation source")
Builder = Callable[[Column, Column], Column]


def part(kind: str, value: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), (value if value is not None else F.lit(None)).cast("string").alias("value"))


def message(role: Column | str, *parts: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), F.array(*parts).alias("parts"))


def source(*names: str) -> Callable[[Builder], Builder]:
    def put(f: Builder) -> Builder:
        for n in names:
            SOURCES.register(n)(f)
        return f

    return put


def _messages(raw: Column) -> Column:
    return F.from_json(raw, MESSAGES)


def _role(m: Column) -> Column:
    return F.when(m["from"] == "human", "user").when(m["from"] == "gpt", "assistant").otherwise(F.raise_error(F.concat(F.lit("unknown speaker "), F.coalesce(m["from"], F.lit("null")))))


def _from_human(messages: Column) -> Column:
    """A first message of another speaker is skipped."""
    return F.flatten(F.transform(F.array(messages), lambda ms: F.when(F.get(ms, F.lit(0))["from"] != "human", F.slice(ms, F.lit(2), F.greatest(F.size(ms), F.lit(0)))).otherwise(ms)))


def _marked(kind: str, mark: str) -> Callable[[Column], Column]:
    """A message with a mark becomes its medium and the text without marks."""

    def one(m: Column) -> Column:
        both = F.array(part(kind), part("text", F.replace(m["value"], F.lit(mark), F.lit(""))))
        return F.struct(_role(m).alias("role"), F.when(F.contains(m["value"], F.lit(MARK)), both).otherwise(F.array(part("text", m["value"]))).alias("parts"))

    return one


def _captioned(caption: Column, ask: str) -> Column:
    return F.array(message("user", part("image"), part("text", F.lit(ask))), message("assistant", part("text", caption)))


@source("sharegpt4v_pretrain", "sharegpt4v_captioner")
def image_then_text(raw: Column, key: Column, generation_ratio: float = 0.0) -> Column:
    """An image and its text; of that share of samples, drawn by key, the text asks for the image instead."""
    one = lambda m: F.when(m["from"] == "human", message("user", part("image"))).otherwise(message("assistant", part("text", m["value"])))
    ms = _from_human(_messages(raw))
    seen = F.transform(ms, one)
    if not generation_ratio:
        return seen
    asked = F.concat(F.lit("Generate an image based on the following caption: "), F.element_at(ms, -1)["value"])
    made = F.array(message("user", part("text", asked)), message("assistant", part("image")))
    return F.when(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(generation_ratio * (1 << 30)), made).otherwise(seen)


@source("sharegpt4v_captioner_sft", "sharegpt4v_sft")
def marked_images(raw: Column, key: Column) -> Column:
    return F.transform(_from_human(_messages(raw)), _marked("image", MARK))


@source("LLaVA-Video-178K")
def marked_videos(raw: Column, key: Column) -> Column:
    return F.transform(_from_human(_messages(raw)), _marked("video", f"{MARK}\n"))


@source("wikihow_ct_0904")
def marked_steps(raw: Column, key: Column) -> Column:
    def one(m: Column) -> Column:
        rest = strip(F.replace(m["value"], F.lit(MARK), F.lit("")))
        seen = F.concat(F.array(part("image")), F.when(rest != "", F.array(part("text", rest))).otherwise(F.array().cast(f"array<{PART}>")))
        return F.struct(_role(m).alias("role"), F.when(F.contains(m["value"], F.lit(MARK)), seen).otherwise(F.array(part("text", m["value"]))).alias("parts"))

    return F.transform(_messages(raw), one)


@source("doom")
def merged_runs(raw: Column, key: Column, most_images: int | None = None) -> Column:
    """Neighbouring messages of a role are one; two line feeds part the assistant's. The first role is the user, whoever
    speaks first. With most_images, what follows that many images is left out."""
    ms = _messages(raw)
    if most_images is not None:  # only the first message counts as an image with white space around
        image = lambda m, i: F.when(F.when(i == 0, strip(m["value"])).otherwise(m["value"]) == MARK, i)
        images = F.filter(F.transform(ms, image), lambda i: i.isNotNull())
        ms = F.slice(ms, F.lit(1), F.coalesce(F.get(images, F.lit(most_images - 1)) + 1, F.size(ms)) if most_images > 0 else F.lit(1))
    numbered = F.transform(ms, lambda m, i: F.struct(_role(m).alias("role"), F.when(i == 0, strip(m["value"])).otherwise(m["value"]).alias("value")))
    done = F.array().cast(f"array<{MESSAGE}>")
    start = F.struct(done.alias("done"), F.lit("user").alias("role"), F.array().cast(f"array<{PART}>").alias("parts"))

    def step(s: Column, m: Column) -> Column:
        own = F.array(F.when(m["value"] == MARK, part("image")).otherwise(part("text", m["value"])))
        gap = F.when(m["role"] == "assistant", F.array(part("text", F.lit("\n\n")))).otherwise(F.array().cast(f"array<{PART}>"))
        same = m["role"] == s["role"]
        ended = F.concat(s["done"], F.array(F.struct(s["role"].alias("role"), s["parts"].alias("parts"))))
        return F.struct(F.when(same, s["done"]).otherwise(ended).alias("done"), m["role"].alias("role"), F.when(same, F.concat(s["parts"], gap, own)).otherwise(own).alias("parts"))

    last = lambda s: F.when(F.size(s["parts"]) > 0, F.concat(s["done"], F.array(F.struct(s["role"].alias("role"), s["parts"].alias("parts"))))).otherwise(s["done"])
    return F.aggregate(numbered, start, step, last)


@source("seed_edit")
def edits(raw: Column, key: Column) -> Column:
    def one(m: Column) -> Column:
        pieces = F.split(m["value"], MARK)
        each = F.flatten(F.transform(pieces, lambda p: F.when(p == "", F.array(part("image"))).otherwise(F.array(part("text", p), part("image")))))
        asked = F.struct(F.lit("user").alias("role"), F.slice(each, F.lit(1), F.size(each) - 1).alias("parts"))
        return F.when(m["value"] == MARK, message("assistant", part("image"))).otherwise(asked)

    return F.transform(_messages(raw), one)


def _label(raw: Column, key: Column) -> Column:
    labels = F.transform(F.split(raw, ","), strip)
    return F.get(labels, (digits(key, F.lit("label")) % F.size(labels)).cast("int"))


@source("imagenet1k")
def label_drawn(raw: Column, key: Column) -> Column:
    return F.array(message("user", part("text", _label(raw, key))), message("assistant", part("image")))


@source("imagenet1k_caption")
def label_told(raw: Column, key: Column) -> Column:
    return _captioned(_label(raw, key), DESCRIBE)


@source("fineweb_100BT")
def plain_text(raw: Column, key: Column) -> Column:
    return F.array(message("assistant", part("text", F.get_json_object(raw, "$.text"))))


@source("Detailed_Caption")
def detailed_caption(raw: Column, key: Column) -> Column:
    """The last message, behind its first eight characters."""
    return _captioned(strip(F.substring(F.element_at(_messages(raw), -1)["value"], 9, 1 << 30)), DETAIL)


@source("ArxivQA", "CHartQA")
def question_answer(raw: Column, key: Column) -> Column:
    ms = _messages(raw)
    question = strip(F.replace(F.get(ms, F.lit(0))["value"], F.lit(f"{MARK}\n"), F.lit("")))
    return F.array(message("user", part("image"), part("text", question)), message("assistant", part("text", strip(F.get(ms, F.lit(1))["value"]))))


@source("pixelprose", "sam")
def caption(raw: Column, key: Column) -> Column:
    return _captioned(raw, DETAIL)


@source("chart_to_table")
def table(raw: Column, key: Column) -> Column:
    return _captioned(raw, TABLE)


@source("DenseFusion-1M", "DenseFusion-4V-100k")
def first_caption(raw: Column, key: Column) -> Column:
    return _captioned(F.get(_messages(raw), F.lit(0))["value"], DETAIL)


@source("mmsci")
def figure_caption(raw: Column, key: Column) -> Column:
    return _captioned(strip(F.regexp_replace(F.get(_messages(raw), F.lit(0))["value"], r"\A(Figure|Fig\.) \d+[:]*", "")), DETAIL)


@source("sam_gen", "pixelprose_gen", "megalith", "journeydb", "dalle3_1m")
def drawn(raw: Column, key: Column) -> Column:
    """A caption to draw; of SHORT_PERCENT of the keys only what stands before its first stop."""
    short = F.when(digits(key, F.lit("short")) % 100 < SHORT_PERCENT, F.split_part(raw, F.lit("."), F.lit(1))).otherwise(raw)
    return F.array(message("user", part("text", short)), message("assistant", part("image")))


@source("wit")
def page_caption(raw: Column, key: Column) -> Column:
    line = lambda field, end: F.coalesce(F.concat(F.nullif(F.get_json_object(raw, f"$.{field}"), F.lit("")), F.lit(end)), F.lit(""))
    return F.array(
        message("user", part("text", line("page_title", "\n"))), message("assistant", part("text", line("context_page_description", "\n"))),
        message("user", part("image")), message("assistant", part("text", line("caption_reference_description", ""))),
    )


@source("VoiceAssistant")
def spoken_question(raw: Column, key: Column) -> Column:
    return F.array(message("user", part("audio")), message("assistant", part("text", F.get(_messages(raw), F.lit(1))["value"])))


@source("tulu-3-sft-mixture")
def chat(raw: Column, key: Column) -> Column:
    ms = F.from_json(F.get_json_object(raw, "$.messages"), "array<struct<role:string,content:string>>")
    return F.transform(ms, lambda m: message(m["role"], part("text", m["content"])))


def conversation(name: Column, raw: Column, key: Column, sources: tuple[str, ...] | None = None) -> Column:
    """The builder of each row's source (of those named); a source that has none is an error when a row of it comes."""
    names = sources or tuple(SOURCES.items)
    unknown = F.raise_error(F.concat(F.lit("no such source: "), F.coalesce(name, F.lit("null")))).cast(f"array<{MESSAGE}>")
    cases = functools.reduce(lambda c, n: c.when(name == n, SOURCES[n](raw, key)), names[1:], F.when(name == names[0], SOURCES[names[0]](raw, key)))
    return cases.otherwise(unknown)
