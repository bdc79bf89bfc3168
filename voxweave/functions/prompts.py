"""Texts that samples and annotations are made of; all columns are computed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import codec_tokens, present, shorten, strip

#: Labels of the public features in annotation prompts (fixed values, in this order).
FEATURE_LABELS = {
    "duration": "总时长",
    "active_duration": "有效时长",
    "loudness": "响度",
    "expressive_intensity": "表达强度",
    "naturalness score": "自然度",
    "noise score": "噪声/音质",
}
#: Dimensions of an annotation (fixed values).
DIMENSIONS = ("dim1_language_act", "dim2_addressee", "dim3_scene_semantics", "dim4_cognition_persona_motivation", "dim5_expected_outcome", "dim6_emotion_trajectory")
#: Texts where an annotation has none (fixed values).
UNKNOWN_TEXT, UNKNOWN_EMOTION, FAILED_TEXT, UNKNOWN_LINE = "无法根据当前历史判断", "情绪不明", "COT 生成失败。", "这句台词"
#: Names of the codec's tokens (fixed values).
GLOBAL, SEMANTIC = "bicodec_global", "bicodec_semantic"


def acoustic_events(events: Column, most: int = 200) -> Column:
    """label(start-end) of each event once, in order of first mention; events: array of structs label, start, end (texts),
    where a null start stands for an event without times."""
    item = lambda e: F.when(e["start"].isNull(), F.coalesce(e["label"], F.lit(""))).otherwise(F.concat(F.coalesce(e["label"], F.lit("")), F.lit("("), e["start"], F.lit("-"), F.coalesce(e["end"], F.lit("None")), F.lit(")")))
    return F.coalesce(shorten(F.array_join(F.array_distinct(F.transform(events, item)), "；"), most), F.lit(""))


def feature_value(c: Column) -> Column:
    """Three decimals; ? for what is missing."""
    return F.when(c.isNull(), "?").otherwise(F.format_string("%.3f", c.cast("double")))


def feature_text(features: dict[str, Column]) -> Column:
    """label=value of the features at hand, in the labels' order."""
    return F.concat_ws("；", *(F.concat(F.lit(f"{label}="), feature_value(features[k])) for k, label in FEATURE_LABELS.items() if k in features))


def window_line(place: Column, speaker: Column, emotion: Column, text: Column, events: Column, features: Column, most: int = 120) -> Column:
    """One line of a prompt: the place in the window, the speaker, the raw tag, what is known of the sound, and the text."""
    tag = shorten(F.coalesce(F.nullif(emotion, F.lit("")), F.lit("?")), 20)
    parts = F.concat_ws(" | ", F.concat(F.lit("#"), place.cast("string")), F.concat(F.lit("说话人="), F.coalesce(speaker, F.lit("Unknown"))), F.concat(F.lit("原emo-tag="), tag), F.when(events != "", F.concat(F.lit("音频事件="), events)), F.when(features != "", F.concat(F.lit("音频特征="), features)))
    return F.concat(parts, F.lit("\n台词："), shorten(F.coalesce(text, F.lit("")), most))


def prompt(instruction: str, lines: Column, closing: str = "") -> Column:
    """An instruction, the window's lines and what is asked for, as one user message."""
    return F.concat_ws("\n", F.lit(instruction), F.array_join(lines, "\n"), F.when(F.lit(closing != ""), F.lit(closing)))


def annotation(parsed: Column, tag: Column) -> Column:
    """Tag, six dimensions that all need a text, and the summary; what the answer lacks gets a default. parsed: struct with
    emo_tag, summ and the dimensions' texts; null if the answer was no answer."""
    emotion = shorten(F.coalesce(F.nullif(parsed["emo_tag"], F.lit("")), F.nullif(tag, F.lit("")), F.lit(UNKNOWN_EMOTION)), 10)
    dim = lambda d: F.struct(F.lit(True).alias("need_cot"), F.coalesce(parsed[d], F.lit(UNKNOWN_TEXT)).alias("text")).alias(d)
    return F.struct(emotion.alias("emo_tag"), *map(dim, DIMENSIONS), F.coalesce(parsed["summ"], F.lit("")).alias("summ"))


def failed_annotation(text: Column, tag: Column) -> Column:
    """What stands where no answer could be had."""
    emotion = shorten(F.coalesce(F.nullif(tag, F.lit("")), F.lit(UNKNOWN_EMOTION)), 10)
    line = shorten(F.coalesce(F.nullif(text, F.lit("")), F.lit(UNKNOWN_LINE)), 80)
    dim = lambda d: F.struct(F.lit(True).alias("need_cot"), F.lit(FAILED_TEXT).alias("text")).alias(d)
    return F.struct(F.coalesce(F.nullif(emotion, F.lit("")), F.lit(UNKNOWN_EMOTION)).alias("emo_tag"), *map(dim, DIMENSIONS), F.concat(F.lit("因为上下文分析失败，所以说了“"), line, F.lit("”。")).alias("summ"))


def under_text(segments: Column) -> Column:
    """Lines text[emotion] of the segments (text, emotion_tag) that have a text."""
    line = lambda s: F.concat(strip(s["text"]), F.coalesce(F.concat(F.lit("["), present(s["emotion_tag"]), F.lit("]")), F.lit("")))
    return F.array_join(F.transform(F.filter(segments, lambda s: present(s["text"]).isNotNull()), line), "\n")


def thought_text(given: Column, emotion: Column, active: Column, duration: Column, loudness: Column, intensity: Column, summary: Column) -> Column:
    """The text that came with a sample, else lines of its features and its summary."""
    value = lambda c: F.coalesce(strip(c.cast("string")), F.lit(""))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("<Emotion>: "), value(emotion)), F.concat(F.lit("<Valid duration | Total duration>: "), value(active), F.lit(" | "), value(duration)),
        F.concat(F.lit("<Loudness | Expressive Intensity>: "), value(loudness), F.lit(" | "), value(intensity)), F.concat(F.lit("[Summary] "), present(summary)),
    )
    return F.coalesce(present(given), lines)


def target_tokens(global_ids: Column, semantic_ids: Column, prefix: int = 32) -> Column:
    parts = [F.nullif(codec_tokens(global_ids, GLOBAL, prefix), F.lit("")), F.nullif(codec_tokens(semantic_ids, SEMANTIC), F.lit(""))]
    return F.concat_ws(" ", *parts)


def history_tokens(segments: Column, prefix: int = 32) -> Column:
    """Of segments (global_ids, semantic_ids): the first one's global and semantic tokens, the others' semantic ones."""
    return F.array_join(F.transform(segments, lambda s, i: F.when(i == 0, target_tokens(s["global_ids"], s["semantic_ids"], prefix)).otherwise(codec_tokens(s["semantic_ids"], SEMANTIC))), " ")


def _tagged(name: str, inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}_start>"), inner, F.lit(f"<{name}_end>"))


def user_content(task: str, target: Column, history: Column | None = None) -> Column:
    """The user's side of all tasks: the task, the spoken history, and the target part."""
    past = _tagged("history", _tagged("audio_his", history if history is not None else F.lit("")))
    return F.concat(F.lit("<bos>"), _tagged("task", F.lit(task)), past, _tagged("target", target), F.lit("<output_start>"))


def asr_target(audio: Column) -> Column:
    return F.concat(_tagged("audio_tar", audio), _tagged("audio_ref", F.lit("")))


def tts_target(text: Column, reference: Column) -> Column:
    return F.concat(_tagged("text", text), _tagged("audio_ref", reference))


def assistant_content(audio: Column, under: Column | None = None, thought: Column | None = None) -> Column:
    """The assistant's side: what lies under the text and the thought if the task has them, and the sound."""
    parts = [_tagged("under", under)] if under is not None else []
    parts += [_tagged("cot", thought)] if thought is not None else []
    return F.concat(*parts, _tagged("audio_tar", audio), F.lit("<output_end><eos>"))


def transcript_content(text: Column) -> Column:
    return F.concat(_tagged("text", text), F.lit("<output_end><eos>"))
