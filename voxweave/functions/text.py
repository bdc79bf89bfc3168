"""Column functions over text, ids and arrays; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space.
SPACE = r"(?U)\s+"
#: Characters that file names don't keep (fixed values).
UNSAFE = '/\\:*?"<>| '


def strip(c: Column) -> Column:
    """Without white space at both ends, as Python strips it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def present(c: Column) -> Column:
    """null if blank."""
    return F.nullif(strip(c), F.lit(""))


def safe_filename(c: Column) -> Column:
    return F.coalesce(F.nullif(F.translate(c, UNSAFE, "_" * len(UNSAFE)), F.lit("")), F.lit("unknown"))


def to_float(c: Column) -> Column:
    """null for what isn't a number."""
    return strip(c).try_cast("double")


def parse_float(c: Column) -> Column:
    """null for blanks and NaN; other text that isn't a number fails."""
    value = F.when(F.lower(strip(c)).isin("", "nan"), None).otherwise(strip(c)).cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def shorten(c: Column, n: int) -> Column:
    flat = strip(F.translate(c, "\n", " "))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("..."))).otherwise(flat)


def stem(path: Column) -> Column:
    """File name without folders and last suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def segment_id(stem_of: Column, index: Column) -> Column:
    """The fallback id of a segment: its document and place."""
    return F.concat(stem_of.cast("string"), F.lit("_"), F.lpad(index.cast("string"), 6, "0"))


def speaker_label(c: Column) -> Column:
    """SPEAKER_00 or speaker0 become Speaker-1; other labels stay."""
    n = F.regexp_extract(c, r"(?i)^speaker_?(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("Speaker-"), (n.cast("long") + 1).cast("string"))).otherwise(c)


def codec_tokens(ids: Column, prefix: str, most: int | None = None) -> Column:
    """<|prefix_id|> joined by spaces; null ids are no ids."""
    ids = F.coalesce(ids, F.array().cast("array<long>"))
    ids = F.slice(ids, 1, most) if most else ids
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit(f"<|{prefix}_"), i.cast("string"), F.lit("|>"))), " ")


def json_block(c: Column) -> Column:
    """From the first brace to the last, after thoughts and fences are dropped; null if there is none."""
    c = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    c = F.regexp_replace(c, r"(?i)```(json)?", "")
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def after_mark(c: Column, mark: str) -> Column:
    """What follows the first mark, stripped; empty without a mark."""
    at = F.locate(mark, c)
    return F.when(at > 0, strip(F.substr(c, at + len(mark)))).otherwise("")


def bad_tag(tag: Column, text: Column, words: tuple[str, ...] = ("happy", "sad", "angry", "neutral", "surprised", "fearful", "disgusted"), most: int = 10) -> Column:
    """Empty, too long, a bare emotion word, or a tag of 4 characters or more that the text holds."""
    t = F.coalesce(strip(tag), F.lit(""))
    return (t == "") | (F.length(t) > most) | F.lower(t).isin(*words) | ((F.length(t) >= 4) & F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(t)))


def cosine(a: Column, b: Column) -> Column:
    """0 for null or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def first_argmax(values: Column) -> Column:
    """The first index, from 0, of the largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def chunks(values: Column, size: int) -> Column:
    """Slices of `size`; none of an empty array. The values are computed once, not for each slice."""
    starts = lambda v: F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(v) - 1), F.lit(size))
    cut = F.flatten(F.transform(F.array(values), lambda v: F.transform(starts(v), lambda i: F.slice(v, i + 1, size))))
    return F.filter(cut, lambda c: F.size(c) > 0)


def mask_tokens(ids: Column, kinds: dict[str, int]) -> dict[str, Column]:
    """ids with marker ids replaced by 0, and a mask for each kind of marker."""
    marks = list(kinds.values())
    out = {"input_ids": F.transform(ids, lambda x: F.when(x.isin(*marks), F.lit(0).cast("long")).otherwise(x))}
    same = lambda v: lambda x: x == v  # noqa: E731  a second parameter would be the index
    return out | {f"{k}_mask": F.transform(ids, same(v)) for k, v in kinds.items()}


def bankers_round(c: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(c).cast("long")


def frame_indices(total: Column, fps: Column, want_fps: float, least: int, most: int, factor: int) -> Column:
    """Evenly spread frames, as many as the wanted rate gives, within bounds and a multiple of factor."""
    n = F.floor(total / fps * want_fps)
    n = F.greatest(F.lit(least), F.least(n, F.lit(most), total))
    n = F.greatest(F.lit(factor), F.floor(n / factor) * factor).cast("int")
    step = (total - 1) / F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: bankers_round(i * step))


def resized(height: Column, width: Column, factor: int, least: int, most: int) -> tuple[Column, Column]:
    """Height and width as multiples of factor, with their product between two bounds and the aspect about kept."""
    h, w = (F.greatest(F.lit(factor), F.bround(x / factor).cast("long") * factor) for x in (height, width))
    down, up = F.sqrt(height * width / most), F.sqrt(F.lit(least) / (height * width))
    pick = lambda plain, x: F.when(h * w > most, F.greatest(F.lit(factor), F.floor(x / down / factor) * factor)).when(h * w < least, F.ceil(x * up / factor) * factor).otherwise(plain).cast("long")
    return pick(h, height), pick(w, width)


def warmup_schedule(step: Column, warmup: int, total: int, kind: str, lowest: float = 0.0, decay_ratio: float = 1.0) -> Column:
    """Factor of the learning rate: linear warm-up, then constant, linear or cosine decay, lowest after the decay."""
    decay = max(1, int(total * decay_ratio) - warmup)
    at = F.least(F.lit(1.0), (step - warmup) / decay)
    after = {"constant": F.lit(1.0), "linear": lowest + (1 - lowest) * (1 - at), "cosine": lowest + (1 - lowest) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * at))}[kind]
    return F.when(step < warmup, step / F.lit(max(1, warmup))).otherwise(after)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def first_key(present_columns: list[str], keys: str | list[str]) -> Column:
    """The text under the first of the keys that a table has; none of them is an error before anything runs."""
    wanted = [keys] if isinstance(keys, str) else list(keys)
    found = [F.col(k) for k in wanted if k in present_columns]
    if not found:
        raise ValueError(f"none of the keys {', '.join(wanted)} is there")
    return F.coalesce(*found)


def digits(*parts: Column) -> Column:
    """A number in 0..2**32-1 from the MD5 of the parts, for choices that must be the same everywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def epoch_steps(points: Column, steps_per_epoch: int, total: int) -> Column:
    """Fractions of epochs as steps: rounded up, within 1..total, without repeats, in order of first mention."""
    return F.array_distinct(F.transform(points, lambda x: F.greatest(F.lit(1), F.least(F.lit(total), F.ceil(x * steps_per_epoch))).cast("long")))


def latent_length(frames: Column, height: Column, width: Column, time_scale: int = 4, space_scale: int = 8, patch: int = 2) -> Column:
    """Tokens of a latent video: (frames - 1) / time_scale + 1 frames of height and width scaled down and cut in patches."""
    down = lambda x: F.floor(x / (space_scale * patch))
    return ((F.floor((frames - 1) / time_scale) + 1) * down(height) * down(width)).cast("long")


def bracketed(text: Column, mark: str) -> Column:
    """The list that follows a mark, from its bracket to the one that closes it; null without one. Brackets within
    double quotes count too, as the literals at hand have none."""
    at = F.locate(mark, text)
    rest = F.substr(text, at + F.lit(len(mark) - 1))  # the mark's last character opens the list
    step = lambda s, c: F.struct(
        (s["depth"] + F.when(c == "[", 1).when((c == "]") & (s["depth"] > 0), -1).otherwise(0)).cast("int").alias("depth"),
        (s["n"] + F.when(s["done"], 0).otherwise(1)).cast("int").alias("n"),
        (s["done"] | ((c == "]") & (s["depth"] == 1))).alias("done"),
    )
    end = F.aggregate(F.split(rest, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done")), step)
    return F.when((at > 0) & end["done"], F.left(rest, end["n"]))
