"""Text and signal automata that column functions can't express, as pandas functions over Arrow batches."""

from __future__ import annotations

import ast
import io
import json
import re
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", " ": " "})


#: What may follow a string's closing quote.
CLOSES = re.compile(r"\s*(?:[,}\]:]|$)")


def close_strings(text: str) -> str:
    """Escape raw line ends inside JSON strings, and quotes that neither open nor close one."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and inside:
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            if inside and not CLOSES.match(text, i + 1):
                out.append('\\"')
                i += 1
                continue
            inside = not inside
        elif inside and c in "\r\n":
            out.append("\\n" if c == "\n" else "\\r")
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


def repair_json(raw: str | None) -> str | None:
    """The JSON object in a model's answer as JSON text, or null."""
    if not raw:
        return None
    text = re.sub(r"(?is)<think>.*?</think>", "", raw)
    text = re.sub(r"(?i)```(?:json)?", "", text)
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        return None
    text = text[start : end + 1]
    plain = re.sub(r",\s*([}\]])", r"\1", text.translate(QUOTES))
    for attempt in (text, plain, close_strings(plain)):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False)
        except ValueError:
            continue
    try:
        value = ast.literal_eval(plain)
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def tolerant_json(raw: str | None) -> str | None:
    """A document's JSON value as JSON text: NULs dropped; else lines with one value each (trailing commas allowed);
    else the first value of what starts well; null if there is none."""
    text = (raw or "").replace("\0", "").strip()
    if not text:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        pass
    if "\n" in text:
        try:
            items = [json.loads(line.strip().rstrip(",")) for line in text.splitlines() if line.strip()]
            return json.dumps(items if len(items) != 1 else items[0], ensure_ascii=False)
        except ValueError:
            pass
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text)[0], ensure_ascii=False)
    except ValueError:
        return None


def cut_indices(raw: str | None, size: int) -> list[int]:
    """Sorted different whole numbers inside (0, size) of the last list in an answer."""
    text = raw or ""
    spans = [text.strip(), *(m[0] for m in reversed(list(re.finditer(r"\[[^\[\]]*\]", text))))]
    for s in spans:
        try:
            value = json.loads(s)
        except ValueError:
            continue
        if isinstance(value, list):
            whole = {int(x) for x in value if isinstance(x, (int, float)) and x == int(x)}
            return sorted(x for x in whole if 0 < x < size)
    return []


def frame_rms(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    if len(x) < frame:
        return np.array([np.sqrt(np.mean(np.square(x)))]) if len(x) else np.zeros(0)
    view = np.lib.stride_tricks.sliding_window_view(np.asarray(x, np.float64), frame)[::hop]
    return np.sqrt(np.mean(np.square(view), axis=1))


def active_spans(x: np.ndarray, frame: int, hop: int, below_max: float = 40.0, floor: float = -45.0, join: int = 0, least: int = 0) -> list[tuple[int, int]]:
    """Sample ranges of frames louder than the larger of max - below_max dB and floor dB; gaps up to join are closed,
    ranges under least dropped."""
    rms = frame_rms(x, frame, hop)
    if not len(rms) or rms.max() <= 0:
        return []
    loud = rms > max(rms.max() * 10 ** (-below_max / 20), 10 ** (floor / 20))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(np.int8), [0]]))).reshape(-1, 2)
    spans: list[list[int]] = []
    for a, b in edge.tolist():
        start, end = a * hop, min(len(x), (b - 1) * hop + frame)
        if spans and start - spans[-1][1] <= join:
            spans[-1][1] = end
        else:
            spans.append([start, end])
    return [(a, b) for a, b in spans if b - a >= least]


def split_point(loud: list[bool], before: int = 9, after: int = 10) -> int | None:
    """The frame with most silent frames right around it: up to `before` before and `after` from it on; the first of equals."""
    best, at = 0, None
    for i in range(len(loud)):
        left = next((k for k in range(before) if i - k - 1 < 0 or loud[i - k - 1]), before)
        right = next((k for k in range(after) if i + k >= len(loud) or loud[i + k]), after)
        if left + right > best:
            best, at = left + right, i
    return at


def split_long(start: float, end: float, loud: list[bool], hop: float, most: float = 30.0) -> list[tuple[float, float]]:
    """Greedy pieces of at most `most` seconds, cut where it is quietest in their second half; else in the middle."""
    out = []
    while end - start > most:
        a, b = int((start + most / 2) / hop), int((start + most) / hop)
        at = split_point(loud[a:b])
        cut = start + most / 2 if at is None else max(start + hop, (a + at) * hop)
        out.append((start, cut))
        start = cut
    return [*out, (start, end)]


def log_spectrum(x: np.ndarray, window: int = 320, hop: int = 160) -> np.ndarray:
    """log10 magnitudes of a short-time Fourier transform, clipped below."""
    if len(x) < window:
        x = np.pad(x, (0, window - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop] * np.hanning(window)
    return np.log10(np.clip(np.abs(np.fft.rfft(frames, axis=1)), 1e-12, None))


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new rate's sample times."""
    if rate == to or not len(x):
        return np.asarray(x, np.float64)
    n = max(1, round(len(x) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x)


def wav_samples(content: bytes) -> dict:
    """Rate and samples of a WAV file: whole numbers scaled into [-1, 1], channels averaged; none at all is an error."""
    with wave.open(io.BytesIO(content)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if not raw:
        raise ValueError("no samples")
    if width == 1:  # unsigned
        x = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float64)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64)
    x = np.clip(x / (1 << (8 * width - 1)), -1.0, 1.0).reshape(-1, channels).mean(1)
    return {"rate": rate, "samples": x.tolist()}


def _on_each(f, kind: str):
    """A pandas function of one column; made when it is used, since a session must exist by then."""

    def column(c):
        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([f(v) for v in values])

        return run(c)

    return column


def is_json(text: str | None) -> bool:
    """Whether a text is one JSON value and nothing else."""
    try:
        json.loads(text or "")
    except ValueError:
        return False
    return True


is_json_udf = _on_each(is_json, "boolean")
split_point_udf = _on_each(lambda loud: split_point(list(loud)), "long")
repair_json_udf = _on_each(repair_json, "string")
tolerant_json_udf = _on_each(tolerant_json, "string")


def wav_samples_udf(content):
    @F.pandas_udf("struct<rate:long,samples:array<double>>")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wav_samples(c) for c in content], columns=["rate", "samples"])

    return run(content)


def split_long_udtf():
    """split_long as a table function: (place, start, end) of each piece."""

    class SplitLong:
        def eval(self, start: float, end: float, loud: list[bool], hop: float):
            for k, (a, b) in enumerate(split_long(start, end, list(loud or []), hop)):
                yield k, a, b

    return F.udtf(SplitLong, returnType="place long, start double, end double")


def cut_indices_udf(raw, size):
    @F.pandas_udf("array<long>")
    def run(raw: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([cut_indices(r, int(n)) for r, n in zip(raw, size, strict=True)])

    return run(raw, size)


def active_spans_udf(samples, frame: int, hop: int, join: int = 0, least: int = 0, below_max: float = 40.0):
    @F.pandas_udf("array<struct<start:long,end:long>>")
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in active_spans(np.asarray(x, np.float64), frame, hop, below_max, join=join, least=least)] for x in samples])

    return run(samples)
