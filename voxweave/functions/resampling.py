"""Rational resampling by a polyphase filter, and spectra of audio of one fixed length; whole batches at a time."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Of the Kaiser window, and zero crossings of the filter to either side.
BETA, CROSSINGS = 5.0, 10


@functools.lru_cache(64)
def filter_of(up: int, down: int) -> np.ndarray:
    """A windowed sinc that lets pass what both rates can hold, with gain `up` altogether."""
    widest = max(up, down)
    m = np.arange(-CROSSINGS * widest, CROSSINGS * widest + 1)
    h = np.sinc(m / widest) * np.kaiser(len(m), BETA)
    return h / h.sum() * up


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """x (rows of equal length) at another rate: ceil(length * to / rate) samples, the first at the same time; outside is silence."""
    x = np.atleast_2d(np.asarray(x, np.float64))
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    if up == down or not x.shape[1]:
        return x.copy()
    h = filter_of(up, down)
    half = len(h) // 2
    place = np.arange(-(-x.shape[1] * up // down)) * down + half  # an output sample takes x[k] times h[place - k * up]
    first = -(-(place - len(h) + 1) // up)
    out = np.zeros((len(x), len(place)))
    for t in range(-(-len(h) // up)):
        k = first + t
        tap = place - k * up
        on = (k >= 0) & (k < x.shape[1]) & (tap >= 0)
        out[:, on] += x[:, k[on]] * h[tap[on]]
    return out


def fitted(x: np.ndarray, length: int) -> np.ndarray:
    """Rows said over and over until they are long enough, and cut there; empty ones are silence."""
    x = np.atleast_2d(np.asarray(x, np.float64))
    return x[:, np.arange(length) % x.shape[1]] if x.shape[1] else np.zeros((len(x), length))


def log_spectrum(x: np.ndarray, window: int = 320, hop: int = 160) -> np.ndarray:
    """(row, frame, frequency): log10 of the magnitudes of frames that are centred on multiples of hop, silence around, in [-7, 7]."""
    x = np.pad(np.atleast_2d(x), ((0, 0), (window // 2, window // 2)))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    frames = np.lib.stride_tricks.sliding_window_view(x, window, axis=1)[:, ::hop] * hann
    return np.log10(np.clip(np.abs(np.fft.rfft(frames, axis=2)), 1e-7, 1e7))


def by_length(rows: DataFrame, column: str, apply: Callable[[np.ndarray], np.ndarray], out: str = "made") -> DataFrame:
    """rows with apply's row for each array of numbers (null stays null); arrays of equal length in a batch go through it together."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(column)
            flat, ends = np.asarray(lists.flatten(), np.float64), np.cumsum([len(v) if v.is_valid else 0 for v in lists]).tolist()
            sizes: dict[int, list[int]] = {}
            for i, v in enumerate(lists):
                if v.is_valid:
                    sizes.setdefault(len(v), []).append(i)
            made: list[list[float] | None] = [None] * len(lists)
            for n, own in sizes.items():
                for i, r in zip(own, apply(np.stack([flat[ends[k] - n : ends[k]] for k in own])).tolist(), strict=True):
                    made[i] = r
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float64()))], names=[*b.schema.names, out])

    return rows.mapInArrow(run, f"{schema}, `{out}` array<double>")
