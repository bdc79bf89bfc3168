"""Samples of several kinds of media: placeholders, label spans, and batches whose features follow rules by name."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import IGNORED


def grid_tokens(frames: Column, height: Column, width: Column, merge: int = 2) -> Column:
    """Tokens of an image or video whose patches make a grid, `merge` by `merge` of them one token."""
    return F.floor(frames * height * width / (merge * merge)).cast("long")


def _rows(values: pa.Array) -> list[np.ndarray | None]:
    """The lists of an array column; null stays null."""
    return [v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in values]


def expanded(ids: Column, marker: int, counts: Column) -> Column:
    """ids with the nth marker repeated as often as the nth count says; a marker without a count stays single."""

    @F.arrow_udf("array<bigint>")
    def run(ids: pa.Array, counts: pa.Array) -> pa.Array:
        out: list = []
        for x, n in zip(_rows(ids), _rows(counts), strict=True):
            if x is None:
                out.append(None)
                continue
            at, times = np.flatnonzero(x == marker), np.ones(len(x), np.int64)
            known = min(len(at), 0 if n is None else len(n))
            times[at[:known]] = n[:known] if known else 1
            out.append(np.repeat(x, times))
        return pa.array(out, pa.list_(pa.int64()))

    return run(ids, counts)


def span_labels(ids: Column, begin: int, end: int) -> Column:
    """Labels of what stands between a begin and the next end token, the end included; all else is ignored."""

    @F.arrow_udf("array<bigint>")
    def run(ids: pa.Array) -> pa.Array:
        out: list = []
        for x in _rows(ids):
            if x is None:
                out.append(None)
                continue
            # Whether the last begin or end before a place was a begin.
            edge = np.where((x == begin) | (x == end), np.arange(1, len(x) + 1), 0)
            last = np.append(0, np.maximum.accumulate(edge)[:-1]) if len(x) else edge
            on = (last > 0) & (np.append(end, x)[last] == begin)
            out.append(np.where(on, x, IGNORED))
        return pa.array(out, pa.list_(pa.int64()))

    return run(ids)


POSITIONS = "struct<t:array<bigint>,h:array<bigint>,w:array<bigint>,next:bigint>"


def grid_positions(ids: Column, marker: int, grids: Column, merge: int = 2) -> Column:
    """Positions of each id in time, height and width, and the first one behind them (next).

    grids: array of (frames, height, width) in patches, one for each run of markers in order; merge by merge patches are one id. An id
    of text has the same position on all axes, one more than the largest before it; an id of a grid has its own place on each
    axis, counted from there. A run that is no grid's size is an error.
    """

    @F.arrow_udf(POSITIONS)
    def run(ids: pa.Array, grids: pa.Array) -> pa.Array:
        out: list = []
        for x, g in zip(_rows(ids), grids.to_pylist(), strict=True):
            if x is None:
                out.append(None)
                continue
            axes, at, begin = np.zeros((3, len(x)), np.int64), 0, 0
            todo = iter(g or ())
            while begin < len(x):
                if x[begin] != marker:
                    rest = np.flatnonzero(x[begin:] == marker)
                    stop = begin + int(rest[0]) if len(rest) else len(x)
                    axes[:, begin:stop] = at + np.arange(stop - begin)
                    at, begin = at + stop - begin, stop
                    continue
                t, h, w = next(todo, (0, 0, 0))
                h, w = h // merge, w // merge
                stop = begin + t * h * w
                if stop == begin or stop > len(x) or (x[begin:stop] != marker).any():
                    raise ValueError(f"markers at {begin} don't make a grid of {t} x {h} x {w}")
                axes[:, begin:stop] = at + np.stack([v.ravel() for v in np.indices((t, h, w))])
                at, begin = at + max(t, h, w), stop
            out.append({"t": axes[0], "h": axes[1], "w": axes[2], "next": at})
        return pa.array(out, pa.struct([*((k, pa.list_(pa.int64())) for k in "thw"), ("next", pa.int64())]))

    return run(ids, F.transform(grids, lambda g: F.array(*(g[i].cast("long") for i in range(3)))))


def collate_features(rows: DataFrame, keys: list[str], order: str, rules: dict[str, str]) -> DataFrame:
    """Batches (keys) whose array columns are put together by rule: `concat` in order, `pad` with 0 to the longest of the
    batch, `pad_labels` with ignored, `stack` as a list of them."""
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rules))).alias("_all"))

    def one(name: str, rule: str) -> Column:
        each = F.transform("_all", lambda x: x[name])
        if rule == "concat":
            return F.flatten(each)
        if rule == "stack":
            return each
        if rule not in ("pad", "pad_labels"):
            raise ValueError(f"{name}: no such rule as {rule}")
        most = F.array_max(F.transform("_all", lambda x: F.size(x[name])))
        fill = F.lit(IGNORED if rule == "pad_labels" else 0).cast("long")
        return F.transform(each, lambda v: F.concat(v, F.array_repeat(fill, most - F.size(v))))

    return got.select(*keys, *(one(n, r).alias(n) for n, r in rules.items()))


def piped(rows: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Collators one after another; each is a function from batches to batches."""
    for step in steps:
        rows = step(rows)
    return rows


def cut_samples(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """Samples of [start, end) seconds; null where the end isn't behind the start."""
    first = F.floor(start * rate).cast("int")
    size = (F.floor(end * rate) - F.floor(start * rate)).cast("int")
    return F.when(end > start, F.slice(samples, first + 1, F.greatest(F.lit(0), size)))
