"""Substring dedup: seed and extend over winnowed anchors.

A window is `least` consecutive words. Of every window the smallest hash of its ANCHOR-word runs (the leftmost of equals)
is its anchor, so equal windows have equal anchors, and neighbouring windows mostly share one: a span is a run of windows
with the same anchor occurrence. Documents are joined on anchors that occur more than once. Spans that are equal as a whole
extend to each other at once; where spans of one anchor differ, the match is extended both ways from the anchor window by
window, and the windows that occur elsewhere remain. The union of such windows is the union of all maximal repeats of at
least `least` words.

Anchors, spans and windows are only ever counted (with partial sums) and joined back, so a passage that a third of all
documents share is never gathered; joins on hot keys are left to skew-join splitting. Comparisons use 128 bits or more.

Null and empty texts have no words; texts of fewer than `least` words have no window and stay whole; very long texts are
cut into blocks of windows; a repeated row counts as a further occurrence, so rows with equal texts get equal results; ties
can't matter, since equal hashes only widen what is compared; an empty table gives an empty result. Columns of the input
are kept as they are and may have any name but those that begin with _vw_.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, HashedWords, Scratch, batch_of, mix, need, odd_numbers, slices, text_key, texts, trimmed

WINDOW, ANCHOR = 35, 12
#: Windows of one block; bounds the positions that break ties.
BLOCK = 1 << 22
_B1, _B2 = (int(x) for x in odd_numbers(2, 11))
_C = odd_numbers(ANCHOR, 5)


class Rolling:
    """Hashes of any run of words, from prefix sums of word hash times a power of an odd base, modulo 2**64."""

    def __init__(self, wh: np.ndarray, base: int):
        powers = np.full(len(wh), base, U64)
        powers[:1] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(len(wh) + 1, U64)
        np.cumsum(wh * powers, out=self.sums[1:])
        self.back = np.full(len(wh) + 1, pow(base, -1, 1 << 64), U64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def spans_of(wh: np.ndarray, ends: np.ndarray, least: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of neighbouring texts' word hashes (ends: where each text ends): first window, windows, anchor hash, span hash."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    anchor = min(ANCHOR, least)
    for at in range(0, max(0, len(wh) - least + 1), BLOCK):
        w = wh[at : at + BLOCK + least - 1]
        n = len(w) - least + 1
        if n <= 0:
            break
        a = np.zeros(len(w) - anchor + 1, U64)
        for i in range(anchor):
            a += w[i : i + len(a)] * _C[i]
        a = mix(a)
        low = (a & ~U64((1 << 24) - 1)) | np.arange(len(a), dtype=U64)
        size, want = 1, least - anchor + 1
        while size < want:  # minima over runs of 2, 4, ... and the rest
            step = min(size, want - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        owner = (low[:n] & U64((1 << 24) - 1)).astype(np.int64)
        text = np.searchsorted(ends, np.arange(at, at + n), side="right")
        ok = ends[np.minimum(text, len(ends) - 1)] >= np.arange(at, at + n) + least
        first = ok.copy()
        first[1:] &= ~(ok[:-1] & (owner[1:] == owner[:-1]) & (text[1:] == text[:-1]))
        start = np.flatnonzero(first)
        ident = np.cumsum(first)[ok] - 1
        count = np.bincount(ident, minlength=len(start))
        out[0].append(start + at)
        out[1].append(count)
        out[2].append(a[owner[start]])
        out[3].append(mix(Rolling(w, _B1).of(start, start + count + least - 1) + count.astype(U64)))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def spans(docs: DataFrame, least: int) -> DataFrame:
    """(k1, k2: the text's key, lo: first window, n: windows, anchor, sig) of every span of every whole text."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("sig", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, k1, k2 = texts(b, "text"), b.column("k1"), b.column("k2")
            for i, j in slices(map(len, raw)):
                words = HashedWords(b" ".join(raw[i:j]))
                ends = np.searchsorted(words.start, np.cumsum([len(x) + 1 for x in raw[i:j]]))
                start, n, anchor, sig = spans_of(words.hashes, ends, least)
                text = np.searchsorted(ends, start, side="right")
                lo = start - np.append(0, ends)[text]
                rows = pa.array(text + i)
                yield batch_of(schema, [k1.take(rows), k2.take(rows), lo.astype(np.int32), n.astype(np.int32), anchor.view(np.int64), sig.view(np.int64)])

    return docs.mapInArrow(trimmed(run), "k1 long, k2 long, lo int, n int, anchor long, sig long")


def windows(docs: DataFrame, least: int) -> DataFrame:
    """(w1, w2: window hash, k1, k2, lo, weight) of every window of the spans listed in column spans (lo, n, weight)."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("weight", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, k1, k2, listed = texts(b, "text"), b.column("k1"), b.column("k2"), b.column("spans").to_pylist()
            for i, j in slices(map(len, raw)):
                parts: list[list[np.ndarray]] = [[] for _ in range(5)]
                for r in range(i, j):
                    wh = HashedWords(raw[r]).hashes
                    lo = np.concatenate([np.arange(s["lo"], s["lo"] + s["n"]) for s in listed[r]])
                    weight = np.repeat([s["weight"] for s in listed[r]], [s["n"] for s in listed[r]])
                    for p, v in zip(parts, (Rolling(wh, _B1).of(lo, lo + least), Rolling(wh, _B2).of(lo, lo + least), np.full(len(lo), r), lo, weight), strict=True):
                        p.append(v)
                w1, w2, row, lo, weight = map(np.concatenate, parts)
                row = pa.array(row)
                yield batch_of(schema, [w1.view(np.int64), w2.view(np.int64), k1.take(row), k2.take(row), lo.astype(np.int32), weight.astype(np.int32)])

    return docs.mapInArrow(trimmed(run), "w1 long, w2 long, k1 long, k2 long, lo int, weight int")


def repeats(docs: DataFrame, scratch: Scratch, least: int = WINDOW) -> DataFrame:
    """(k1, k2, repeats: array of (lo, n)): per text key, the windows (n of them from word lo on) that occur elsewhere."""
    k1, k2 = text_key(F.col("text"))
    keyed = need(docs, "text").select(k1.alias("k1"), k2.alias("k2"), "text")
    every = scratch.keep(spans(keyed, least), "spans")
    twice = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor")
    twice = scratch.keep(twice, "twice")  # joins of two written tables can split hot keys
    seeds = scratch.keep(every.join(twice, "anchor"), "seeds")
    scratch.drop("spans")

    whole = seeds.groupBy("anchor", "sig").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "lo", "n")).alias("at"))
    whole = scratch.keep(whole, "whole")
    differing = whole.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    differing = scratch.keep(differing, "differing")
    # One occurrence of each kind of span is extended; a kind that occurs more than once counts twice.
    extend = whole.join(differing, "anchor").select("at.*", F.least("times", F.lit(2)).cast("int").alias("weight"))
    extend = extend.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n", "weight")).alias("spans"))
    at = scratch.keep(windows(keyed.join(extend.hint("shuffle_hash"), ["k1", "k2"]), least), "windows")
    again = at.groupBy("w1", "w2").agg(F.sum("weight").alias("times")).where("times > 1").select("w1", "w2")
    again = scratch.keep(again, "again")
    single = at.where("weight = 1").join(again, ["w1", "w2"]).select("k1", "k2", "lo", F.lit(1).alias("n"))
    full = seeds.join(whole.where("times > 1").select("anchor", "sig"), ["anchor", "sig"]).select("k1", "k2", "lo", "n")
    found = scratch.keep(full.union(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "n")).alias("repeats")), "repeats")
    scratch.drop("seeds", "whole", "windows")
    return found


def remove_repeats(docs: DataFrame, scratch: Scratch, least: int = WINDOW) -> DataFrame:
    """docs with text replaced by its kept words joined by one space (a text that loses nothing stays as it is), and
    _vw_words, _vw_removed, _vw_spans (removed word ranges) and _vw_kept_sha256."""
    found = repeats(docs, scratch, least).select(F.col("k1").alias("_vw_k1"), F.col("k2").alias("_vw_k2"), F.col("repeats").alias("_vw_repeats"))
    k1, k2 = text_key(F.col("text"))
    joined = docs.withColumns({"_vw_k1": k1, "_vw_k2": k2}).join(found.hint("shuffle_hash"), ["_vw_k1", "_vw_k2"], "left").select(*docs.columns, "_vw_repeats")
    added = [("_vw_words", pa.int64()), ("_vw_removed", pa.int64()), ("_vw_spans", pa.list_(pa.list_(pa.int64()))), ("_vw_kept_sha256", pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, gone, ranges, digests = [], [], [], [], []
            old = b.column("text")
            for r, (raw, listed) in enumerate(zip(texts(b, "text"), b.column("_vw_repeats").to_pylist(), strict=True)):
                words = raw.split()
                cover = np.zeros(len(words) + 1, np.int64)
                for s in listed or ():
                    cover[s["lo"]] += 1
                    cover[s["lo"] + s["n"] + least - 1] -= 1
                out = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                left = b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o] if listed else words)
                n.append(len(words))
                gone.append(int(out.sum()))
                ranges.append(edge.reshape(-1, 2).tolist())
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if listed else old[r].as_py())
            columns = [pa.array(kept, pa.string()) if f == "text" else b.column(f) for f in b.schema.names if f != "_vw_repeats"]
            columns += [pa.array(v, t) for v, (_, t) in zip((n, gone, ranges, digests), added, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f for f in b.schema.names if f != "_vw_repeats"), *(a for a, _ in added)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(trimmed(run), f"{schema}, _vw_words long, _vw_removed long, _vw_spans array<array<long>>, _vw_kept_sha256 string")
