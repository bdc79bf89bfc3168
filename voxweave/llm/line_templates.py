"""Line dedup: a log-template tree of fixed depth.

A line is a run of text between line feeds, its tokens what white space separates; a token with a digit is a variable
field. The tree's levels are the number of tokens and the LEADING leading tokens (lines of fewer tokens have all of theirs);
below them stands a leaf, which holds any number of templates. The places behind the leading tokens make PARTS neighbouring
parts (fewer where there are fewer places), and a template fixes all of them but LEFT_OUT, which are variable (but one of two
or three parts, none of a single one). So a line belongs to the templates of its leaf that it has all fixed tokens of, and to
the one that fixes everything.

A template is a candidate if at least `least_docs` lines belong to it. It recurs if `least_docs` documents hold it of which none is a
near copy of another, whatever else they hold: lines of their own, other templates, or nothing. So boilerplate and logs go,
while what only copies of one document share is left to the near-duplicate operators. Near copies are grouped before the count: each
document has a sketch, the smallest hash of its SHINGLE-word shingles in each of BINS bins; documents with an equal band of the
sketch are compared with the smallest of them, and linked if ALIKE of their bins agree; groups are what links connect. So documents that boilerplate
makes near copies of each other are left to those operators, too. Lines of recurring templates are dropped from every document, with
their line feed.

The tree's depth is fixed, so lines that vary among their leading tokens, or in more than LEFT_OUT parts of the rest, share no template
and stay.

All of this is counted with partial sums over rows of one line each; no leaf, template or document list is gathered.

Null text counts as empty and stays null; lines without tokens always stay; very long texts and lines are whole; repeated rows
and copies count as one document; an empty table gives an empty result. Columns of the input are kept and may have any name
but those that begin with _vw_.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, HashedWords, Scratch, batch_of, components, mix, need, odd_numbers, slices, text_key, texts, trimmed

LEADING, PARTS, LEFT_OUT, LEAST_DOCS = 3, 5, 2, 8
#: Words of a shingle; bins of a sketch, bins of one band, and the share of bins that near copies agree in.
SHINGLE, BINS, BAND, ALIKE = 4, 64, 4, 0.75
_B = int(odd_numbers(1, 23)[0])
_BAND = odd_numbers(BAND, 41)
_SHINGLE = odd_numbers(SHINGLE, 57)
_FIELD = U64(xxhash.xxh3_64_intdigest(b"<*>"))
_DIGITS = b"0123456789"
_DIGIT = np.isin(np.arange(256), list(_DIGITS))
_EMPTY = np.uint32((1 << 32) - 1)


def left_out(parts: int) -> list[tuple[int, ...]]:
    """Which of so many parts a template leaves out."""
    return list(itertools.combinations(range(1, parts + 1), LEFT_OUT if parts > 3 else 1)) if parts > 1 else []


class Lines:
    """Of several texts: for each of their lines with tokens the number of its text, its number there, and hashes."""

    def __init__(self, raw: list[bytes]):
        joined = b"\n".join(raw)
        words, feeds = HashedWords(joined), np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        size = np.array([len(x) + 1 for x in raw], np.int64)
        begins = np.cumsum(size) - size
        line, first, n = np.unique(np.searchsorted(feeds, words.start), return_index=True, return_counts=True)  # of the lines with tokens
        self.n = n.astype(np.int64)
        self.text = np.searchsorted(begins, words.start[first], side="right") - 1
        self.number = line - np.searchsorted(feeds, begins)[self.text]
        self.h = words.hashes
        if joined.translate(None, _DIGITS) != joined:
            digit = np.searchsorted(words.start, np.flatnonzero(_DIGIT[np.frombuffer(joined, np.uint8)]), side="right") - 1
            self.h[digit] = _FIELD
        self.start = np.cumsum(self.n) - self.n
        if not len(self.n):
            self.leaf = self.exact = np.zeros(0, U64)
            return
        n, line = self.n, np.repeat(np.arange(len(self.n)), self.n)
        place = np.arange(len(self.h)) - self.start[line]
        powers = np.full(int(n.max()) + 1, _B, U64)
        np.cumprod(powers, out=powers)
        free = np.maximum(0, n - LEADING)
        self.parts = np.minimum(PARTS, free)
        part = np.where(place < LEADING, 0, (place - LEADING) * self.parts[line] // np.maximum(1, free[line]) + 1)
        group = line * (PARTS + 1) + part
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        self.sums = np.zeros(len(n) * (PARTS + 1), U64)
        self.sums[group[at]] = np.add.reduceat(self.h * powers[place], at)
        self.sums = self.sums.reshape(-1, PARTS + 1)
        self.leaf = mix(mix(self.sums[:, 0]) + n.astype(U64))
        self.exact = mix(self.leaf + self.sums.sum(1, dtype=U64))

    def templates(self) -> tuple[np.ndarray, np.ndarray]:
        """(templates of all lines in turn, how many each has): those that leave parts out."""
        every = self.sums.sum(1, dtype=U64)
        out, has = np.zeros((len(self.n), len(left_out(PARTS))), U64), np.zeros((len(self.n), len(left_out(PARTS))), bool)
        for parts in range(2, PARTS + 1):
            rows = np.flatnonzero(self.parts == parts)
            for k, gone in enumerate(left_out(parts)):
                kept = every[rows] - self.sums[rows][:, list(gone)].sum(1, dtype=U64)
                out[rows, k] = mix(mix(self.leaf[rows] + U64(k + 1)) + kept)
                has[rows, k] = True
        return out[has], has.sum(1)

    def sketches(self, texts: int) -> np.ndarray:
        """(text, bin): the smallest hash of the text's shingles that fall into the bin; texts of fewer words have none."""
        out = np.full((texts, BINS), _EMPTY, np.uint32)
        text, last = np.repeat(self.text, self.n), len(self.h) - SHINGLE + 1
        if last > 0:
            inside = np.flatnonzero(text[:last] == text[SHINGLE - 1 :])
            v = mix(sum((self.h[inside + k] * _SHINGLE[k] for k in range(1, SHINGLE)), self.h[inside] * _SHINGLE[0]))
            np.minimum.at(out.reshape(-1), text[inside] * BINS + (v >> U64(58)).astype(np.int64), (v & U64(0xFFFFFFFF)).astype(np.uint32))
        return out


def lines_of(docs: DataFrame) -> DataFrame:
    """One row for each different line of a document: (k1, k2, leaf, exact, templates, sketch: only in a document's first row)."""
    schema = pa.schema([*((c, pa.int64()) for c in ("k1", "k2", "leaf", "exact")), ("templates", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, k1, k2 = texts(b, "text"), b.column("k1"), b.column("k2")
            for i, j in slices(map(len, raw), 1 << 20):
                x = Lines(raw[i:j])
                if not len(x.n):
                    continue
                order = np.lexsort((x.exact, x.text))
                keep = np.sort(order[np.append(True, (x.text[order][1:] != x.text[order][:-1]) | (x.exact[order][1:] != x.exact[order][:-1]))])
                templates, count = x.templates()
                templates = templates[np.isin(np.repeat(np.arange(len(x.n)), count), keep)] if len(keep) < len(x.n) else templates
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count[keep])).astype(np.int32)), pa.array(templates.view(np.int64)))
                text = x.text[keep]
                marks, sketches = x.sketches(j - i), [None] * len(keep)
                for row in np.flatnonzero(np.append(True, text[1:] != text[:-1])).tolist():
                    sketches[row] = marks[text[row]].tobytes()
                row = pa.array(text + i)
                yield batch_of(schema, [k1.take(row), k2.take(row), x.leaf[keep].view(np.int64), x.exact[keep].view(np.int64), listed, sketches])

    return docs.mapInArrow(trimmed(run), "k1 long, k2 long, leaf long, exact long, templates array<long>, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BINS)


def bands_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, band) of (k1, sketch): hashes of BAND neighbouring bins each, unless all of them are empty."""
    for b in batches:
        s = _matrix(b.column("sketch")).reshape(len(b), -1, BAND)
        key = mix((s.astype(U64) * _BAND).sum(2, dtype=U64) + np.arange(s.shape[1], dtype=U64))
        row, band = np.nonzero((s != _EMPTY).any(2))
        yield pa.RecordBatch.from_arrays([b.column("k1").take(pa.array(row)), pa.array(key[row, band].view(np.int64))], names=["k1", "band"])


def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) of (a, b, one, other) whose sketches agree in ALIKE of the bins that one of them has."""
    for b in batches:
        one, other = _matrix(b.column("one")), _matrix(b.column("other"))
        some = (one != _EMPTY) | (other != _EMPTY)
        rows = pa.array(np.flatnonzero(((one == other) & some).sum(1) >= ALIKE * np.maximum(1, some.sum(1))))
        yield pa.RecordBatch.from_arrays([b.column("a").take(rows), b.column("b").take(rows)], names=["a", "b"])


def near_groups(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every document (k1) that is linked to another one; sketches: (k1, sketch). A document is compared with one
    of each of its bands, so work is in proportion to the documents, whatever the size of a group."""
    bands = scratch.keep(sketches.mapInArrow(trimmed(bands_of), "k1 long, band long"), "bands")
    first = bands.groupBy("band").agg(F.min("k1").alias("a"), F.max("k1").alias("last")).where("a <> last").select("band", "a")
    links = scratch.keep(bands.join(first, "band").where("a <> k1").select("a", F.col("k1").alias("b")).distinct(), "links")
    both = links.join(sketches.select(F.col("k1").alias("b"), F.col("sketch").alias("other")), "b").join(sketches.select(F.col("k1").alias("a"), F.col("sketch").alias("one")), "a")
    edges = scratch.keep(both.select("a", "b", "one", "other").mapInArrow(trimmed(alike), "a long, b long"), "alike")
    scratch.drop("bands", "links")
    return components(edges, scratch, "near")


def recurring(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(k1, k2: a text's key, exact: array of the exact hashes of lines to drop) of each text that has some."""
    k1, k2 = text_key(F.col("text"))
    lines = scratch.keep(lines_of(need(docs, "text").select(k1.alias("k1"), k2.alias("k2"), "text")), "lines")
    # The least count first: a leaf of few lines can't have candidates. Joins of two written tables can split hot keys.
    leaves = scratch.keep(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= least_docs).select("leaf"), "leaves")
    filed = scratch.keep(lines.join(leaves, "leaf").select("k1", "k2", "exact", F.explode(F.concat(F.array("exact"), "templates")).alias("t")), "filed")
    common = scratch.keep(filed.groupBy("t").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= least_docs).select("t"), "common")
    held = scratch.keep(filed.join(common, "t").distinct(), "held")  # copies of a text are one from here on
    scratch.drop("filed", "leaves")
    # By half of a text's key: two texts with equal halves count as one, which happens to one pair in 2 ** 64.
    sketches = lines.where("sketch is not null").groupBy("k1").agg(F.min("sketch").alias("sketch")).join(held.select("k1").distinct(), "k1")
    groups = near_groups(scratch.keep(sketches, "sketches"), scratch).select(F.col("node").alias("k1"), "root")
    placed = held.select("t", "k1").distinct().join(groups, "k1", "left").groupBy("t", F.coalesce("root", "k1").alias("name")).agg(F.count(F.lit(1)).alias("texts"))
    gone = scratch.keep(placed.groupBy("t").agg(F.count(F.lit(1)).alias("names")).where(F.col("names") >= least_docs).select("t"), "gone")
    found = scratch.keep(held.join(gone, "t").groupBy("k1", "k2").agg(F.collect_set("exact").alias("exact")), "drop")
    scratch.drop("lines", "common", "held", "sketches", "gone")
    return found


def drop_recurring(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with text without its recurring lines, and _vw_lines, _vw_dropped (counts)."""
    found = recurring(docs, scratch, least_docs).select(F.col("k1").alias("_vw_k1"), F.col("k2").alias("_vw_k2"), F.col("exact").alias("_vw_exact"))
    k1, k2 = text_key(F.col("text"))
    joined = docs.withColumns({"_vw_k1": k1, "_vw_k2": k2}).join(found.hint("shuffle_hash"), ["_vw_k1", "_vw_k2"], "left").select(*docs.columns, "_vw_exact")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, kept, n, gone = b.column("text"), [], [], []
            for r, (raw, listed) in enumerate(zip(texts(b, "text"), b.column("_vw_exact").to_pylist(), strict=True)):
                lines, dropped = raw.split(b"\n"), 0
                if listed:
                    x = Lines([raw])
                    out = set(x.number[np.isin(x.exact.view(np.int64), np.array(listed, np.int64))].tolist())
                    dropped = len(out)
                    kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in out).decode())
                else:
                    kept.append(old[r].as_py())
                n.append(len(lines))
                gone.append(dropped)
            names = [f for f in b.schema.names if f != "_vw_exact"]
            columns = [pa.array(kept, pa.string()) if f == "text" else b.column(f) for f in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "_vw_lines", "_vw_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(trimmed(run), f"{schema}, _vw_lines long, _vw_dropped long")
