"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from every whole text in numpy; the trees are grown on a bounded sample of labelled rows, over histograms
of quantile bins with logistic loss, and flattened into arrays that all rows of a batch walk through at once.

Null text counts as empty, whose statistics are zeros and which gets a score like any other; repeated rows get equal
scores; several labels of one id count as their smallest quality; ties between splits go to the first feature and bin; an
empty table gives an empty result, and with no label at all (or one kind of label) every score is the share of label 1
(0.5 with none). Other columns are ignored; rows with null ids are scored and never learned from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, need, texts, trimmed

#: Labelled rows that are learned from at most: those of the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, L2 = 80, 4, 64, 0.15, 20, 1.0
#: Scores from here on are predicted as quality 1.
KEEP = 0.7

FEATURES = (
    "bytes_log", "words_log", "word_length", "long_words", "distinct_words", "top_word", "top_pair", "upper", "digits", "marks", "exclamations", "bars", "odd_signs",
    "white", "line_ends", "non_ascii", "word_end_signs", "lone_signs", "capitalised", "line_length_log", "repeated_lines", "entropy", "repeated_pairs", "sentence_ends", "adjacent_repeats",
)
_SIGNS = frozenset(b"#$%&*!^~=+<>{}[]\\@|")
_CLASS = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 1 if 65 <= _i <= 90 else 2 if 48 <= _i <= 57 else 3 if _c == "!" else 4 if _c == "|" else 5 if _i in _SIGNS else 6 if _i == 10 else 7 if _i in b" \t\r\v\f" else 8 if _i >= 128 else 9 if _c in ".,;:?'\"()-" else 0


def statistics(raw: bytes) -> list[float]:
    """The features of one whole text."""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(raw), len(words)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    k = np.bincount(_CLASS, weights=by_byte, minlength=10) / n
    p = by_byte[by_byte > 0] / n
    counts, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x]
    first = [x[0] for x in words]
    upper_first = sum(1 for x, c in zip(words, first, strict=True) if 65 <= c <= 90 and not x.isupper())
    return [
        math.log1p(n), math.log1p(w), sum(map(len, words)) / w, sum(len(x) > 15 for x in words) / w, len(counts) / w, max(counts.values()) / w, max(pairs.values(), default=0) / w,
        k[1], k[2], k[9], k[3], k[4], k[5], k[7], k[6], k[8],
        sum(x[-1] in _SIGNS for x in words) / w, sum(len(x) == 1 and not x.isalnum() for x in words) / w, upper_first / w, math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        float(-(p * np.log2(p)).sum()), 1 - len(pairs) / max(1, w - 1), sum(x.endswith((b".", b"?", b"!")) for x in words) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
    ]


def feature_matrix(raw: list[bytes]) -> np.ndarray:
    return np.array([statistics(x) for x in raw], np.float64).reshape(len(raw), len(FEATURES))


class Trees:
    """Flattened trees: per node feature (-1: leaf), threshold, left child (the right one follows), value."""

    def __init__(self, base: float):
        self.base, self.roots = base, []
        self.feature, self.threshold, self.left, self.value = [], [], [], []

    def freeze(self) -> Trees:
        self.feature, self.left = np.array(self.feature, np.int64), np.array(self.left, np.int64)
        self.threshold, self.value = np.array(self.threshold, np.float64), np.array(self.value, np.float64)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of all rows of x, walking down all together."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.where(inner, f, 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting with logistic loss; each level's histograms of all nodes and features come from one bincount a feature."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    model = Trees(math.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model.freeze()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    total = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at, open_nodes, root = np.zeros(len(y), np.int64), [0], len(model.feature)
        model.roots.append(root)
        nodes = [{"rows": None}]
        model.feature.append(-1), model.threshold.append(0.0), model.left.append(0), model.value.append(-RATE * g.sum() / (h.sum() + L2))
        for _ in range(DEPTH):
            slot = np.full(len(nodes), -1)
            slot[open_nodes] = np.arange(len(open_nodes))
            mine = slot[at]
            rows = np.flatnonzero(mine >= 0)
            best = [(1e-9, -1, -1)] * len(open_nodes)
            for f in range(x.shape[1]):
                key, size = mine[rows] * BINS + binned[rows, f], len(open_nodes) * BINS
                gs = np.bincount(key, g[rows], size).reshape(-1, BINS).cumsum(1)
                hs = np.bincount(key, h[rows], size).reshape(-1, BINS).cumsum(1)
                ns = np.bincount(key, minlength=size).reshape(-1, BINS).cumsum(1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(ns < LEAST_ROWS) | (nt - ns < LEAST_ROWS)] = -1
                gain[:, len(edges[f]) :] = -1
                for i, b in enumerate(gain.argmax(1)):
                    if gain[i, b] > best[i][0] + 1e-12:
                        best[i] = (float(gain[i, b]), f, int(b))
            following = []
            for i, node in enumerate(open_nodes):
                _, f, b = best[i]
                if f < 0:
                    continue
                own = np.flatnonzero(at == node)
                left = len(nodes)
                nodes += [{}, {}]
                model.feature[root + node], model.threshold[root + node], model.left[root + node] = f, float(edges[f][b]), root + left
                right = binned[own, f] > b
                for side in (0, 1):
                    part = own[right == side]
                    at[part] = left + side
                    model.feature.append(-1), model.threshold.append(0.0), model.left.append(0), model.value.append(-RATE * g[part].sum() / (h[part].sum() + L2))
                following += [left, left + 1]
            open_nodes = following
            if not open_nodes:
                break
        total += np.array(model.value[root:])[at]
    return model.freeze()


def is_held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Learn from at most sample_rows labelled rows; the texts' statistics are computed on the executors."""
    marks = need(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.float64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(schema, [b.column("doc_id"), b.column("y"), feature_matrix(texts(b, "text")).tolist()])

    # The sample is bounded by sample_rows, so it may be broadcast and its statistics may be collected.
    rows = need(docs, "doc_id", "text").join(F.broadcast(marks), "doc_id").mapInArrow(trimmed(run), "doc_id long, y double, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).orderBy("doc_id").collect()
    return fit(np.array([r["r"]["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([r["r"]["y"] for r in rows]))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with _vw_held_out, _vw_score and _vw_predicted (1 from KEEP on)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(feature_matrix(texts(b, "text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= KEEP).astype(np.int32))], names=[*b.schema.names, "_vw_score", "_vw_predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn("_vw_held_out", is_held_out(F.col("doc_id"))).mapInArrow(trimmed(run), f"{schema}, _vw_held_out boolean, _vw_score double, _vw_predicted int")
