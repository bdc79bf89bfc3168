"""Language identification: string-kernel classification.

Two texts are alike as their sets of n-grams are: the blended-spectrum presence kernel is the mean, over lengths 1 to ORDERS, of the
cosine between their sets of n-grams of that length. N-grams are taken from a text's letters (a-z as A-Z; everything else
in ASCII is one space; bytes of other letters fold to 37 signs, so that é is like É), and those count that several landmarks hold.
Landmarks are texts of every language, drawn by hash; kernel values with them, whitened by the kernel among them (Nyström), are the
features of a one-versus-rest kernel ridge regression. Texts are scored in batches: presence matrix times landmark matrix times weights.

What is learned from is bounded: about PER_LANG texts of each language, drawn by the hash of their ids, and LANDMARKS of them in all;
more than MOST_LANGS languages are an error. Every text is scored whole.

A text that is null or has no letter (by Unicode) is `und` with score 0; so is every text if nothing could be learned from. Rows whose language
or text is null, and rows whose language is `und`, aren't learned from. Equal scores go to the language that sorts first; repeated rows
get equal results, and count once for each id when learning (the smallest language and text); an empty table gives an empty result. Columns of the input are
kept and may have any name but those that begin with _vw_.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, need, slices, texts
from .quality_trees import is_held_out

#: Lengths of n-grams, texts a language to learn from (about), landmarks in all, n-grams that count, weight of the ridge.
ORDERS, PER_LANG, LANDMARKS, MOST_GRAMS, RIDGE = 4, 1000, 256, 32_000, 1e-3
MOST_LANGS = 1000
#: Texts in one presence matrix; how steeply regression values become a score between 0 and 1.
TEXTS, STEEP = 64, 8.0
UNKNOWN = "und"

_SIGN = np.zeros(256, np.int32)
for _i in range(256):
    _c = chr(_i).lower()
    _SIGN[_i] = ord(_c) - 96 if "a" <= _c <= "z" else 0 if _i < 128 else 27 + (_i & 31) if _i < 192 else 59 + (_i & 3)


def codes_of(raw: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Signs of all texts, and for each length (codes of n-grams, texts they are in); a text's ends are spaces."""
    joined = np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8)
    signs, text = _SIGN[joined], np.repeat(np.arange(len(raw)), [len(x) + 2 for x in raw])
    keep = np.append(True, (signs[1:] > 0) | (signs[:-1] > 0) | (text[1:] != text[:-1]))
    signs, text = signs[keep], text[keep]
    out, code = [], signs
    for n in range(1, ORDERS + 1):
        if n > 1:
            code = (code[:-1] << 6) | signs[n - 1 :]
        at = text[: len(code)]
        inside = at == text[n - 1 :]
        inside &= code > 0
        out.append((code[inside], at[inside]))
    return signs, out


class Kernel:
    """Presence of the n-grams that count, and the landmarks' own."""

    def __init__(self, grams: list[np.ndarray], landmarks: list[list[np.ndarray]]):
        self.grams = grams
        self.sizes = np.cumsum([0, *map(len, grams)])
        self._tables: list[np.ndarray] = []
        marks = np.zeros((len(landmarks), self.sizes[-1]), np.float32)
        for k, listed in enumerate(landmarks):
            for n, own in enumerate(listed):
                at = np.searchsorted(grams[n], own)
                hit = grams[n][np.minimum(at, len(grams[n]) - 1)] == own if len(grams[n]) else np.zeros(len(own), bool)
                marks[k, self.sizes[n] + at[hit]] = 1
        self.marks = marks
        self.own = self.counts(marks)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": []}

    def counts(self, presence: np.ndarray) -> np.ndarray:
        """N-grams of each length in each row."""
        return np.stack([presence[:, a:b].sum(1, dtype=np.float64) for a, b in zip(self.sizes, self.sizes[1:], strict=False)], 1)

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        """Kernel values of rows and landmarks, from whole numbers of shared n-grams, so that equal rows have equal values in any batch."""
        out, count = np.zeros((len(presence), len(self.marks))), self.counts(presence)
        for n, (a, b) in enumerate(zip(self.sizes, self.sizes[1:], strict=False)):
            out += presence[:, a:b] @ self.marks[:, a:b].T / np.sqrt(np.maximum(1, np.outer(count[:, n], self.own[:, n])))
        return out / ORDERS

    def presence(self, raw: list[bytes]) -> np.ndarray:
        if not self._tables:
            for n, g in enumerate(self.grams):
                table = np.zeros(1 << 6 * (n + 1), np.int16)
                table[g] = np.arange(1, len(g) + 1)
                self._tables.append(table)
        out = np.zeros((len(raw), self.sizes[-1]), np.float32)
        flat = out.reshape(-1)
        for n, (code, text) in enumerate(codes_of(raw)[1]):
            place = self._tables[n][code]
            hit = place > 0
            flat[text[hit] * self.sizes[-1] + (self.sizes[n] - 1) + place[hit]] = 1
        return out

    def with_landmarks(self, raw: list[bytes]) -> np.ndarray:
        """Kernel values of texts (rows) and landmarks."""
        out = np.zeros((len(raw), len(self.marks)))
        for i, j in slices([len(x) + (4 << 20) // TEXTS for x in raw]):  # by bytes and by number
            out[i:j] = self.kernel(self.presence(raw[i:j]))
        return out


def kernel_of(landmarks: list[list[np.ndarray]], most: int = MOST_GRAMS) -> Kernel:
    """The n-grams that two landmarks hold at least, those of most landmarks if they are too many (ties: shorter first, then smaller codes)."""
    counted = [np.unique(np.concatenate([m[n] for m in landmarks]), return_counts=True) for n in range(ORDERS)]
    least = min(2, len(landmarks))
    length = np.concatenate([np.full(len(c), n) for n, (c, _) in enumerate(counted)])
    code, count = (np.concatenate([x[k] for x in counted]) for k in (0, 1))
    order = np.lexsort((code, length, -count))
    order = order[count[order] >= least][:most]
    return Kernel([np.sort(code[order[length[order] == n]]) for n in range(ORDERS)], landmarks)


def ridge(kernel: Kernel, values: np.ndarray, langs: np.ndarray, known: list[str], weight: float = RIDGE) -> np.ndarray:
    """Weights of landmarks (rows) for each language: one-versus-rest ridge regression on Nyström features, classes weighted alike."""
    among = kernel.kernel(kernel.marks)
    v, q = np.linalg.eigh(among)
    keep = v > max(v.max(), 1e-12) * 1e-7
    white = q[:, keep] / np.sqrt(v[keep])
    x = np.concatenate([values @ white, np.full((len(values), 1), 0.1)], 1)
    y = (langs[:, None] == np.array(known)[None, :]).astype(np.float64)
    share = Counter(langs.tolist())
    w = np.array([len(langs) / (len(known) * share[k]) for k in langs.tolist()])
    a = np.linalg.solve((x * w[:, None]).T @ x + weight * len(x) * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
    return np.concatenate([white @ a[:-1], 0.1 * a[-1:]])


class Model:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, langs: list[str]):
        self.kernel, self.weights, self.langs = kernel, weights, langs

    def predict(self, raw: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        letters = np.array([any(map(str.isalpha, x.decode("utf-8", "ignore"))) for x in raw], bool)
        if self.kernel is None or not letters.any():
            return [UNKNOWN] * len(raw), np.zeros(len(raw))
        f = np.einsum("ij,jk->ik", self.kernel.with_landmarks(raw), self.weights[:-1]) + self.weights[-1]
        e = np.exp(STEEP * (f - f.max(1, keepdims=True)))
        best = f.argmax(1)
        score = np.where(letters, e[np.arange(len(raw)), best] / e.sum(1), 0.0)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)], score


def train(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model:
    """Learn from about per_lang texts of each language, not held out; kernel values are computed on the executors."""
    spark = docs.sparkSession
    rows = need(docs, "doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(~is_held_out(F.col("doc_id")) & (F.col("lang") != UNKNOWN))
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(MOST_LANGS + 1).collect()}
    if len(count) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not count:
        return Model(None, None, [])
    # As many rows as per_lang says for each of a bounded number of languages: may be broadcast, and its kernel values collected.
    share = spark.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in count.items()], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 40))
    sample = rows.join(F.broadcast(share), "lang").where(drawn <= F.col("share") * float(1 << 40))
    ids = sample.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min(drawn).alias("drawn")).orderBy("drawn", "doc_id").collect()
    by_lang: dict[str, list[int]] = {}
    for r in ids:
        by_lang.setdefault(r["lang"], []).append(r["doc_id"])
    each = max(4, landmarks // len(by_lang))
    chosen = {i: k for k, i in enumerate(sorted(i for v in by_lang.values() for i in v[:each]))}
    langs = {r["doc_id"]: r["lang"] for r in ids}
    known = sorted(by_lang)
    only = lambda some: rows.join(F.broadcast(spark.createDataFrame([(i, langs[i]) for i in some], "doc_id long, lang string")), ["doc_id", "lang"]).groupBy("doc_id").agg(F.min("text").alias("text"))

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("codes", pa.list_(pa.int32()))])
        for b in batches:
            for i, raw in zip(b.column("doc_id").to_pylist(), texts(b, "text"), strict=True):
                own = [np.unique(c) for c, _ in codes_of([raw])[1]]
                yield batch_of(schema, [[i] * ORDERS, list(range(ORDERS)), own])

    marks: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] * ORDERS for _ in chosen]
    for r in only(chosen).mapInArrow(grams, "doc_id long, n long, codes array<int>").toLocalIterator():
        marks[chosen[r["doc_id"]]][r["n"]] = np.array(r["codes"], np.int32)
    shared = spark.sparkContext.broadcast(kernel_of(marks))

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("v", pa.binary())])
        for b in batches:
            yield batch_of(schema, [b.column("doc_id"), [x.tobytes() for x in shared.value.with_landmarks(texts(b, "text"))]])

    found = sorted((r["doc_id"], r["v"]) for r in only(langs).mapInArrow(values, "doc_id long, v binary").collect())
    v = np.stack([np.frombuffer(x) for _, x in found])
    return Model(shared.value, ridge(shared.value, v, np.array([langs[i] for i, _ in found]), known), known)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _vw_held_out, _vw_lang and _vw_lang_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(texts(b, "text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "_vw_lang", "_vw_lang_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn("_vw_held_out", is_held_out(F.col("doc_id"))).mapInArrow(run, f"{schema}, _vw_held_out boolean, _vw_lang string, _vw_lang_score double")
