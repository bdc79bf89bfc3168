"""LM scoring: masked pseudo-likelihood of whole documents.

A window network predicts every token from WINDOW words to either side, in two levels:

    P(w | context) = P(class of w | context) * c(w) / (occurrences of all words of the class)

A document's score is the sum of the logarithms. The first level is the network in numpy: embeddings of the context's words (one for a
word's class, one of HASHED for its hash), a tanh layer, softmax over CLASSES. Classes part the words: the FREQUENT most frequent
ones (that occur twice at least; ties go to the smaller hash) stand alone, so the network predicts the word itself; all others go by 32 shapes, and inside a shape the corpus's
counts decide, exact ones of every word, a table that grows with the corpus. Over all words of the corpus the probabilities of a place sum to
1. Class 0 is the end, which is context only. The network is trained on every window of the corpus: each task runs Adam over its own documents,
from the same start, and the tasks' weights are averaged by their tokens, in two steps. So weights, unlike counts, depend on how rows
lie in partitions.

Documents are cut into chunks of about CHUNK bytes; a chunk's different words are summed over the corpus, and the sums of those
that other chunks hold, too, are joined back, so the work grows as the text does. What a task holds is a chunk, what the driver holds are the network and FREQUENT words. Words are known by hashes of
64 bits.

Null text counts as empty: no tokens, sum 0, mean null; very long texts are scored whole (a text longer than a chunk is a
chunk of its own); repeated rows get equal scores and count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, HashedWords, Scratch, batch_of, groups_of, mix, need, slices, texts

CLASSES, FREQUENT = 128, 95
WINDOW, HASHED, EMBEDDING, HIDDEN = 2, 1 << 12, 8, 24
BATCH, RATE, SLOWER = 4096, 0.01, 400
#: Bytes of text in a chunk.
CHUNK = 16 << 20
#: Weights of tasks are averaged in groups, then again.
GROUPS = (256, 8)
_LETTER, _DIGIT = (np.isin(np.arange(256), list(x.encode())) for x in (string.ascii_letters, string.digits))


def shapes_of(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """0..31 of each word: capital first, sign last, something else than ASCII letters inside, and four lengths."""
    x = np.frombuffer(raw, np.uint8)
    other = np.append(0, np.cumsum(~_LETTER[x]))
    n, last = end - start, x[end - 1]
    sign = (last < 128) & ~_LETTER[last] & ~_DIGIT[last]
    inside = end - sign
    odd = (other[inside] > other[start]) | (inside == start)
    return ((x[start] >= 65) & (x[start] <= 90)) * 16 + sign * 8 + odd * 4 + (n > 3) + (n > 6) + (n > 10).astype(np.int64)


class Words:
    """Of several texts: their words' hashes and shapes in turn, and the numbers of words."""

    def __init__(self, raw: list[bytes], shaped: bool = True):
        joined = b" ".join(raw)
        words = HashedWords(joined)
        begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
        self.n, self.hashes = np.diff(np.searchsorted(words.start, begins)), words.hashes
        self.shapes = shapes_of(joined, words.start, words.end) if shaped and len(words.start) else np.zeros(len(words.start), np.int64)

    def places(self, ends: int) -> tuple[np.ndarray, int]:
        """Where words stand if so many ends come before, between and behind the texts with words; and how long that is."""
        some = self.n[self.n > 0]
        return np.arange(len(self.hashes)) + np.repeat(np.arange(1, len(some) + 1) * ends, some), len(self.hashes) + (len(some) + 1) * ends

    def inputs(self, top: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and hashed embedding of every place, WINDOW ends before, between and behind. top: sorted hashes of the words
        that are classes of their own, number: those classes."""
        at, size = self.places(WINDOW)
        own, wide = FREQUENT + 1 + self.shapes, np.full(size, CLASSES + HASHED, np.int64)
        if len(top):
            k = np.minimum(np.searchsorted(top, self.hashes), len(top) - 1)
            own = np.where(top[k] == self.hashes, number[k], own)
        classes = np.zeros(size, np.int64)
        classes[at] = own
        wide[at] = CLASSES + (self.hashes >> U64(20) & U64(HASHED - 1)).astype(np.int64)
        return classes, wide


class WindowNetwork:
    """P(class | words to either side)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (CLASSES + HASHED + 1, EMBEDDING)), "w": r.normal(0, 0.3, (2 * WINDOW, EMBEDDING, HIDDEN)), "b": np.zeros(HIDDEN),
            "v": r.normal(0, 0.1, (HIDDEN, CLASSES)), "c": np.zeros(CLASSES),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.m, self.s, self.t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0

    OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]

    def forward(self, classes: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of all places; hidden layer and log-probabilities of all but the WINDOW first and last ones."""
        p, n = self.p, len(classes) - 2 * WINDOW
        x = p["e"][classes] + p["e"][wide]
        h = np.tanh(sum((x[WINDOW + o : WINDOW + o + n] @ p["w"][k] for k, o in enumerate(self.OFFSETS)), p["b"]))
        z = h @ p["v"] + p["c"]
        z -= z.max(1, keepdims=True)
        return x, h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def log_probs(self, classes: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Of every word in turn, the log-probability of its class."""
        out = []
        for i in range(0, len(classes) - 2 * WINDOW, BATCH):
            c, w = classes[i : i + BATCH + 2 * WINDOW], wide[i : i + BATCH + 2 * WINDOW]
            want = c[WINDOW:-WINDOW]
            at = np.flatnonzero(want)
            out.append(self.forward(c, w)[2][at, want[at]].astype(np.float64))
        return np.concatenate([np.zeros(0), *out])

    def learn(self, classes: np.ndarray, wide: np.ndarray) -> None:
        """Steps of Adam over BATCH places each."""
        for i in range(0, len(classes) - 2 * WINDOW, BATCH):
            self.step(classes[i : i + BATCH + 2 * WINDOW], wide[i : i + BATCH + 2 * WINDOW])

    def step(self, classes: np.ndarray, wide: np.ndarray) -> float:
        """One step on the mean negative log-likelihood of the words, which it returns."""
        p, n = self.p, len(classes) - 2 * WINDOW
        x, h, logp = self.forward(classes, wide)
        want = classes[WINDOW:-WINDOW]
        at = np.flatnonzero(want)
        if not len(at):
            return 0.0
        dz = np.zeros_like(logp)
        dz[at] = np.exp(logp[at])
        dz[at, want[at]] -= 1
        dz /= len(at)
        dh = (dz @ p["v"].T) * (1 - h * h)
        dx, dw = np.zeros_like(x), np.zeros_like(p["w"])
        for k, o in enumerate(self.OFFSETS):
            part = slice(WINDOW + o, WINDOW + o + n)
            dw[k] = x[part].T @ dh
            dx[part] += dh @ p["w"][k].T
        size = len(p["e"])
        de = np.stack([np.bincount(classes, d, size) + np.bincount(wide, d, size) for d in dx.T], 1).astype(np.float32)
        self.t += 1
        rate = RATE / (1 + self.t / SLOWER) ** 0.5
        for name, g in (("e", de), ("w", dw), ("b", dh.sum(0)), ("v", h.T @ dz), ("c", dz.sum(0))):
            m, s = self.m[name], self.s[name]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p[name] = p[name] - rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-7)
        return float(-logp[at, want[at]].mean())

    def to_bytes(self) -> bytes:
        return b"".join(x.astype("<f4").tobytes() for x in self.p.values())

    @classmethod
    def of(cls, weights: np.ndarray) -> WindowNetwork:
        net, at = cls(), 0
        for k, x in net.p.items():
            net.p[k] = weights[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return net


def chunks_of(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chunk, doc_id, text): neighbouring documents make chunks of about so many bytes."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            raw, numbers = texts(b, "text"), []
            for x in raw:
                if size and size + len(x) > chunk:
                    number, size = number + 1, 0
                size += len(x)
                numbers.append(number)
            yield batch_of(schema, [numbers, b.column("doc_id"), raw])

    return need(docs, "doc_id", "text").mapInArrow(run, "chunk long, doc_id long, text binary")


def words_of(chunks: DataFrame) -> DataFrame:
    """(chunk, word, times) of the different words of each chunk, of each part of one if Spark reads it in parts."""
    schema = pa.schema([("chunk", pa.int64()), ("word", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), rows in groups_of(batches, 1, ["chunk", "text"]):
            word, times = np.unique(Words([x for _, x in rows], False).hashes, return_counts=True)
            yield batch_of(schema, [np.full(len(word), number), word.view(np.int64), times])

    return chunks.select("chunk", "text").mapInArrow(run, "chunk long, word long, times long")


def trained(chunks: DataFrame, top: np.ndarray, number: np.ndarray) -> tuple[WindowNetwork, np.ndarray]:
    """The network, and the occurrences of each class."""
    schema = pa.schema([("part", pa.int32()), ("tokens", pa.float64()), ("weights", pa.binary()), ("classes", pa.binary())])
    names = "part int, tokens double, weights binary, classes binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = WindowNetwork(), np.zeros(CLASSES, np.int64)
        for b in batches:
            raw = texts(b, "text")
            for i, j in slices(map(len, raw), 1 << 20):
                classes, wide = Words(raw[i:j]).inputs(top, number)
                seen += np.bincount(classes[classes > 0], minlength=CLASSES)
                net.learn(classes, wide)
        if seen.any():
            yield batch_of(schema, [[TaskContext.get().partitionId()], [float(seen.sum())], [net.to_bytes()], [seen.tobytes()]])

    def mean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in itertools.groupby((r for b in batches for r in zip(*(b.column(n).to_pylist() for n in schema.names), strict=True)), key=lambda r: r[:1]):
            tokens, weights, classes = 0.0, 0.0, 0
            for _, n, w, c in rows:
                tokens, weights, classes = tokens + n, weights + n * np.frombuffer(w, "<f4").astype(np.float64), classes + np.frombuffer(c, np.int64)
            yield batch_of(schema, [[part], [tokens], [(weights / tokens).astype("<f4").tobytes()], [classes.tobytes()]])

    rows = chunks.select("text").mapInArrow(run, names)
    for groups in GROUPS:
        rows = rows.withColumn("part", F.pmod("part", F.lit(groups))).repartition("part").sortWithinPartitions("part").mapInArrow(mean, names)
    tokens, weights, classes = 0.0, 0.0, np.zeros(CLASSES, np.int64)
    for r in sorted(rows.collect()):  # at most the last number of GROUPS
        tokens, weights, classes = tokens + r["tokens"], weights + r["tokens"] * np.frombuffer(r["weights"], "<f4").astype(np.float64), classes + np.frombuffer(r["classes"], np.int64)
    net = WindowNetwork.of(weights / tokens) if tokens else WindowNetwork()
    net.p["c"][classes == 0] = -1e9  # no word has these classes
    return net, classes


class Model:
    """What scoring needs besides the table of counts."""

    def __init__(self, net: WindowNetwork, classes: np.ndarray, top: np.ndarray, number: np.ndarray):
        self.net, self.classes, self.top, self.number = net, classes, top, number


def fit(docs: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> tuple[Model, DataFrame, DataFrame]:
    """The model of these documents, their chunks, and (chunk, word, total): the corpus's counts of those of its words that others hold."""
    chunks = scratch.keep(chunks_of(docs, chunk), "chunks", "zstd")
    words = scratch.keep(words_of(chunks), "words")
    totals = words.groupBy("word").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("chunks")).where("total > 1")
    totals = scratch.keep(totals, "totals")
    scratch.drop()
    found = totals.orderBy(F.desc("total"), "word").limit(FREQUENT).collect()
    top = np.array([r["word"] for r in found], np.int64).view(U64)
    order = np.argsort(top)
    top, number = top[order], order + 1
    shared = words.select("chunk", "word").join(totals.where("chunks > 1").select("word", "total"), "word").select("chunk", "word", "total")
    return Model(*trained(chunks, top, number), top, number), chunks, shared


def score_corpus(docs: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob of documents in the model of exactly these documents."""
    return score(*fit(docs, scratch, chunk))


def score(model: Model, chunks: DataFrame, counts: DataFrame) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(model)  # its size is fixed
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64()), ("mean_log_prob", pa.float64())])

    def scored(ids: list, raw: list[bytes], known: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        model, words = shared.value, Words(raw)
        n = words.n
        own, place, total = np.unique(words.hashes, return_inverse=True, return_counts=True)
        if known:
            word, sums = (np.concatenate([k[i] for k in known]) for i in (0, 1))
            total[np.searchsorted(own, word.view(U64))] = sums
        classes, wide = words.inputs(model.top, model.number)
        one = model.net.log_probs(classes, wide) + np.log(total[place] / model.classes[classes[classes > 0]])
        sums = np.zeros(len(n))
        if len(one):
            sums[n > 0] = np.add.reduceat(one, (np.cumsum(n) - n)[n > 0])
        return batch_of(schema, [ids, n, sums, [x / k if k else None for x, k in zip(sums.tolist(), n.tolist(), strict=True)]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, raw, known = None, [], [], []
        for b in batches:
            chunk = b.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if chunk[i] != now:
                    if ids:
                        yield scored(ids, raw, known)
                    now, ids, raw, known = chunk[i], [], [], []
                part = b.slice(i, j - i)
                rows = part.filter(part.column("word").is_valid())
                if len(rows):
                    known.append((rows.column("word").to_numpy(), rows.column("total").to_numpy()))
                rows = part.filter(part.column("word").is_null())
                ids += rows.column("doc_id").to_pylist()
                raw += [x or b"" for x in rows.column("text").to_pylist()]
        if ids:
            yield scored(ids, raw, known)

    none = F.lit(None)
    both = chunks.select("chunk", "doc_id", "text", none.cast("long").alias("word"), none.cast("long").alias("total"))
    both = both.union(counts.select("chunk", none.cast("long"), none.cast("binary"), "word", "total"))
    return both.repartition("chunk").sortWithinPartitions("chunk", "word").mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
