"""BPE encoding and decoding through a minimal acyclic transducer.

The most frequent words of the corpus (counted over every text) become a minimal automaton: words are added in order and
finished states with equal right languages are merged, so suffixes are shared. Each transition carries how many words
come before those it leads to; the sum along a path is a word's number, which names its ids: an output that shared states
can't hold themselves. The arrays are laid out in one file, shipped to every executor and memory-mapped there; all new
words of a slice of texts walk through it together. Words outside the lexicon are merged exactly, pair by pair in rank
order. Special tokens in a text are taken out before normalising, as the tokenizer file declares.

Null text counts as empty: no ids, digests of the empty string. Very long texts and words are processed whole (merging
takes n log n steps). Ties in word counts are broken by the word, and the lexicon never changes the result, only how a
word's ids are found. Repeated rows repeat their result; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch_of, need, slices, trimmed
from .pieces import END, letters, split_words

#: Words of the lexicon: a fixed bound on what is shipped.
LEXICON_WORDS = 65_536
#: Words whose results a Python worker keeps; when there are more, it forgets them.
MEMO = 600_000


class Vocabulary:
    """Ids, ranks of merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or data["decoder"] or data["post_processor"]:
            raise ValueError("not a BPE vocabulary with word ends and plain decoding")
        self.ids = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged first, the leftmost of equals, until none is left."""
        parts = list(letters(word))
        parts[-1] += END
        ranks, n = self.ranks, len(parts)
        if n <= 64:
            none = len(ranks)
            rank = [ranks.get(p, none) for p in zip(parts, parts[1:], strict=False)]
            while rank and (least := min(rank)) < none:
                i = rank.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del rank[i]
                if i < len(rank):
                    rank[i] = ranks.get((parts[i], parts[i + 1]), none)
                if i:
                    rank[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
        else:
            after, before = [*range(1, n), -1], list(range(-1, n - 1))
            heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
            heapq.heapify(heap)
            while heap:
                _, i, a, b = heapq.heappop(heap)
                j = after[i]
                if parts[i] != a or j < 0 or parts[j] != b:
                    continue
                parts[i], parts[j], after[i] = a + b, "", after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                    if (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                        heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
                if (p := before[i]) >= 0 and (r := ranks.get((parts[p], parts[i]))) is not None:
                    heapq.heappush(heap, (r, p, parts[p], parts[i]))
            parts = [x for x in parts if x]
        return [self.ids[x] for x in parts]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


def build(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic transducer of words (non-empty), each with its ids."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...)), children before parents

    def state(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the last word's states, not yet registered
    labels: list[int] = []

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((labels.pop(), state(node)))

    last = b""
    for word in sorted(words):
        same = len(os.path.commonprefix([last, word]))
        fold(same)
        for byte in word[same:]:
            labels.append(byte)
            path.append([False, []])
        path[-1][0], last = True, word
    fold(0)
    root = state(path[0])
    count = [0] * len(states)
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(states):
        n = int(final)
        for label, target in edges:
            keys.append(s << 8 | label)
            targets.append(target)
            skips.append(n)
            n += count[target]
        count[s] = n
    ids = [words[w] for w in sorted(words)]
    return {
        "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int64), "skips": np.array(skips, np.int64), "final": np.array([f for f, _ in states], np.uint8).astype(np.int64),
        "starts": np.cumsum([0, *map(len, ids)], dtype=np.int64), "ids": np.array([x for i in ids for x in i], np.int64), "root": np.array([root], np.int64),
    }


NAMES = ("keys", "targets", "skips", "final", "starts", "ids", "root")


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    sizes = np.array([len(arrays[n]) for n in NAMES], np.int64)
    return sizes.tobytes() + b"".join(arrays[n].astype("<i8").tobytes() for n in NAMES)


class Transducer:
    """A memory-mapped file of build()'s arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, "<i8", len(NAMES))
        at = sizes.nbytes
        for name, n in zip(NAMES, sizes, strict=True):
            setattr(self, name, np.frombuffer(self.map, "<i8", n, at))
            at += 8 * int(n)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in sorted order, -1 for a word that isn't in the lexicon; all walk at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        at, number, alive = np.full(len(words), self.root[0]), np.zeros(len(words), np.int64), np.arange(len(words))
        step = 0
        while len(alive := alive[lengths[alive] > step]) and len(self.keys):
            key = at[alive] << 8 | data[starts[alive] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[edge] == key
            number[alive[~found]] = -1
            alive, edge = alive[found], edge[found]
            number[alive] += self.skips[edge]
            at[alive] = self.targets[edge]
            step += 1
        ok = (number >= 0) & (self.final[at] == 1) & (lengths > 0) & (step >= lengths)
        return np.where(ok, number, -1)


class Coder:
    """Encodes and decodes in a worker: new words go through the transducer, the rest of them are merged."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        self.vocabulary, self.transducer = vocabulary, transducer
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    def _put(self, word: str, ids: list[int]) -> None:
        self.ids[word] = " ".join(map(str, ids)).encode()
        self.decoded[word] = self.vocabulary.decode(ids).encode()

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > MEMO:
            self.ids.clear()
            self.decoded.clear()
        if not (new := [w for w in words if w not in self.ids]):
            return
        t = self.transducer
        for word, n in zip(new, t.numbers([w.encode() for w in new]).tolist(), strict=True):
            self._put(word, t.ids[t.starts[n] : t.starts[n + 1]].tolist() if n >= 0 else self.vocabulary.merge(word))

    def split(self, text: str) -> list[str]:
        """Words and special tokens in order; special ones can't be words, since '<' and letters never share one."""
        v = self.vocabulary
        if not v.find_special.search(text):
            return split_words(text)
        out, at = [], 0
        for m in v.find_special.finditer(text):
            out += split_words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + split_words(text[at:])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Per text: decimal ids and decoded text."""
        words = [self.split(t) for t in texts]
        for w, i in self.vocabulary.special.items():
            self._put(w, [i])
        self.learn(set().union(*words))
        for w, i in self.vocabulary.special.items():
            self._put(w, [i])
        for w in words:
            yield b" ".join(map(self.ids.__getitem__, w)), b" ".join(map(self.decoded.__getitem__, w))


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) over every whole text: each task counts before the shuffle."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, counts = vocabulary(path), Counter()
        c = Coder(v, None)
        for b in batches:
            for t in b.column("text").to_pylist():
                counts.update(c.split(t or ""))
            if len(counts) > MEMO:
                yield batch_of(schema, [list(counts), list(counts.values())])
                counts.clear()
        for w in v.special:
            counts.pop(w, None)
        yield batch_of(schema, [list(counts), list(counts.values())])

    return need(docs, "text").mapInArrow(trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, path: str, scratch: Scratch, size: int = LEXICON_WORDS) -> bytes:
    """The transducer of the `size` most frequent words, of a bounded size whatever the corpus."""
    v = Vocabulary(path)
    counts = scratch.keep(word_counts(docs, path), "words")
    # How many words there are of each count tells from which count on a word can be among them: few rows are sorted.
    of_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    least = of_count.withColumn("above", F.coalesce(F.sum("words").over(above), F.lit(0))).where(F.col("above") < size).agg(F.min("n")).first()[0]
    top = counts.where(F.col("n") >= (least or 0)).orderBy(F.desc("n"), "word").limit(size).select("word").collect()
    scratch.drop("words")
    return to_bytes(build({r["word"].encode(): v.merge(r["word"]) for r in top if r["word"] not in v.special}))


_LOADED: dict = {}


def vocabulary(path: str) -> Vocabulary:
    if ("v", path) not in _LOADED:
        _LOADED["v", path] = Vocabulary(path)
    return _LOADED["v", path]


def coder(path: str, file: str) -> Coder:
    if ("c", path, file) not in _LOADED:
        _LOADED["c", path, file] = Coder(vocabulary(path), Transducer(SparkFiles.get(file)))
    return _LOADED["c", path, file]


def encode(docs: DataFrame, path: str, scratch: Scratch, size: int = LEXICON_WORDS) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, all of the whole text."""
    data = lexicon(docs, path, scratch, size)
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}"
    scratch.ship(name, data)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, name)
        for b in batches:
            ids, texts = b.column("doc_id"), [t or "" for t in b.column("text").to_pylist()]
            for i, j in slices(map(len, texts)):
                n, e, d = [], [], []
                for x, y in c.encode(texts[i:j]):
                    n.append(x.count(b" ") + bool(x))
                    e.append(hashlib.sha256(x).hexdigest())
                    d.append(hashlib.sha256(y).hexdigest())
                yield batch_of(schema, [ids[i:j], n, e, d])

    return need(docs, "doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
