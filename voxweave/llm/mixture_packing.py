"""Mixture-controlled packing: deficit round-robin over source queues.

Every window takes from each queue its share of the target mixture; what rounding leaves over is the queue's deficit, which
later windows pay out. The round-robin is in closed form: queues are the leaves of a binary tree whose nodes deal their
tokens to two sides (Tree), so what a queue has given by any window is known without running through those before, and stays
within one token a level of its share. A queue may have less than one token in a window. Queues that run dry leave their
share to the others. So every partition packs its own documents, from the same running deficits, without a shuffle.

Texts are tokenized once into a scratch table of 16-bit ids with each row's position in its queue; only sums per partition
and queue are gathered. Documents are cut freely at window borders. Tokens after the last full window make sequences that
are powers of two, so nothing is padded.

Null text counts as empty (it still holds the end id); null sources share one queue; repeated rows and ids are packed each;
ties cannot occur, since a queue's order is that of partitions and rows; an empty table gives no pieces; other columns are
ignored. All sources keep queues of their own; more than MOST_QUEUES different ones raise an error, as the tree, about 100
bytes a source, is held by the driver and every worker.
"""

from __future__ import annotations

import itertools
import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, batch_of, need, slices, trimmed
from .pieces import is_latin, latin_cuts, latin_words, letters

SEQUENCE = 2048
END_ID = 1
#: Shares are parts of ONE.
BITS = 30
ONE = 1 << BITS
#: Classes of the time at which queues run dry, for each doubling.
CLASS = 8
#: Different sources that the driver and each worker hold a tree of.
MOST_QUEUES = 1 << 17
#: Rows of the table of offsets that may be broadcast (about 40 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
MEMO = 1_000_000
#: A text by which a tokenizer is tried: words of every kind, also in capitals and beyond ASCII.
PROBE = "It's 2024 -- 'TWAS the Café's 3\u00bd\u00a0\u00b5m, they'LL \"don't\" ''re-use\u00df."


def parts(values: pa.Array, at: np.ndarray | slice = slice(None)) -> list[bytes]:
    """The bytes of a whole large_binary array, cut where the values numbered by `at` begin (all of them)."""
    _, offsets, data = values.buffers()
    raw = data.to_pybytes() if data else b""
    stop = np.frombuffer(offsets, np.int64, len(values) + 1)[at].tolist()
    return [raw[a:b] for a, b in itertools.pairwise(stop)]


class Tokens:
    """Ids by the tokenizers library; a word's ids are asked for once while a worker remembers them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.model = self.tokenizer.model
        self.memo: dict[bytes, bytes] = {}
        if self.plain([PROBE]) != [self.whole(PROBE)]:
            raise ValueError("the tokenizer's words aren't those of pieces.py")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words in Latin-1."""
        found = list(map(self.memo.get, words))
        new, ids, stop = [i for i, x in enumerate(found) if x is None], [], [0]
        for i in new:
            ids += [t.id for t in self.model.tokenize(letters(words[i].decode("latin-1")))]
            stop.append(2 * len(ids))
        raw = np.array(ids, "<u2").tobytes()
        for i, (a, b) in zip(new, itertools.pairwise(stop), strict=True):
            self.memo[words[i]] = found[i] = raw[a:b]
        return found

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of Latin texts without special tokens: each different word is looked up once for all of them."""
        if not texts:
            return []
        start, words = latin_words("\n".join(texts).encode("latin-1"))
        words = words.dictionary_encode()
        if len(self.memo) > MEMO:
            self.memo.clear()
        ids = pa.array(self.ids_of(parts(words.dictionary)), pa.large_binary()).take(words.indices)
        # A text's words are those that start before the next text does.
        return parts(ids, np.append(0, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """16-bit ids of each text. Words of plain texts are independent of each other, and long ones are cut between
        words; other texts go in whole."""
        plain = [is_latin(t) and not self.special.search(t) for t in texts]
        ids = iter(self.plain([t for t, p in zip(texts, plain, strict=True) if p and len(t) <= SLICE_BYTES]))
        return [self.whole(t) if not p else next(ids) if len(t) <= SLICE_BYTES else b"".join(self.plain([x])[0] for x in latin_cuts(t, SLICE_BYTES)) for t, p in zip(texts, plain, strict=True)]


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    if path not in _TOKENS:
        t = Tokens(path)
        if t.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        _TOKENS[path] = t
    return _TOKENS[path]


class Tree:
    """Who gets which tokens: queues are the leaves of a binary tree, and each node deals its tokens to its two sides.

    Of the first x tokens of a node with the tokens left and right below its sides, the left side gets
    min(left, max(floor(x * r), x - right)), r being its part of the node's weight: its share, or what the other side can't
    give any more. Both sides' sums never fall, so every queue's running total follows its share within one token for each
    level, for ever and at any number of queues. What rounding leaves over at a level is the deficit that later windows pay.
    Queues stand by the time at which they run dry (in classes of a CLASS part of a doubling): those that run dry first
    split off nearest the root, so what they leave goes to all others in proportion.
    """

    def __init__(self, totals: list[int], weights: list[float]):
        n = len(totals)
        self.left: list[int] = []
        self.right: list[int] = []
        self.ratio: list[int] = []
        paths: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        dry = [math.floor(CLASS * math.log2(max(t, 1) / w)) if w > 0 else 1 << 20 for t, w in zip(totals, weights, strict=True)]
        order = sorted(range(n), key=lambda s: (dry[s], s))
        weight, total = [0.0], [0]
        for s in order:
            weight.append(weight[-1] + weights[s])
            total.append(total[-1] + totals[s])

        def split(a: int, m: int, b: int) -> int:
            """The number of the node that deals to order[a:m] and order[m:b]."""
            whole, part = weight[b] - weight[a], weight[m] - weight[a]
            if whole <= 0:  # queues that are to be used only when all others are dry
                whole, part = float(total[b] - total[a]), float(total[m] - total[a])
            self.left.append(total[m] - total[a])
            self.right.append(total[b] - total[m])
            self.ratio.append(min(ONE, round(part / whole * ONE)))
            return len(self.ratio) - 1

        classes = [0, *(k for k in range(1, n) if dry[order[k]] != dry[order[k - 1]]), n]
        stack, spine = [], []
        for a, b in itertools.pairwise(classes if n else []):
            above = list(spine)
            if b < n:
                node = split(a, b, n)
                above.append((node, 0))
                spine.append((node, 1))
            stack.append((a, b, above))
        while stack:
            a, b, above = stack.pop()
            if b - a == 1:
                paths[order[a]] = above
                continue
            m = (a + b) // 2
            node = split(a, m, b)
            stack += [(a, m, [*above, (node, 0)]), (m, b, [*above, (node, 1)])]
        self.left, self.right, self.ratio = (np.array(x, np.int64) for x in (self.left, self.right, self.ratio))
        depth = max(map(len, paths), default=0)
        self.node, self.side = np.full((n, depth), -1, np.int32), np.zeros((n, depth), np.int8)
        for s, path in enumerate(paths):
            for k, (node, side) in enumerate(path):
                self.node[s, k], self.side[s, k] = node, side

    def given(self, queue: np.ndarray, *x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """What the queues hold of the first x tokens, for each x; and how many of those from the first to the last x stand
        before theirs."""
        x, before = [np.array(v, np.int64) for v in x], np.zeros(len(queue), np.int64)
        for k in range(self.node.shape[1]):
            at = np.flatnonzero(self.node[queue, k] >= 0)
            node, right = self.node[queue[at], k], self.side[queue[at], k] > 0
            own = [v[at] for v in x]
            # x * ratio >> BITS in 64 bits, as x is cut in two
            left = [np.minimum(self.left[node], np.maximum((v >> BITS) * self.ratio[node] + ((v & ONE - 1) * self.ratio[node] >> BITS), v - self.right[node])) for v in own]
            before[at] += np.where(right, left[-1] - left[0], 0)
            for v, o, g in zip(x, own, left, strict=True):
                v[at] = np.where(right, o - g, g)
        return x, before


class Packer:
    """Where the queues' tokens go: windows of `length` tokens, and at the end sequences that are powers of two."""

    def __init__(self, totals: list[int], length: int = SEQUENCE, weights: list[float] | None = None):
        self.tree, self.length, self.total = Tree(totals, weights or [float(t) for t in totals]), length, sum(totals)
        self.windows, rest = divmod(self.total, length)
        self.cuts = np.array([0, *itertools.accumulate(1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1)], np.int64)

    def upto(self, queue: np.ndarray, window: np.ndarray) -> np.ndarray:
        return self.tree.given(queue, np.minimum(window * self.length, self.total))[0][0]

    def window_of(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window in which the token at each place of its queue stands, by bisection."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.windows + 1, np.int64)
        while (high - low > 1).any():
            middle = low + high >> 1
            over = self.upto(queue, middle) > at
            low, high = np.where(over, low, middle), np.where(over, middle, high)
        return low

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of tokens start..start+size of each queue: (number of the row, start, length, sequence, offset) in order."""
        first, last = self.window_of(queue, start), self.window_of(queue, start + size - 1)
        count = last - first + 1
        rare = count > 4 * size  # a queue that gives less than one token a window: ask for each token's window instead
        row = np.repeat(np.arange(len(queue)), np.where(rare, 0, count))
        window = first[row] + np.arange(len(row)) - (np.cumsum(np.where(rare, 0, count)) - np.where(rare, 0, count))[row]
        if rare.any():
            r = np.repeat(np.arange(len(queue)), np.where(rare, size, 0))
            t = start[r] + np.arange(len(r)) - (np.cumsum(np.where(rare, size, 0)) - np.where(rare, size, 0))[r]
            w = self.window_of(queue[r], t)
            new = np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1]))
            row, window = np.concatenate([row, r[new]]), np.concatenate([window, w[new]])
            order = np.lexsort((window, row))
            row, window = row[order], window[order]
        (begin, end), before = self.tree.given(queue[row], window * self.length, np.minimum((window + 1) * self.length, self.total))
        s, e = np.maximum(begin, start[row]), np.minimum(end, (start + size)[row])
        ok = e > s
        row, s, e, window, offset = row[ok], s[ok], e[ok], window[ok], (before + s - begin)[ok]
        if len(self.cuts) < 2 or not (late := window == self.windows).any():
            return row, s, e - s, window, offset
        # The rest: a piece is cut at the borders of the descending powers of two.
        k0 = np.where(late, np.searchsorted(self.cuts, offset, side="right") - 1, 0)
        k1 = np.where(late, np.searchsorted(self.cuts, offset + (e - s), side="left") - 1, 0)
        at = np.repeat(np.arange(len(row)), k1 - k0 + 1)
        k = k0[at] + np.arange(len(at)) - (np.cumsum(k1 - k0 + 1) - (k1 - k0 + 1))[at]
        late, low, high = late[at], self.cuts[k], self.cuts[np.minimum(k + 1, len(self.cuts) - 1)]
        a = np.where(late, np.maximum(offset[at], low), offset[at])
        b = np.where(late, np.minimum((offset + e - s)[at], high), (offset + e - s)[at])
        return row[at], s[at] + a - offset[at], b - a, window[at] + np.where(late, k, 0), np.where(late, a - low, a)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(part, doc_id, queue, before: tokens of its queue earlier in its partition, n, ids: 16 bits each)."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("queue", pa.string()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, sums = tokens_of(path), TaskContext.get().partitionId(), {}
        for b in batches:
            doc, queue, texts = b.column("doc_id"), b.column("queue").to_pylist(), [x or "" for x in b.column("text").to_pylist()]
            for i, j in slices(map(len, texts)):
                ids, before, n = [x + end for x in t.encode(texts[i:j])], [], []
                for q, x in zip(queue[i:j], ids, strict=True):
                    before.append(sums.get(q, 0))
                    n.append(len(x) // 2)
                    sums[q] = before[-1] + n[-1]
                yield batch_of(schema, [[part] * (j - i), doc[i:j], queue[i:j], before, n, ids])

    return need(docs, "doc_id", "text", "source").select("doc_id", "text", source.alias("queue")).mapInArrow(trimmed(run), "part long, doc_id long, queue string, before long, n long, ids binary")


def pack(docs: DataFrame, path: str, scratch: Scratch, length: int = SEQUENCE, targets: dict[str, float] | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    targets: source -> weight of the mixture (sources without one come when all others are dry); without it, each source's
    own part of all tokens.
    """
    tokens = scratch.keep(tokenize(docs, path), "tokens")
    sums = tokens.groupBy("part", "queue").agg(F.sum("n").alias("sum"))
    # One row for each partition and queue: small whatever a queue's part of the rows.
    base = F.sum("sum").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch.keep(sums.select("part", "queue", "sum", F.coalesce(base, F.lit(0)).alias("base")), "offsets")
    found = offsets.groupBy("queue").agg(F.sum("sum").alias("total")).limit(MOST_QUEUES + 1).collect()
    if len(found) > MOST_QUEUES:
        raise ValueError(f"more than {MOST_QUEUES} different sources: give documents a coarser source to mix by")
    totals = sorted((r["queue"], r["total"]) for r in found)
    number = {q: i for i, (q, _) in enumerate(totals)}
    weights = [max(0.0, float(targets.get(q, 0.0))) for q, _ in totals] if targets else None
    shared = docs.sparkSession.sparkContext.broadcast((Packer([t for _, t in totals], length, weights), number))  # grows with the sources, not with the rows
    offsets = offsets.select("part", "queue", "base")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("source", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = shared.value
        for b in batches:
            doc, source, ids = b.column("doc_id"), b.column("queue"), b.column("ids").to_pylist()
            queue = np.array([number[q] for q in source.to_pylist()], np.int64)
            first = b.column("before").to_numpy() + b.column("base").to_numpy()
            for i, j in slices(map(len, ids)):
                wide = [memoryview(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids[i:j]]
                n = np.array([len(x) // 4 for x in wide], np.int64)
                row, start, size, sequence, offset = packer.pieces(queue[i:j], first[i:j], n)
                start = start - first[i:j][row]
                crc = [zlib.crc32(wide[r][4 * s : 4 * (s + m)]) for r, s, m in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
                at = pa.array(row + i)
                yield batch_of(schema, [doc.take(at), start, size, np.array(crc, np.int64), n[row], sequence, offset, source.take(at)])

    return tokens.join(offsets, ["part", "queue"]).select("doc_id", "queue", "before", "base", "ids").mapInArrow(trimmed(run), ", ".join(f"{n} long" for n in names) + ", source string")
