"""Periodic run detection: maximal repetitions of words, found from Lyndon words.

Each text is a sequence of words (what ASCII white space separates), numbered exactly by a dictionary of its own. A stack of
Lyndon words is scanned right to left, once with the words in the order of their numbers and once in the opposite order: what is
on top of it tells the longest Lyndon word that begins at each place. Suffixes that begin alike are compared by their longest common
extension, which is searched for by halves with a rolling hash and then verified word by word. Every run has a Lyndon root that is
the longest at its place under one of the orders, so extending these words to both sides finds all runs; a run that a hash claims
is verified on the words themselves, and extended directly where a hash was wrong.

A run is a stretch of consecutive words with smallest period q, at least max(least_words, 2 * q) words long, that no neighbouring
word extends keeping q. Words behind the first q of a run are dropped, whatever other runs say of them.

Null text stays null and has no words; texts of fewer than least_words words have no runs; very long texts are whole (memory follows the
longest text); runs may overlap, and one stretch counts once; repeated rows have equal results; an empty table gives an empty result.
Columns of the input are kept and may have any name but those that begin with _vw_.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, odd_numbers

LEAST_WORDS = 12
#: Words that are compared one by one before hashes are.
DIRECT = 8
_B = int(odd_numbers(1, 71)[0])
_MASK = (1 << 64) - 1
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list[bytes]) -> list[int]:
    """Each word as the number of its first occurrence among different words."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


class Extensions:
    """Longest common extensions of places of one sequence of numbers; sums and powers are made when first asked for."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = np.array(ids, np.int32), len(ids)
        self.raw = self.ids.tobytes()
        powers = np.full(self.n + 1, _B, U64)
        powers[0] = 1
        self.powers = np.cumprod(powers)
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(mix(self.ids.astype(U64) + U64(1)) * self.powers[:-1], out=self.sums[1:])
        self._lists: tuple[list[int], list[int]] | None = None
        self.reach: dict[int, tuple[int, int]] = {}

    def same(self, i: int, j: int, n: int) -> bool:
        """Word by word: are the n words from i and from j the same?"""
        return self.raw[4 * i : 4 * (i + n)] == self.raw[4 * j : 4 * (j + n)]

    def ahead(self, i: int, j: int) -> int:
        """Words that the suffixes from i and from j > i share at their beginnings.

        reach has for each distance the last stretch found with it, so that a long repetition is measured once.
        """
        if self._lists is None:
            self._lists = self.sums.tolist(), self.powers.tolist()
        sums, powers = self._lists
        d = j - i
        most, known = self.n - j, self.reach.get(d)
        if known and known[0] <= i < known[1]:
            return known[1] - i
        joins = known is not None and i < known[0] and known[0] - i <= most
        if joins:
            most = known[0] - i
        lo, hi, a, b, by = 0, most, sums[i], sums[j], powers[d]
        while lo < hi:
            m = (lo + hi + 1) >> 1
            if ((sums[i + m] - a) * by - (sums[j + m] - b)) & _MASK:
                hi = m - 1
            else:
                lo = m
        if not self.same(i, j, lo):
            lo = int(np.argmax(self.ids[i : i + lo] != self.ids[j : j + lo]))
        elif joins and lo == most:
            lo = known[1] - i
        self.reach[d] = (i, i + lo)
        return lo

    def both(self, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the words [i, i + p): how far period p goes on behind them, and before them, as the hashes have it."""
        out = []
        for back in (False, True):
            lo, hi = np.zeros(len(i), np.int64), i.copy() if back else self.n - i - p
            while (lo < hi).any():
                m = (lo + hi + 1) >> 1
                a, b = (i - m, i) if back else (i, i + m)
                same = (self.sums[b] - self.sums[a]) * self.powers[p] == self.sums[b + p] - self.sums[a + p]
                lo, hi = np.where(same, m, lo), np.where(same, hi, m - 1)
            out.append(lo)
        return out[0], out[1]


def next_smaller(ids: list[int], known: list[Extensions]) -> tuple[list[int], list[int]]:
    """For each place, the next one whose suffix is smaller (the end counts as the smallest): the longest Lyndon word from a
    place ends there. Once with the numbers as they are, once with larger ones counting as smaller. The places that lead from one to
    the next make a stack; a place whose next word is smaller in one order pops nothing of that order's stack. known has the
    sequence's extensions or nothing."""
    n = len(ids)
    up, down = list(range(1, n + 2)), list(range(1, n + 2))
    low, high = [*ids, -1], [*ids, n + 1]

    def shared(i: int, j: int) -> int:
        """Words that the suffixes from i and j share, one at least."""
        k = 1
        while low[i + k] == low[j + k]:
            k += 1
            if k == DIRECT:
                if not known:
                    known.append(Extensions(ids))
                return known[0].ahead(i, j)
        return k

    for i in range(n - 2, -1, -1):
        a, b = ids[i], ids[i + 1]
        if a <= b:
            j = i + 1 if a == b else up[i + 1]
            b = low[j]
            while a <= b:
                if a == b and low[i + (k := shared(i, j))] > low[j + k]:
                    break
                j = up[j]
                b = low[j]
            up[i] = j
            b = ids[i + 1]
        if a >= b:
            j = i + 1 if a == b else down[i + 1]
            b = high[j]
            while a >= b:
                if a == b and high[i + (k := shared(i, j))] < high[j + k]:
                    break
                j = down[j]
                b = high[j]
            down[i] = j
    del up[n:], down[n:]
    return up, down


def runs_of(ids: list[int], least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n = len(ids)
    if n < max(2, least_words):
        return []
    known: list[Extensions] = []
    ends = [np.array(x) for x in next_smaller(ids, known)]
    # A run is longer than its root by least_words / 2 words at least, so by half of that to one side.
    near = max(1, (least_words // 2 + 1) // 2)
    words = np.concatenate([-2 - np.arange(near), ids, -2 - near - np.arange(near)])  # what stands outside equals nothing
    found = []
    for end in ends:
        ahead, behind = words[near : near + n] == words[end + near], words[near - 1 : near - 1 + n] == words[end + near - 1]
        rows = np.flatnonzero(ahead | behind)
        ahead, behind, i, j = ahead[rows], behind[rows], rows + near, end[rows] + near
        for k in range(1, near):
            ahead &= words[i + k] == words[j + k]
            behind &= words[i - 1 - k] == words[j - 1 - k]
        rows = rows[ahead | behind]
        if len(rows):
            found.append(np.stack([rows, end[rows] - rows], 1))
    if not found:
        return []
    i, p = np.unique(np.concatenate(found), axis=0).T
    x = known[0] if known else Extensions(ids)
    ahead, behind = x.both(i, p)
    length = p + ahead + behind
    enough = length >= np.maximum(least_words, 2 * p)
    out = set()
    for s, size, q in np.unique(np.stack([(i - behind)[enough], length[enough], p[enough]], 1), axis=0).tolist():
        if x.same(s, s + q, size - q):
            out.add((s, size, q))
        else:  # a wrong hash: from each root that claimed this stretch
            mine = np.flatnonzero(enough & (i - behind == s) & (length == size) & (p == q))
            out |= {r for k in i[mine].tolist() if (r := _extended(ids, k, q))[1] >= max(least_words, 2 * q)}
    return sorted(out, key=lambda r: (r[0], r[2]))


def _extended(ids: list[int], i: int, p: int) -> tuple[int, int, int]:
    a, b = i, i + p
    while a and ids[a - 1] == ids[a - 1 + p]:
        a -= 1
    while b < len(ids) and ids[b] == ids[b - p]:
        b += 1
    return a, b - a, p


def kept_places(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def collapse_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with text without the words that runs repeat (kept words joined by one space), _vw_runs (array of start, length, period, by start
    and period), _vw_words and _vw_dropped (counts)."""
    if "text" not in docs.columns:
        raise ValueError("columns missing: text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, runs, count, dropped = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                raw = text.as_py()
                words = (raw or b"").split()
                found = runs_of(numbered(words), least_words)
                stay = words
                if found:
                    stay = [words[k] for k in np.flatnonzero(kept_places(len(words), found)).tolist()]
                kept.append(None if raw is None else b" ".join(stay).decode())
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                count.append(len(words))
                dropped.append(len(words) - len(stay))
            columns = [pa.array(kept, pa.string()) if f == "text" else batch.column(f) for f in batch.schema.names]
            columns += [pa.array(runs, pa.list_(_RUN)), pa.array(count, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_vw_runs", "_vw_words", "_vw_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, f"{schema.replace('`text` void', '`text` string')}, _vw_runs array<struct<start:bigint,length:bigint,period:bigint>>, _vw_words long, _vw_dropped long")
