"""Exact top-k search by incremental multi-index hashing of binary codes.

A vector's code has a bit for every component above zero. In each block of the index the codes are filed under each of their
SEGMENTS; a query probes all segments at radius 0, 1, 2 and so on. After radius r every code within m * (r + 1) - 1 bits has
been met and verified, m being the number of segments, so the search ends when the kth verified distance is that small.

Equal codes share one entry that keeps the k smallest ids (kept per task first, so a code that a third of all rows have is
never gathered); only those can be among a query's k. The index is dealt over blocks of about BLOCK codes, the queries over
blocks of about ASKED; every pair of blocks is searched by itself, and each query's answers are merged: a query set against
all rows, in blocks.

Null vectors and null ids are neither filed nor asked; shorter vectors than the longest are padded with zero bits;
ties are broken by the smaller id; a query is among its own answers, as all rows are searched; repeated rows are answers
each; with fewer than k rows all are returned; empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch_of, groups_of, need

K, EVERY = 10, 100
#: Codes of the index, and queries, in a block.
BLOCK, ASKED = 1 << 18, 1 << 16


def codes_of(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and codes (rows of 64-bit words) of the rows that have both."""
    batch = batch.filter(pc.and_(pc.is_valid(batch.column("id")), pc.is_valid(batch.column("vector"))))
    ids, vector = batch.column("id").to_numpy(), batch.column("vector")
    size = pc.list_value_length(vector).to_numpy().astype(np.int64)
    on = pc.fill_null(pc.greater(vector.flatten(), 0), False).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(ids)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    words = -(-bits // 64)
    out = np.zeros((len(ids), words * 64), np.uint8)
    out[row[on], place[on]] = 1
    return ids, np.packbits(out, 1).view("<u8").reshape(len(ids), words)


def coded(rows: DataFrame, bits: int, k: int | None) -> DataFrame:
    """(id, code: binary); with k, only each task's k smallest ids of a code."""
    schema = pa.schema([("id", pa.int64()), ("code", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[int]] = {}
        for b in batches:
            ids, codes = codes_of(b, bits)
            packed = [c.tobytes() for c in codes]
            if not k:
                yield batch_of(schema, [ids, packed])
                continue
            for i, c in zip(ids.tolist(), packed, strict=True):
                best.setdefault(c, []).append(i)
            for c in set(packed):
                if len(best[c]) > k:
                    best[c] = sorted(best[c])[:k]
            if len(best) > 200_000:
                yield batch_of(schema, [[i for v in best.values() for i in v], [c for c, v in best.items() for _ in v]])
                best.clear()
        yield batch_of(schema, [[i for v in best.values() for i in v], [c for c, v in best.items() for _ in v]])

    return rows.mapInArrow(run, "id long, code binary")


class MultiIndex:
    """Different codes of one block, filed under each segment."""

    def __init__(self, codes: np.ndarray, times: np.ndarray):
        self.codes, self.times, n = codes, times, len(codes)
        bits = codes.shape[1] * 64
        self.size = min(16, max(4, int(math.log2(max(2, n)))))
        self.edges = np.linspace(0, bits, -(-bits // self.size) + 1).astype(int)
        flat = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
        self.segments, self.order, self.bounds = [], [], []
        for a, b in itertools.pairwise(self.edges):
            value = flat[:, a:b].astype(np.int64) @ (1 << np.arange(b - a))
            self.segments.append((int(a), int(b - a)))
            self.order.append(np.argsort(value, kind="stable"))
            self.bounds.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << (b - a)))]))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def probes(self, width: int, radius: int) -> np.ndarray:
        if (width, radius) not in self.masks:
            self.masks[width, radius] = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(width), radius)], np.int64)
        return self.masks[width, radius]

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entry, distance) of all entries up to the distance of the kth row."""
        bits = np.unpackbits(code.view(np.uint8), bitorder="little").astype(np.int64)
        seen, found, far = np.zeros(len(self.codes), bool), [], []
        for radius in range(self.size + 2):
            for (a, width), order, bounds in zip(self.segments, self.order, self.bounds, strict=True):
                if radius > width:
                    continue
                value = (bits[a : a + width] @ (1 << np.arange(width))) ^ self.probes(width, radius)
                start, size = bounds[value], bounds[value + 1] - bounds[value]
                start, size = start[size > 0], size[size > 0]
                if not len(start):
                    continue
                at = order[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                at = at[~seen[at]]
                seen[at] = True
                found.append(at)
                far.append(np.bitwise_count(self.codes[at] ^ code).sum(1, dtype=np.int64))
            if found:
                entry, distance = np.concatenate(found), np.concatenate(far)
                rank = np.argsort(distance, kind="stable")
                rows = np.cumsum(self.times[entry[rank]])
                kth = int(np.searchsorted(rows, k))
                if len(entry) == len(self.codes) or kth < len(rank) and distance[rank[kth]] <= len(self.segments) * (radius + 1) - 1:
                    most = distance[rank[min(kth, len(rank) - 1)]]
                    return entry[distance <= most], distance[distance <= most]
        return entry, distance


def top_k(rows: DataFrame, scratch: Scratch, id_column: str, vector_column: str, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, neighbor_id, distance, rank of the k nearest rows of each row whose id is divisible by `every`."""
    rows = need(rows, id_column, vector_column).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    bits = rows.select(F.max(F.size("vector"))).first()[0]
    bits = bits if bits and bits > 0 else 64
    entries = coded(rows, bits, k).withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("rank") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = scratch.keep(entries, "entries")
    asked = coded(rows.where(F.col("id") % every == 0), bits, None)
    blocks, parts = (max(1, math.ceil(n / size)) for n, size in ((entries.count(), BLOCK), (rows.where(F.col("id") % every == 0).count(), ASKED)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    index = entries.select(dealt("code", blocks).alias("block"), all_of(parts).alias("part"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("id"), "code", "ids")
    asked = asked.select(all_of(blocks).alias("block"), dealt("id", parts).alias("part"), F.lit(1).alias("role"), "id", "code", F.lit(None).cast("array<long>").alias("ids"))
    schema = pa.schema([("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = None, []
        for (*_, role), group in groups_of(batches, 3, ["block", "part", "role", "id", "code", "ids"]):
            codes = np.frombuffer(b"".join(r[4] for r in group), "<u8").reshape(len(group), -1)
            if role == 0:
                ids = [r[5] for r in group]
                index = MultiIndex(codes, np.array([len(i) for i in ids]))
                continue
            out: list[list[int]] = [[], [], []]
            for r, code in zip(group, codes, strict=True):
                if index is None:
                    break
                best = sorted((d, i) for e, d in zip(*(x.tolist() for x in index.search(code, k)), strict=True) for i in ids[e])[:k]
                out[0] += [r[3]] * len(best)
                out[1] += [i for _, i in best]
                out[2] += [d for d, _ in best]
            yield batch_of(schema, out)
            index = None

    # Every block has its entries before its queries.
    near = index.union(asked).repartition("block", "part").sortWithinPartitions("block", "part", "role").mapInArrow(run, "query_id long, neighbor_id long, distance long")
    over = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return near.withColumn("rank", F.row_number().over(over).cast("long")).where(F.col("rank") <= k)
