"""A bounded shuffle buffer: the order in which a streaming loader hands out rows, node by node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import numbered
from .mixing import contiguous_shard


def draw(seed: int, node: int, what: str) -> int:
    return int(hashlib.md5(f"{seed}:{node}:{what}".encode()).hexdigest()[:8], 16)


class Buffer:
    """Rows of one node as they come: once the buffer is full, each new row takes the place of a drawn one, which goes out."""

    def __init__(self, seed: int, node: int, size: int):
        self.seed, self.node, self.size = seed, node, size
        self.held: pa.RecordBatch | None = None
        self.seen = self.gone = 0

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        every = batch if self.held is None else pa.concat_batches([self.held, batch])
        slots, out = list(range(len(every) - len(batch))), []
        for k in range(len(every) - len(batch), len(every)):
            if len(slots) < self.size:
                slots.append(k)
            else:
                j = draw(self.seed, self.node, str(self.seen)) % self.size
                out.append(slots[j])
                slots[j] = k
            self.seen += 1
        self.held = every.take(pa.array(slots, pa.int64()))
        return self._placed(every.take(pa.array(out, pa.int64())))

    def rest(self) -> pa.RecordBatch:
        order = sorted(range(len(self.held)), key=lambda j: (draw(self.seed, self.node, f"end {j}"), j))
        return self._placed(self.held.take(pa.array(order, pa.int64())))

    def _placed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        places = np.arange(self.gone, self.gone + len(rows))
        self.gone += len(rows)
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(np.full(len(rows), self.node), pa.int64()), pa.array(places)], names=[*rows.schema.names[:-1], "node", "place"])


def shuffled(rows: DataFrame, order: list[str], nodes: int, seed: int, epoch: int = 0, size: int = 10_000) -> DataFrame:
    """rows with node and place: each node has a contiguous part of the rows in order, and hands it out through a buffer of `size` rows.
    The draws depend on seed, epoch and node alone, so the order is the same on any cluster; a task holds one buffer."""
    total = rows.count()
    placed = numbered(rows, order, name="_place").withColumn("_node", contiguous_shard(F.col("_place") - 1, max(1, total), nodes))
    dealt = placed.repartition(nodes, "_node").sortWithinPartitions("_node", "_place").drop("_place")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer: Buffer | None = None
        for b in batches:
            node = b.column("_node").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    if buffer is None or buffer.node != int(node[i]):
                        if buffer:
                            yield buffer.rest()
                        buffer = Buffer(seed + epoch, int(node[i]), size)
                    yield buffer.add(b.slice(i, j - i))
        if buffer:
            yield buffer.rest()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, node long, place long")
