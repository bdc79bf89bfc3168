"""A token-budget loader as a streaming query: the buffer of waiting samples is state, and what is left at the end is drained."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Sample = tuple[int, int]  # place, tokens


@contextmanager
def list_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which lists of state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def take(waiting: list[Sample], budget: int, force: bool) -> tuple[list[Sample], list[Sample]]:
    """(batch, rest): in order of arrival all that fit; with force the first whatever its size."""
    batch, rest, used = [], [], 0
    for sample in waiting:
        if used + sample[1] <= budget or force and not used:
            batch.append(sample)
            used += sample[1]
        else:
            rest.append(sample)
    return batch, rest


class TokenBuffer(StatefulProcessor):
    """Per key: waiting samples, their tokens and the number of the next batch. A batch goes out once `buffer` samples and `budget`
    tokens wait. Tokens are counted by themselves and compared with the samples whenever a buffer is read again."""

    def __init__(self, key: str, order: str, size: str, budget: int, buffer: int, force: bool):
        self.names, self.budget, self.buffer, self.force = (key, order, size), budget, buffer, force

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "ord long, n long")
        self.counts = handle.getValueState("counts", "tokens long, batch long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        name, order, size = self.names
        waiting: list[Sample] = [(int(a), int(b)) for a, b in self.waiting.get()] if self.waiting.exists() else []
        tokens, batch = self.counts.get() if self.counts.exists() else (0, 0)
        if tokens != sum(n for _, n in waiting):
            raise ValueError(f"the buffer of {key[0]} holds {sum(n for _, n in waiting)} tokens instead of {tokens}")
        out: list[tuple] = []
        for ord, n in pd.concat(list(rows)).sort_values(order)[[order, size]].itertuples(index=False):  # one trigger's rows of one key
            if n > self.budget and not self.force:
                continue
            waiting.append((int(ord), int(n)))
            tokens += int(n)
            while len(waiting) >= self.buffer and tokens >= self.budget:
                taken, waiting = take(waiting, self.budget, self.force)
                tokens -= sum(n for _, n in taken)
                out += [(key[0], batch, *x) for x in taken]
                batch += 1
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        self.counts.update((tokens, batch))
        yield pd.DataFrame(out, columns=[name, "batch", order, size])

    def close(self) -> None:
        pass


def token_batches(stream: DataFrame, key: str, order: str, size: str, budget: int, buffer: int = 8, force: bool = False) -> DataFrame:
    """(key, batch, order, size) of a stream whose triggers come in order; samples over the budget go unless forced. Start it
    inside list_state."""
    rows = stream.select(F.col(key).cast("long"), F.col(order).cast("long"), F.col(size).cast("long")).groupBy(key)
    return rows.transformWithStateInPandas(TokenBuffer(key, order, size, budget, buffer, force), f"{key} long, batch long, {order} long, {size} long", "Append", "None")


def left_batches(spark: SparkSession, checkpoint: str, key: str, order: str, size: str, budget: int, force: bool = False) -> DataFrame:
    """The batches of what still waits when a stream has ended, read from the state of its last trigger; buffers are bounded."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    waiting = read("waiting").select(F.col(f"key.{key}").alias(key), "list_element.*").withColumn("_place", F.monotonically_increasing_id())
    rows = waiting.join(read("counts").select(F.col(f"key.{key}").alias(key), "value.batch"), key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        rest, batch, out = list(pdf[["ord", "n"]].itertuples(index=False, name=None)), int(pdf["batch"].iloc[0]), []
        while rest:
            taken, rest = take(rest, budget, force)
            out += [(pdf[key].iloc[0], batch, *x) for x in taken]
            batch += 1
        return pd.DataFrame(out, columns=[key, "batch", order, size])

    return rows.groupBy(key).applyInPandas(run, f"{key} long, batch long, {order} long, {size} long")
