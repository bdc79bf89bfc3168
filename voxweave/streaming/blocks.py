"""Structured Streaming: windows over timed blocks, and packing with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import folder


def tumbling(stream: DataFrame, time: str, key: str, value: str, size: str, late: str) -> DataFrame:
    """Count and sum for each window and key; rows later than `late` are dropped, so state stays bounded."""
    w = F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(stream: DataFrame, time: str, key: str, value: str, size: str, step: str, late: str) -> DataFrame:
    w = F.window(time, size, step)
    return stream.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("largest")).select(F.col("window.start").alias("start"), key, "n", "largest")


def pack(stream: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Batches of at most `budget` tokens, each trigger's rows in order, the open batch kept as state between triggers."""
    out = f"{key} long, batch long, {order} long, {size} long"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch, used = state.get if state.exists else (0, 0)
        pdf, got = pd.concat(list(frames)).sort_values(order), []  # the key's rows of one trigger
        for n in pdf[size].tolist():
            if used and used + n > budget:
                batch, used = batch + 1, 0
            used += n
            got.append(batch)
        state.update((batch, used))
        yield pd.DataFrame({key: k[0], "batch": got, order: pdf[order].tolist(), size: pdf[size].tolist()})

    return stream.groupBy(key).applyInPandasWithState(run, out, "batch long, used long", "append", "NoTimeout")


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, into: str | None = None) -> DataFrame:
    """Everything available now, as a table in the shared folder; with a checkpoint and the same folder a later call goes on
    from there. In mode complete the last batch is the result, in mode append all batches are."""
    spark, schema = stream.sparkSession, stream.schema
    path = into or folder(spark, "stream")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/vw_trigger={0 if mode == 'complete' else batch}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint or folder(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def accumulate(stream: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Annotations as they come, merged with those before of the same key: after each trigger the covered range so far and
    how many annotations it holds."""
    out = f"{key} long, n long, first double, last double"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, low, high = state.get if state.exists else (0, float("inf"), float("-inf"))
        for pdf in frames:
            n, low, high = n + len(pdf), min(low, float(pdf[start].min())), max(high, float(pdf[end].max()))
        state.update((n, low, high))
        yield pd.DataFrame({key: [k[0]], "n": [n], "first": [low], "last": [high]})

    return stream.groupBy(key).applyInPandasWithState(run, out, "n long, low double, high double", "update", "NoTimeout")
