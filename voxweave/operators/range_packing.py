"""Order-dependent packing of shards of any size, in many tasks, with the batches of a single pass.

Rows are cut into ranges of (shard, order). What a packer carries from one range into the next is small: the samples that
wait. Every range first runs from an empty carry, then from the carry its predecessor ended with, as long as that changes; packers forget
where they began after some batches, so two or three rounds do for ranges of thousands of samples. Each round settles one more range
of a shard at least, so the batches are exact whether packers forget or not. Batch numbers follow from the ranges' counts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

Sample = tuple[int, int]  # order, tokens
#: (samples, carry, is the last range) -> (sample and batch from 0 on, carry, batches that are closed)
Packer = Callable[[list[Sample], list[Sample], bool], tuple[list[tuple[int, int, int]], list[Sample], int]]

_CARRY = "array<struct<ord:bigint,n:bigint>>"


def first_fit(budget: int, buffer: int, force: bool) -> Packer:
    """A batch goes once `buffer` samples and `budget` tokens wait, or at the end: in order of arrival all that fit, with force the first
    whatever its size; else samples over the budget go."""

    def run(samples: list[Sample], carry: list[Sample], last: bool) -> tuple[list[tuple[int, int, int]], list[Sample], int]:
        waiting, tokens, out, batch = list(carry), sum(n for _, n in carry), [], 0

        def take() -> None:
            nonlocal waiting, tokens, batch
            used, rest = 0, []
            for s in waiting:
                if used + s[1] <= budget or force and not used:
                    used += s[1]
                    out.append((*s, batch))
                else:
                    rest.append(s)
            waiting, tokens, batch = rest, tokens - used, batch + 1

        for s in samples:
            if s[1] > budget and not force:
                continue
            waiting.append(s)
            tokens += s[1]
            while len(waiting) >= buffer and tokens >= budget:
                take()
        while last and waiting:
            take()
        return out, waiting, batch

    return run


def next_fit(budget: int) -> Packer:
    """A batch ends where the next sample doesn't fit; samples over the budget go. The carry is one entry: the open batch's tokens."""

    def run(samples: list[Sample], carry: list[Sample], last: bool) -> tuple[list[tuple[int, int, int]], list[Sample], int]:
        used, batch, out = sum(n for _, n in carry), 0, []
        for ord, n in samples:
            if n > budget:
                continue
            if used + n > budget:
                batch, used = batch + 1, 0
            used += n
            out.append((ord, n, batch))
        return out, [(0, used)] if used else [], batch

    return run


def pack(rows: DataFrame, shard: str, order: str, size: str, packer: Packer, ranges: int | None = None) -> DataFrame:
    """(shard, order, size, batch) of all samples that are packed; order is unique within a shard. ranges: their number, if not as many
    as shuffles have partitions."""
    need = rows.select(F.col(shard).cast("long").alias("shard"), F.col(order).cast("long").alias("ord"), F.col(size).cast("long").alias("n"))
    dealt = need.repartitionByRange(ranges, "shard", "ord") if ranges else need.repartitionByRange("shard", "ord")
    dealt = kept(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    none = F.array().cast(_CARRY)
    parts = dealt.select("shard", "part").distinct()  # a row for each range of a shard, here and below
    ends = parts.groupBy("shard").agg(F.max("part").alias("end"))
    parts = kept(parts.join(ends, "shard").select("shard", "part", (F.col("part") == F.col("end")).alias("last"), none.alias("carry")), "parts")

    def over(states: DataFrame, schema: str, put: Callable[[pd.Series, tuple], pd.DataFrame]) -> DataFrame:
        def run(samples: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            if not len(state):
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            at = state.iloc[0]
            carry = [(int(c["ord"]), int(c["n"])) for c in at["carry"]]
            return put(at, packer(list(samples.sort_values("ord")[["ord", "n"]].itertuples(index=False, name=None)), carry, bool(at["last"])))

        # A range that needs no run isn't read into a group.
        some = dealt.join(states.select("shard", "part"), ["shard", "part"], "left_semi")
        return some.groupBy("shard", "part").cogroup(states.groupBy("shard", "part")).applyInPandas(run, schema)

    def counted(at: pd.Series, got: tuple) -> pd.DataFrame:
        _, carry, batches = got
        return pd.DataFrame({"shard": [at["shard"]], "part": [at["part"]], "last": [at["last"]], "carry": [at["carry"]], "after": [[{"ord": o, "n": n} for o, n in carry]], "batches": [batches]})

    table = f"shard long, part int, last boolean, carry {_CARRY}, after {_CARRY}, batches long"
    done = kept(over(parts, table, counted), "carries")
    along = Window.partitionBy("shard").orderBy("part")
    while True:
        moved = done.withColumn("before", F.coalesce(F.lag("after").over(along), none))
        again = kept(moved.where("before <> carry").select("shard", "part", "last", F.col("before").alias("carry")), "again")
        if again.isEmpty():
            break
        done = kept(done.join(again.select("shard", "part"), ["shard", "part"], "left_anti").unionByName(over(again, table, counted)), "carries")
    first = done.select("shard", "part", "last", "carry", (F.sum("batches").over(along) - F.col("batches")).alias("first"))

    def placed(at: pd.Series, got: tuple) -> pd.DataFrame:
        return pd.DataFrame([(at["shard"], o, n, at["first"] + b) for o, n, b in got[0]], columns=["shard", "ord", "n", "batch"])

    return over(first, "shard long, ord long, n long, batch long", placed).select(F.col("shard").alias(shard), F.col("ord").alias(order), F.col("n").alias(size), "batch")
