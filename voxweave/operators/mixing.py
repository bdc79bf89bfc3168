"""Sources, shards and order: deterministic on any number of partitions."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digits
from ..sources.shared import numbered


@dataclasses.dataclass(frozen=True)
class Mixture:
    """Sources by name with weights; weights that change are a schedule that is known, but not yet of use."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    schedule: str = "const"

    def __post_init__(self) -> None:
        if len(self.names) != len(self.weights):
            raise ValueError("each source needs a weight")
        if len(set(self.names)) != len(self.names):
            raise ValueError("source names repeat")
        if self.schedule not in ("const", "changing"):
            raise ValueError(f"no such schedule as {self.schedule}")
        if any(w <= 0 for w in self.weights):
            raise ValueError("weights must be positive")


def interleave(rows: DataFrame, source: str, order: list[str], mix: Mixture) -> DataFrame:
    """Rows of the mixture's sources in proportion to their weights, until the first source is exhausted."""
    if mix.schedule != "const":
        raise ValueError("only constant weights are implemented")
    weight = F.element_at(F.create_map(*(F.lit(x) for p in zip(mix.names, mix.weights, strict=True) for x in p)), F.col(source))
    index = F.array_position(F.array(*map(F.lit, mix.names)), F.col(source)) - 1
    tagged = numbered(rows.where(F.col(source).isin(*mix.names)), order, source, "turn").withColumn("ds_idx", index.cast("long")).withColumn("turn", F.col("turn") / weight)
    ends = tagged.groupBy(source).agg(F.max("turn").alias("end")).agg(F.min("end").alias("last"))
    return tagged.crossJoin(F.broadcast(ends)).where(F.col("turn") <= F.col("last")).drop("last")  # one row


def shuffled_rank(key: Column, seed: int, epoch: int = 0) -> Column:
    """A place in an order drawn anew for each epoch, the same on every cluster."""
    return digits(F.lit(seed + epoch), key)


def contiguous_shard(place: Column, total: int, n: int) -> Column:
    return F.floor(place / -(-total // n)).cast("long")


def repeat(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def keep_last(steps: DataFrame, by: str, n: int, best: str | None = None) -> DataFrame:
    """Which checkpoints stay: the last n, and the best one."""
    w = Window.orderBy(F.desc(by))
    keep = F.row_number().over(w) <= n
    if best:
        keep = keep | (F.row_number().over(Window.orderBy(F.asc_nulls_last(best), by)) == 1)
    return steps.withColumn("keep", keep)
