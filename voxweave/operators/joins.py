"""Lookups, enrichment and existence filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def lookup(rows: DataFrame, labels: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """value of each row's key, the default where there is none; and whether it is missing (equal to the default)."""
    found = rows.join(last_of_key(labels, [key], None).select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit(default)))
    return found.withColumn("missing", F.col(value) == default)


def last_of_key(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key: the last in order, or any if keys are known to be unique."""
    if order is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def enrich(rows: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Left joins of several keyed tables; what is missing is null."""
    for t in tables:
        rows = rows.join(t, key, "left")
    return rows


def gather_all(rows: DataFrame, ids: Column, key: str, table: DataFrame, value: str, row_key: list[str]) -> DataFrame:
    """values: those of all ids of a row in their order; rows with an id that is not in the table are dropped."""
    parts = rows.select(*row_key, F.posexplode(ids).alias("_place", key)).join(table.select(key, F.col(value).alias("_value")), key, "left")
    whole = parts.groupBy(*row_key).agg(F.array_sort(F.collect_list(F.struct("_place", "_value"))).alias("_all"), F.count("_value").alias("_found"), F.count(F.lit(1)).alias("_n")).where("_found = _n")
    return rows.join(whole.select(*row_key, F.transform("_all", lambda x: x["_value"]).alias("values")), row_key)


def without_done(rows: DataFrame, key: str, done: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Rows whose key has neither a result nor (if given) a failure marker."""
    rows = rows.join(done.select(key).distinct(), key, "left_anti")
    return rows if failed is None else rows.join(failed.select(key).distinct(), key, "left_anti")


def existing(rows: DataFrame, key: str, listing: DataFrame) -> DataFrame:
    return rows.join(listing.select(key).distinct(), key, "left_semi")


def by_priority(rows: DataFrame, key: str, files: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """path: of the files with the row's key the one whose suffix comes first in priority."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("suffix"))
    best = files.where(rank > 0).groupBy(key).agg(F.min_by("path", F.struct(rank, "path")).alias("path"))
    return rows.join(best, key)


def zip_by_place(places: DataFrame, values: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The nth placeholder of a row and type takes the nth value of that row and type."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return places.withColumn("nth", nth).join(values.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("index"))).drop("index"), [*keys, "nth"], "left")


def through_experts(sent: DataFrame, token: list[str], expert: str, work: Column, weight: str) -> DataFrame:
    """Rows (a token at one of its experts) dealt by ranges of expert and token, so that an expert's rows fill as many tasks as they
    need, sorted there, worked on, and back as a weighted sum."""
    worked = sent.repartitionByRange(expert, *token).sortWithinPartitions(expert, *token).withColumn("_y", work)
    return worked.groupBy(*token).agg(F.sum(F.col(weight) * F.col("_y")).alias("mixed"))


def with_fallback(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, own: Column) -> DataFrame:
    """value: that of the row's key in the table if it is there and not empty, else the row's own."""
    found = table.select(F.col(table_key).alias(key), F.col(value).alias("_first"))
    return rows.join(found, key, "left").withColumn(value, F.coalesce(F.nullif("_first", F.lit("")), F.nullif(own, F.lit("")), F.lit(""))).drop("_first")


def in_order(items: DataFrame, key: str, order: tuple[str, ...], unknown: bool = False) -> DataFrame:
    """Rank of each row's key in a fixed list; unknown keys go, or come last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(key))
    ranked = items.withColumn("rank", F.when(place > 0, place).otherwise(len(order) + 1).cast("long"))
    return ranked if unknown else ranked.where(F.col("rank") <= len(order))


def nearest(rows: DataFrame, value: str, grid: DataFrame, point: str) -> DataFrame:
    """Each row's closest grid point, the smaller of two, however far it is.

    Points and rows are sorted together by ranges of values; a range takes the last point before it and the first one behind
    it from the other ranges' ends, of which there is one row each.
    """
    both = rows.select("*", F.lit(None).cast("double").alias("_p"), F.col(value).cast("double").alias("_x"))
    points = grid.select(F.col(point).cast("double").alias("_p"), F.col(point).cast("double").alias("_x")).where("_x is not null")
    ranged = both.unionByName(points, allowMissingColumns=True).repartitionByRange("_x").withColumn("_part", F.spark_partition_id())
    ranged = kept(ranged, "nearest")
    ends = ranged.groupBy("_part").agg(F.min("_p").alias("_min"), F.max("_p").alias("_max"))
    ends = ends.withColumn("_before", F.max("_max").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_behind", F.min("_min").over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)))
    # Both frames begin at the range's edge: one that ends there is summed up anew for every row.
    up, down = (Window.partitionBy("_part").orderBy(c).rangeBetween(Window.unboundedPreceding, 0) for c in ("_x", F.desc("_x")))
    low, high = F.coalesce(F.max("_p").over(up), F.col("_before")), F.coalesce(F.min("_p").over(down), F.col("_behind"))
    found = ranged.join(F.broadcast(ends.drop("_min", "_max")), "_part").withColumn("_l", low).withColumn("_h", high).where(F.col("_p").isNull())  # a row for each range
    pick = F.when(F.col("_h").isNull() | (F.col("_x") - F.col("_l") <= F.col("_h") - F.col("_x")), F.col("_l")).otherwise(F.col("_h"))
    return found.withColumn("nearest", pick).select(*rows.columns, "nearest")


def all_reduced(df: DataFrame, step: str, worker: str, value: str) -> DataFrame:
    """(step, worker, own, total, greatest, mean, gathered): each worker's sum of value in a step, and what all workers of the
    step have together; gathered holds their sums in the order of workers, of which there must be few (one for each process).

    Workers without rows in a step take no part in it. Nulls count in no sum, greatest or mean, and stand in gathered.
    """
    own = df.groupBy(step, worker).agg(F.sum(value).alias("own"))  # summed before the shuffle; then one row for each worker
    together = own.groupBy(step).agg(
        F.sum("own").alias("total"), F.max("own").alias("greatest"), F.avg("own").alias("mean"), F.array_sort(F.collect_list(F.struct(worker, "own"))).alias("each")
    )
    rows = together.withColumn("at", F.explode("each"))
    return rows.select(step, F.col("at")[worker].alias(worker), F.col("at.own").alias("own"), "total", "greatest", "mean", F.col("each.own").alias("gathered"))
