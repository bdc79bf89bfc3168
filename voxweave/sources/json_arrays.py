"""One JSON array of objects in files of any size, read by many tasks.

Spark cuts files into splits and a split into pieces that end with "}", which its text reader does for any separator, on any store.
Where a piece begins inside a string follows from the number of quotes before it, and how deep it begins from the brackets before it
that are no part of a string: two running sums, within each split and over the splits' totals, of which there is one row each. Pieces that
hold a whole object are parsed where they are; only objects with objects inside them are put together by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import file_lines
from .shared import kept


def _running(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """pieces with the sum of `value` over all pieces before each one in its file."""
    inside = Window.partitionBy("_file", "_block").orderBy("_line")
    rows = pieces.withColumn("_within", F.sum(value).over(inside) - F.col(value))
    splits = pieces.groupBy("_file", "_block").agg(F.sum(value).alias("_sum"))
    before = splits.select("_file", "_block", (F.sum("_sum").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_sum")).alias("_before"))
    return rows.join(before, ["_file", "_block"]).withColumn(name, F.col("_within") + F.col("_before")).drop("_within", "_before")


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that hold one array each, in no order. An item that is no object, one that doesn't have the schema's
    form, a file that holds something else, ends too early or goes on behind the array is an error; blank files have no rows; commas
    too many do no harm."""
    pieces = file_lines(spark.read.option("lineSep", "}").text(path))
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # a sign behind a backslash counts for nothing
    pieces = _running(kept(pieces.withColumn("_quotes", _count(plain, '"')), "pieces"), "_quotes", "_open")
    # Each string becomes one quote; a piece that begins inside one has its end only.
    outside = F.regexp_replace(F.when(F.col("_open") % 2 == 1, F.concat(F.lit('"'), plain)).otherwise(plain), r'"[^"]*("|$)', '"')
    ends = pieces.groupBy("_file").agg(F.max(F.struct("_block", "_line")).alias("_end"))  # a row for each file
    pieces = pieces.join(ends, "_file").withColumns({"_final": F.col("_end") == F.struct("_block", "_line"), "_outside": outside})
    closes = ((F.col("_open") + F.col("_quotes")) % 2 == 0) & ~F.col("_final")
    pieces = pieces.withColumn("_delta", _count(F.col("_outside"), "{[") - _count(F.col("_outside"), "]}") - closes.cast("int")).withColumn("_closes", closes)
    pieces = _running(kept(pieces.drop("_open", "_quotes", "_end"), "depths"), "_delta", "_depth")
    whole = F.col("_closes") & (F.col("_depth") + F.col("_delta") == 1)
    pieces = _running(pieces.withColumn("_whole", whole.cast("long")), "_whole", "_item")

    depth, text, lead = F.col("_depth"), F.col("_outside"), F.regexp_replace("_outside", r"(?s)\{.*", "")
    begins = F.when(depth == 0, lead.rlike(r"^\s*\[[\s,]*$")).when(depth == 1, lead.rlike(r"^[\s,]*$")).otherwise(depth > 1) & ((depth > 1) | text.contains("{"))
    ended = F.when(depth == 0, text.rlike(r"^\s*(\[[\s,]*\]\s*)?$")).otherwise((depth == 1) & text.rlike(r"^[\s,]*\]\s*$"))
    flaw = F.when(F.col("_final") & ~ended, F.lit("ends within the array, or an item is no object")).when(~F.col("_final") & ~begins, F.lit("an item is no object, or there is no array"))
    head = F.when(depth <= 1, F.regexp_replace("value", r"(?s)^[^{]*", "")).otherwise(F.col("value"))
    pieces = pieces.select("_file", "_block", "_line", "_item", "_final", flaw.alias("_flaw"), head.alias("_head"), ((F.col("_whole") == 1) & (depth <= 1)).alias("_alone"))
    alone = pieces.where("_alone or _flaw is not null").select("_file", "_flaw", F.concat("_head", F.lit("}")).alias("_json"))
    parts = pieces.where("not _alone and not _final and _flaw is null").groupBy("_file", "_item").agg(F.array_sort(F.collect_list(F.struct("_block", "_line", "_head"))).alias("_all"))
    parts = parts.select("_file", F.lit(None).cast("string").alias("_flaw"), F.concat(F.array_join(F.transform("_all", lambda x: x["_head"]), "}"), F.lit("}")).alias("_json"))
    told = F.when(F.col("_flaw").isNull(), F.col("_json")).otherwise(F.raise_error(F.concat("_file", F.lit(": "), "_flaw")))
    return alone.union(parts).select(F.from_json(told, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
