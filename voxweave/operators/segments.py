"""Operators over segments: one row for each turn, with its document, place, speaker, start, end and text.

Order inside a document is always an explicit list of columns; every operator partitions by document, so a chain of them
shares one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.automata import split_long


def with_gap(segments: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """gap: start minus the previous segment's end, null if either is."""
    return segments.withColumn("gap", F.col("start") - F.lag("end").over(Window.partitionBy(doc).orderBy(*order)))


def gap_threshold(gaps: DataFrame, doc: str, least: float, share: float = 0.95) -> DataFrame:
    """Per document max(least, percentile of gaps with linear interpolation); least without gaps."""
    return gaps.groupBy(doc).agg(F.greatest(F.coalesce(F.percentile("gap", share), F.lit(0.0)), F.lit(float(least))).alias("t_gap"))


def gap_blocks(segments: DataFrame, doc: str, order: list[str], least: float, share: float = 0.95) -> DataFrame:
    """block: how many gaps of the threshold or more came before. The threshold is a window over the document, so the
    exchange by document serves both."""
    gaps, whole = with_gap(segments, doc, order), Window.partitionBy(doc)
    t = F.greatest(F.coalesce(F.percentile("gap", share).over(whole), F.lit(0.0)), F.lit(float(least)))
    cut = F.coalesce((F.col("gap") >= F.col("t_gap")).cast("long"), F.lit(0))
    return gaps.withColumn("t_gap", t).withColumn("block", F.sum(cut).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def capped_blocks(blocks: DataFrame, doc: str, order: list[str], most: int = 100) -> DataFrame:
    """chunk: pieces of at most `most` segments inside each block."""
    place = F.row_number().over(Window.partitionBy(doc, "block").orderBy(*order)) - 1
    return blocks.withColumn("place", place.cast("long")).withColumn("chunk", F.floor(F.col("place") / most))


def two_level_scenes(blocks: DataFrame, cuts: DataFrame, doc: str, order: list[str], short: float) -> DataFrame:
    """scene: 0 in documents shorter than `short`, else the running count of cuts (doc, block, at: place in the block)."""
    whole = Window.partitionBy(doc)
    length = F.max("end").over(whole) - F.min(F.coalesce("start", F.lit(0))).over(whole)
    placed = capped_blocks(blocks, doc, order).withColumn("length", length)
    cuts = cuts.select(doc, "block", F.col("at").alias("place"), F.lit(1).alias("cut")).distinct()
    found = placed.join(cuts, [doc, "block", "place"], "left")
    running = F.sum(F.coalesce("cut", F.lit(0))).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("scene", F.when(F.col("length") < short, F.lit(0)).otherwise(running).cast("long"))


def merge_turns(segments: DataFrame, doc: str, order: list[str], max_gap: float, shortest: float) -> DataFrame:
    """Runs of one speaker with gaps up to max_gap; shorter turns are dropped first. A run ends where its last turn ends."""
    w = Window.partitionBy(doc).orderBy("start", *order)
    kept = segments.where(F.col("end") - F.col("start") > shortest)
    same = (F.lag("speaker").over(w) == F.col("speaker")) & (F.col("start") - F.lag("end").over(w) <= max_gap)
    runs = kept.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("end", F.struct("start", *order))
    return runs.groupBy(doc, "island").agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), last.alias("end"), F.count(F.lit(1)).alias("turns"))


def fold_short_turns(segments: DataFrame, doc: str, order: list[str], short: float, near: float, long: float, before: float, near_before: float, most: float = math.inf, hop: float = 1.0, loud: Column | None = None) -> DataFrame:
    """Turns folded into the one before, which depends on how long that has become: a pass over the sorted document.

    A turn shorter than `short` with the same speaker, a gap under `near` and a predecessor under `long` extends it; so does
    any turn of the same speaker after a predecessor shorter than `before`, within `near_before`. A turn longer than `most` becomes pieces
    of at most that (see split_long; loud: of its frames of length hop), none of which extends what is before it.
    """
    frames = F.array().cast("array<boolean>") if loud is None else loud
    rows = segments.select(doc, *order, F.col("start").cast("double").alias("_start"), F.col("end").cast("double").alias("_end"), "speaker", frames.alias("_loud"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the open turn is held, however long a document is."""
        key, place, last, kind = None, 0, None, None

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.int64()), *(pa.array([x[2][k] for x in out], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.string())))], names=[doc, "place", "start", "end", "speaker"])

        for b in batches:
            out, kind = [], b.column(doc).type
            for k, start, end, speaker, frames in zip(*(b.column(c).to_pylist() for c in (doc, "_start", "_end", "speaker", "_loud")), strict=True):
                pieces = [(start + x, start + y) for x, y in split_long(0.0, end - start, frames or [], hop, most)] if end - start > most else []
                if last is not None and k == key and not pieces:
                    size, gap = last[1] - last[0], start - last[1]
                    if speaker == last[2] and ((end - start < short and gap < near and size < long) or (size < before and gap < near_before)):
                        last = (last[0], max(last[1], end), speaker)
                        continue
                for start, end in pieces or [(start, end)]:
                    if last is not None:
                        out.append((key, place, last))
                    place = place + 1 if last is not None and k == key else 0
                    key, last = k, (start, end, speaker)
            yield made(out)
        if last is not None:
            yield made([(key, place, last)])

    return rows.repartition(doc).sortWithinPartitions(doc, *order).mapInArrow(run, f"{doc} {segments.schema[doc].dataType.simpleString()}, place long, start double, end double, speaker string")


def normalized(rows: DataFrame, doc: Column, place: Column, aliases: dict[str, tuple[str, str]]) -> DataFrame:
    """Segment columns from raw ones: null texts and languages take their alias, blank ids their document and place."""
    pick = {name: F.coalesce(F.col(a), F.col(b)) if a in rows.columns and b in rows.columns else F.col(a if a in rows.columns else b) for name, (a, b) in aliases.items()}
    own = F.nullif(F.col("segment_id").cast("string"), F.lit("")) if "segment_id" in rows.columns else F.lit(None).cast("string")
    return rows.select(doc.alias("doc"), place.alias("ord"), F.coalesce(own, T.segment_id(doc, place)).alias("segment_id"), *(c.alias(n) for n, c in pick.items()))


def same_speaker_reference(segments: DataFrame, doc: str, ord: str) -> DataFrame:
    """reference: the first segment of the same speaker whose text differs without white space; else the segment itself.

    Linear: per speaker the first segment, and the first whose text differs from that; one of the two is always it."""
    norm = segments.withColumn("norm", T.without_space(F.coalesce("text", F.lit(""))))
    firsts = norm.groupBy(doc, "speaker", "norm").agg(F.min(ord).alias("at"))
    w = Window.partitionBy(doc, "speaker").orderBy("at")
    two = firsts.withColumn("rank", F.row_number().over(w)).where("rank <= 2 and speaker is not null")
    two = two.groupBy(doc, "speaker").agg(F.min_by("norm", "rank").alias("norm1"), F.min("at").alias("at1"), F.max(F.when(F.col("rank") == 2, F.col("at"))).alias("at2"))
    return norm.join(two, [doc, "speaker"], "left").withColumn("reference", F.coalesce(F.when(F.col("norm") != F.col("norm1"), F.col("at1")).otherwise(F.col("at2")), F.col(ord))).drop("norm", "norm1", "at1", "at2")


def speakers_by_appearance(segments: DataFrame, keys: list[str], ord: str, first: int, name: str = "rank") -> DataFrame:
    """Number of each speaker by first appearance within keys, counted from `first`; null speakers have none."""
    seen = segments.where(F.col("speaker").isNotNull()).groupBy(*keys, "speaker").agg(F.min(ord).alias("at"))
    ranked = seen.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1 + first).cast("long")).drop("at")
    return segments.join(ranked, [*keys, "speaker"], "left")


def trailing_context(segments: DataFrame, keys: list[str], ord: str, value: Column, size: int = 5) -> DataFrame:
    """context: the values of the segment and up to size - 1 before it."""
    return segments.withColumn("context", F.collect_list(value).over(Window.partitionBy(*keys).orderBy(ord).rowsBetween(-(size - 1), 0)))


def relabel_by_neighbours(rows: DataFrame, ord: str, vector: str, label: str, reach: int = 5, least: float = 0.7, bucket: int = 1000) -> DataFrame:
    """label of the most similar of the neighbours up to `reach` places away, if similar enough; the earliest of equals.

    Places are filed in buckets, each row also in those it reaches, so the join is on equality and no row meets all others."""
    own = rows.select(F.col(ord).alias("o"), F.col(vector).alias("v"), F.col(label).alias("l"), F.floor(F.col(ord) / bucket).alias("b"))
    other = rows.select(F.col(ord).alias("p"), F.col(vector).alias("u"), F.col(label).alias("m"), F.explode(F.array_distinct(F.array(F.floor((F.col(ord) - reach) / bucket), F.floor(F.col(ord) / bucket), F.floor((F.col(ord) + reach) / bucket)))).alias("b"))
    near = own.join(other, "b").where((F.abs(F.col("o") - F.col("p")) <= reach) & (F.col("o") != F.col("p"))).withColumn("s", T.cosine(F.col("v"), F.col("u")))
    best = near.where(F.col("s") >= least).groupBy("o").agg(F.max_by("m", F.struct("s", -F.col("p"))).alias("new_label"))
    return rows.join(best, rows[ord] == best["o"], "left").drop("o").withColumn("new_label", F.coalesce("new_label", label))
