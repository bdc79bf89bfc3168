"""A training corpus from documents: quality, recurring lines, near copies, shared passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.llm import line_templates, mixture_packing, ngram_join, quality_trees, substring_dedup
from voxweave.llm.common import Scratch, small_batches, text_key
from voxweave.llm.queries import table, vocabulary_path

#: Near copies: words of a shingle, and the least similarity in percent.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs; n_chars follows the new text."""
    out = out.select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents at hand."""
    model = quality_trees.train(docs, table(spark, sf_dir, "labels"))
    small_batches(spark)
    return quality_trees.score(docs, model).where("_vw_predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays."""
    return _like(docs, line_templates.drop_recurring(docs, Scratch(spark)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 80 % of their five-word shingles. Of each group of them the document with the smallest id stays (null ids come last, then the smallest text
    key); groups are those of the links, whatever ids they hold. Documents without words all stay."""
    scratch = Scratch(spark)
    found = scratch.keep(ngram_join.join_components(docs, scratch, NEAR_SHINGLE, NEAR_PERCENT).withColumnsRenamed({"doc_id": "_vw_id", "k1": "_vw_k1", "k2": "_vw_k2"}), "components")
    rows = found.where("comp is not null").groupBy("comp", "_vw_id", "_vw_k1", "_vw_k2").agg(F.count(F.lit(1)).alias("times"))
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("_vw_id").isNull().alias("none"), "_vw_id", "_vw_k1", "_vw_k2", "times")).alias("k"))
    first = scratch.keep(first.select("k._vw_id", "k._vw_k1", "k._vw_k2", "k.times"), "first")
    stay = first.drop("times")
    k1, k2 = text_key(F.col("text"))
    keyed = docs.withColumns({"_vw_k1": k1, "_vw_k2": k2})
    none = F.coalesce(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0
    on = keyed["doc_id"].eqNullSafe(stay["_vw_id"]) & (keyed["_vw_k1"] == stay["_vw_k1"]) & (keyed["_vw_k2"] == stay["_vw_k2"])
    kept = keyed.where(~none).join(stay.hint("shuffle_hash"), on, "left_semi")
    if not first.where("times > 1").isEmpty():  # rows that repeat id and text
        kept = kept.dropDuplicates(["doc_id", "_vw_k1", "_vw_k2"])
    return kept.select(*docs.columns).union(docs.where(none))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur again go."""
    return _like(docs, substring_dedup.remove_repeats(docs, Scratch(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences in the sources' own proportions."""
    return mixture_packing.pack(docs, vocabulary_path(), Scratch(spark))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", packing)]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
