"""Samples with the ids of a public tokenizer file. No SQL: their tests compare with plain loops."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokenizing import FileEncoder, encoded, public_vocabulary
from ..operators import samples as P
from .catalog import query, read

END, CHUNK, TURNS, HEAD = 1, 256, 200, 64


def with_ids(rows: DataFrame) -> DataFrame:
    return encoded(rows, "text", functools.partial(FileEncoder, public_vocabulary()))


def listed(column: str):
    return F.array_join(column, " ").alias(column)


@query()
def tokenized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and an end id, in pieces of at most CHUNK; labels are the ids."""
    made = P.token_chunks(with_ids(read(spark, sf_dir, "documents").select("doc_id", "text")), F.col("ids"), CHUNK, END)
    return made.select("doc_id", F.col("chunk").cast("long").alias("chunk"), listed("input_ids"), listed("labels"))


@query()
def tokenized_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in a chat template, the last TURNS ids of each conversation; the assistant's are labels."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", P.TEMPLATES["chatml"](F.col("role"), F.col("text")).alias("text"))
    made = P.labelled_turns(with_ids(turns), "conv_id", "turn", "role", F.col("ids"), TURNS)
    return made.select("conv_id", listed("input_ids"), listed("labels"))


@query()
def tokenized_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first HEAD ids of labelled documents; the label stands on the last one."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    ids, labels = P.classification(F.col("ids"), F.col("quality"), HEAD)
    return with_ids(rows).select("doc_id", ids.alias("input_ids"), labels.alias("labels")).select("doc_id", listed("input_ids"), listed("labels"))
