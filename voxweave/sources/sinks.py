"""Sinks: files with resume, dead letters and counters."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_filename
from .shared import numbered, write_text


def write_parts(rows: DataFrame, path: str, key: str, mode: str = "error", rows_per_file: int = 20_000) -> int:
    """Parquet parts of bounded size. mode: error, overwrite, or resume (rows whose key is there already are left out).

    Returns how many rows were written."""
    spark, seen = rows.sparkSession, Observation()
    if mode == "resume":
        if _exists(spark, path):
            rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").mode("append" if mode == "resume" else mode).parquet(path)
    return seen.get["n"]


def write_counted(rows: DataFrame, path: str, order: list[str], mode: str = "error", rows_per_file: int = 20_000, most: int | None = None) -> int:
    """Parquet parts of rows in order, `most` of them at most. mode resume counts the rows that are there (from the files'
    footers) and goes on behind them; overwrite wipes them; error fails if there are any. Returns how many rows were written."""
    spark, seen = rows.sparkSession, Observation()
    done = spark.read.parquet(path).count() if mode == "resume" and _exists(spark, path) else 0
    places = numbered(rows, order, name="_place").where(F.col("_place") > done)
    if most is not None:
        places = places.where(F.col("_place") <= done + most)
    out = places.select(*rows.columns).observe(seen, F.count(F.lit(1)).alias("n")).write.option("maxRecordsPerFile", rows_per_file).option("compression", "snappy")
    out.mode("append" if mode == "resume" else mode).parquet(path)
    return seen.get["n"]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_json_files(rows: DataFrame, path: str) -> None:
    """One file for each row (name, value: JSON text), named after it; each is written aside and then renamed, so a file is
    whole or not there, and a task that runs again only writes it again."""
    named = rows.select(safe_filename(F.col("name")).alias("name"), "value")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, value in zip(b.column("name").to_pylist(), b.column("value").to_pylist(), strict=True):
                aside = f"{base}/.{name}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(aside) as out:
                    out.write(json.dumps(json.loads(value), ensure_ascii=False, indent=2).encode())
                store.move(aside, f"{base}/{name}.json")
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], names=["n"])

    named.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_tsv(rows: DataFrame, path: str) -> None:
    """Doubles with six decimals, null as nan."""
    number = lambda c: F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("nan"))
    rows.select(*(number(c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes)).write.csv(path, sep="\t", header=True, lineSep="\n", quote="", emptyValue="")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def counted(rows: DataFrame, **counters: object) -> tuple[DataFrame, Observation]:
    """rows with counters (name -> condition) that are known once an action has run."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("total"), *(F.count(F.when(c, 1)).alias(n) for n, c in counters.items())), seen


def split_failures(scored: DataFrame, result: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a result, and the dead letters without one."""
    return scored.where(F.col(result).isNotNull()), scored.where(F.col(result).isNull()).drop(result)


def retried(rows: DataFrame, score, valid, fallback) -> DataFrame:
    """Score, score the invalid ones once more, then fall back. score adds column `answer`; valid is a condition on it."""
    first = score(rows)
    good = first.where(valid(F.col("answer")))
    again = score(first.where(~F.coalesce(valid(F.col("answer")), F.lit(False))).drop("answer"))
    return good.unionByName(again.withColumn("answer", F.when(valid(F.col("answer")), F.col("answer")).otherwise(fallback)))


def write_markers(failed: DataFrame, path: str, key: str, reason: str) -> None:
    """A marker for each failed key, with the reason; later runs add to them."""
    failed.select(F.col(key).cast("string").alias("key"), F.lit(reason).alias("error")).write.mode("append").parquet(path)


def read_markers(spark: SparkSession, path: str, key: str, kind: str = "string") -> DataFrame:
    """Keys that have a marker; none if nothing ever failed."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{key} {kind}")
    return spark.read.parquet(path).select(F.col("key").cast(kind).alias(key)).distinct()


def write_script(rows: DataFrame, path: str, name: str, most: int = 10_000) -> None:
    """rows as a script that sets window.<name>; a page holds at most `most` items, more are an error."""
    items = [r["j"] for r in rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).limit(most + 1).collect()]
    if len(items) > most:
        raise ValueError(f"more than {most} items for one page")
    write_text(rows.sparkSession, path, f"window.{name} = {{\"items\":[{','.join(items)}]}};\n")
