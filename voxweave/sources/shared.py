"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only a local session without that setting (tests) gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="voxweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, computed once: values that depend on how rows lie in partitions stay what they are."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    at = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # when the driver ends
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """rows spread over the whole cluster by a hash of all columns that have one: a compressed file's part may hold many times its
    size, and a scan has no more tasks than such parts."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *(f"`{n}`" for n, kind in rows.dtypes if "map<" not in kind and "variant" not in kind))


def write_text(spark: SparkSession, path: str, text: str | bytes) -> str:
    """A small file by Hadoop's file system, so on any store."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(text.encode() if isinstance(text, str) else text))
    out.close()
    return path


def numbered(rows: DataFrame, order: list[str], by: str | None = None, name: str = "number") -> DataFrame:
    """Places from 1 in order, within each value of `by` if given, without one task for all or for a hot value.

    Rows are dealt by ranges of (by, order); each range's counts, one row for a range and value, give where its rows begin.
    """
    keys = [by, *order] if by else list(order)
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    ranged = kept(ranged, "numbered").withColumn("_part", F.shiftright("_id", 33))
    group = [by] if by else []
    parts = ranged.groupBy("_part", *group).agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", *(F.col(g).alias(f"_{g}") for g in group), "_low", before.alias("_before"))
    on = ranged["_part"] == parts["_part"]
    for g in group:
        on = on & ranged[g].eqNullSafe(parts[f"_{g}"])
    return ranged.join(parts, on).select(*rows.columns, (F.col("_id") - F.col("_low") + F.col("_before") + 1).alias(name))
