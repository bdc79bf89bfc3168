"""Streaming queries with state, and Python sources and sinks of files, with their SQL."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resampling
from ..operators import features as V
from ..sources import json_arrays, tar_shards
from ..sources.arrow_files import ArrowFiles
from ..sources.shared import dealt, folder
from ..sources.wav_sink import WavFiles
from ..streaming import audio, buffers
from ..streaming import blocks as B
from .catalog import first_fit_sql, query, read


def bracketed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's items as one array; the comma behind the last one does no harm."""
    edge = lambda sign: pa.RecordBatch.from_pydict({"value": [sign]})
    return itertools.chain([edge("[")], batches, [edge("]")])


@query("SELECT doc_id AS id, source, n_chars AS n, text FROM documents")
def source_json_array(spark, sf_dir):
    """Files that hold one array each, written by every task and read by as many tasks as their size asks for."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.struct("source", F.col("n_chars").alias("n")).alias("meta"), "text")
    path = folder(spark, "array")
    dealt(docs.select(F.concat(F.to_json(F.struct("*")), F.lit(",")).alias("value"))).mapInArrow(bracketed, "value string").write.text(path)
    return json_arrays.json_array(spark, path, "id long, meta struct<source:string,n:long>, text string").select("id", "meta.source", "meta.n", "text")


def in_parts(spark: SparkSession, rows: DataFrame, order: str, parts: int) -> tuple[str, list[DataFrame]]:
    """A folder, and rows in so many parts of the order, to be put into it one after another."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.col(order) - low) * parts / (high - low + 1))
    return folder(spark, "incoming"), [rows.where(part == i) for i in range(parts)]


E_FIT = f"z AS (SELECT user_id % 8 AS shard, event_id AS ord, 1 + (event_id * 37) % 90 AS n FROM events), {first_fit_sql(256, 8, False, 'f')}"


@query(f"WITH RECURSIVE {E_FIT} SELECT shard, batch, ord, n FROM f")
def stream_token_buffer(spark, sf_dir):
    """Batches of a token budget from a stream that is ended and started again twice: the buffer goes on from its state, and what is
    left at the end is drained."""
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("shard"), F.col("event_id").alias("ord"), (1 + F.col("event_id") * 37 % 90).alias("n"))
    path, parts = in_parts(spark, rows, "ord", 3)
    checkpoint, into = folder(spark, "progress"), folder(spark, "batches")
    for part in parts:
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        with buffers.list_state(spark):
            done = B.drain(buffers.token_batches(stream, "shard", "ord", "n", 256), "append", checkpoint, into)
    return done.unionByName(buffers.left_batches(spark, checkpoint, "shard", "ord", "n", 256))


def loud(samples):
    if samples.max() > 0.45:
        raise ValueError("too loud")
    return (samples > 0).sum()


@query("""WITH b AS (SELECT vec_id % 7 AS source, row_number() OVER (PARTITION BY vec_id % 7 ORDER BY vec_id) - 1 AS i, embedding FROM embeddings),
    s AS (SELECT source, sum(len(embedding)) OVER (PARTITION BY source ORDER BY i) - len(embedding) AS base, embedding, unnest(range(0, len(embedding))) AS k FROM b),
    x AS (SELECT source, CAST(base + k AS BIGINT) AS pos, embedding[k + 1] AS v FROM s), d AS (SELECT source, max(pos) + 1 AS n FROM x GROUP BY source),
    c AS (SELECT source, n, unnest(range(0, CAST(greatest(1, ceil((n - 150 + 60) / 60.0)) AS BIGINT))) AS chunk FROM d)
    SELECT c.source, c.chunk, count(*) AS length, CASE WHEN max(v) > CAST(0.45 AS DOUBLE) THEN NULL ELSE CAST(count(*) FILTER (WHERE v > 0) AS DOUBLE) END AS value, CASE WHEN max(v) > CAST(0.45 AS DOUBLE) THEN 'too loud' END AS error
    FROM c JOIN x ON c.source = x.source AND x.pos >= c.chunk * 60 AND x.pos < c.chunk * 60 + 150 GROUP BY c.source, c.chunk""")
def stream_chunks(spark, sf_dir):
    """Blocks of several sources cut into overlapping chunks by a stream that is ended and started again; chunks that fail are records."""
    rows = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("source"), F.col("vec_id").alias("block"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    ends = rows.groupBy("source").agg(F.max("block").alias("end"))  # seven rows
    path, parts = in_parts(spark, rows.join(ends, "source").withColumn("last", F.col("block") == F.col("end")).drop("end"), "block", 2)
    checkpoint, into = folder(spark, "progress"), folder(spark, "chunks")
    for part in parts:
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(parts[0].schema).parquet(path)
        with buffers.list_state(spark):
            done = B.drain(audio.processed(audio.chunked(stream, "source", "long", 150, 60), "source", "long", loud), "append", checkpoint, into)
    return done


@query("""WITH s AS (SELECT vec_id, embedding[1 + 8 * (vec_id % 2) : 24 + 8 * (vec_id % 3)] AS x FROM embeddings WHERE vec_id % 9 <> 0),
    n AS (SELECT vec_id, len(x) AS n, CAST(ceil((len(x) + 7) / 16.0) AS BIGINT) AS blocks, list_transform(x, lambda v: greatest(-32768, least(32767, round_even(CAST(v AS DOUBLE) * 32768, 0)))) AS q FROM s),
    b AS (SELECT vec_id, n, q, blocks, unnest(range(0, blocks)) AS block FROM n)
    SELECT CAST(vec_id AS VARCHAR) AS name, block, block * 16 / 16000.0 AS start, block = blocks - 1 AS last, CAST(coalesce(list_sum(q[greatest(0, block * 16 - 4) + 1 : block * 16 + 12]), 0) AS BIGINT) AS total FROM b""")
def stream_wav_blocks(spark, sf_dir):
    """Segments cut from audio become WAV files; a stream reads them as blocks, with silence around, and goes on where it was ended."""
    spark.dataSource.register(WavFiles)
    spark.dataSource.register(audio.WavBlocks)
    i, rate = F.col("vec_id"), 16_000
    cut = V.cut_samples(F.transform("embedding", lambda x: x.cast("double")), F.lit(rate), i % 2 * 8 / rate, F.when(i % 9 == 0, 0.0).otherwise((24 + 8 * (i % 3)) / rate))
    rows = read(spark, sf_dir, "embeddings").select(i.cast("string").alias("name"), cut.alias("samples"), (i % 2).alias("part")).where("samples is not null")
    path, checkpoint, into = folder(spark, "segments"), folder(spark, "progress"), folder(spark, "blocks")
    for part in (rows.where("name < '5'"), rows.where("name >= '5'")):  # files come in the order of their names
        part.select("name", "samples").write.format("wav_files").mode("append").option("path", path).save()
        stream = spark.readStream.format("wav_blocks").options(path=path, block="16", before="4", behind="3").load()
        made = stream.select("name", "block", "start", "last", F.aggregate("samples", F.lit(0.0), lambda t, x: t + x * 32768).cast("long").alias("total"))
        done = B.drain(made, "append", checkpoint, into)
    return done


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def source_arrow_files(spark, sf_dir):
    """Arrow files that every task has written, in two folders; the first one's schema counts."""
    spark.dataSource.register(ArrowFiles)
    paths = []
    for name, columns in (("orders", ("o_orderkey", "o_custkey", "o_totalprice")), ("customer", ("c_custkey", "c_nationkey", "c_acctbal"))):
        paths.append(folder(spark, name))
        rows = read(spark, sf_dir, name).select(*(F.col(c).cast(k).alias(n) for c, n, k in zip(columns, ("o_orderkey", "o_custkey", "o_totalprice"), ("long", "long", "double"), strict=True)))
        rows.write.format("arrow_files").mode("append").option("path", paths[-1]).save()
    return spark.read.format("arrow_files").option("path", ", ".join(paths)).option("batches", 2).load()


D_SQL = "d AS (SELECT doc_id, text, source, row_number() OVER (ORDER BY 'd/' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) - 1 AS i, count(*) OVER () AS n FROM documents)"


@query(f"WITH {D_SQL} SELECT doc_id, source, sha256(coalesce(text, '')) AS digest, CAST(i + r * n AS BIGINT) AS place FROM d, range(0, 3) t(r) WHERE i + r * n < n * 5 // 2")
def source_tar_shards(spark, sf_dir):
    """Shards written from documents, two members a sample, cut between samples and read as an epoch of two and a half times their number."""
    spark.dataSource.register(tar_shards.TarShards)
    path, docs = folder(spark, "shards"), read(spark, sf_dir, "documents")
    key = F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    text, about = F.coalesce("text", F.lit("")).cast("binary"), F.to_json(F.struct("doc_id", "source")).cast("binary")
    rows = docs.select(key.alias("key"), F.lit("").alias("shard"), F.create_map(F.lit("txt"), text, F.lit("info.json"), about).alias("members"))
    rows.write.format("tar_shards").mode("append").option("path", path).option("samples", 150).save()
    found = spark.read.format("tar_shards").option("path", path).option("bytes", 100_000).load()
    info = F.from_json(F.col("members")["info.json"].cast("string"), "doc_id long, source string")
    made = found.select("key", info.alias("i"), F.sha2(F.col("members")["txt"], 256).alias("digest"))
    made = tar_shards.virtual_epoch(made.select("key", "i.doc_id", "i.source", "digest"), ["key"], docs.count() * 5 // 2)
    return made.select("doc_id", "source", "digest", F.col("_place").alias("place"))


#: The filter from 2 to 3: a sinc of width 3 under a Kaiser window of 5, its Bessel function by its series.
H_SQL = """i0 AS (SELECT m, CASE WHEN m = 0 THEN 1.0 ELSE sin(pi() * m / 3) / (pi() * m / 3) END * list_sum(list_transform(range(0, 30), lambda k: power(power(2.5 * sqrt(1 - (m / 30.0) * (m / 30.0)), k) / gamma(k + 1), 2))) AS h FROM range(-30, 31) t(m)),
    h AS (SELECT m, 3 * h / (SELECT sum(h) FROM i0) AS h FROM i0)"""


@query(f"""WITH {H_SQL}, x AS (SELECT vec_id, len(embedding) AS n, embedding, unnest(range(0, len(embedding))) AS k FROM embeddings),
    y AS (SELECT vec_id, (k * 3 + m) // 2 AS place, sum(embedding[k + 1] * h) AS v FROM x JOIN h ON (k * 3 + m) % 2 = 0 AND k * 3 + m >= 0 AND (k * 3 + m) // 2 < ceil(n * 3 / 2.0) GROUP BY 1, 2)
    SELECT vec_id, CAST(place AS BIGINT) AS place, round(v, 6) AS v FROM y""")
def resampled(spark, sf_dir):
    """From rate 2 to rate 3 by a polyphase filter."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    made = resampling.by_length(rows, "x", lambda x: resampling.resample(x, 2, 3))
    return made.select("vec_id", F.posexplode("made").alias("place", "v")).select("vec_id", F.col("place").cast("long").alias("place"), F.round("v", 6).alias("v"))


@query("""WITH f AS (SELECT vec_id, embedding, unnest(range(0, 11)) AS frame FROM embeddings), s AS (SELECT vec_id, frame, unnest(range(0, 32)) AS i, embedding FROM f),
    x AS (SELECT vec_id, frame, i, CASE WHEN frame * 16 + i - 16 BETWEEN 0 AND 159 THEN embedding[(frame * 16 + i - 16) % len(embedding) + 1] ELSE 0 END * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS v FROM s)
    SELECT vec_id, frame, round(log10(greatest(1e-7, sqrt(power(sum(v * cos(2 * pi() * 3 * i / 32)), 2) + power(sum(v * sin(2 * pi() * 3 * i / 32)), 2)))), 5) AS third FROM x GROUP BY vec_id, frame""")
def fixed_spectrum(spark, sf_dir):
    """Samples said again up to one length, cut there, and one frequency of their frames."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    made = resampling.by_length(rows, "x", lambda x: resampling.log_spectrum(resampling.fitted(x, 160), 32, 16)[:, :, 3])
    return made.select("vec_id", F.posexplode("made").alias("frame", "v")).select("vec_id", F.col("frame").cast("long").alias("frame"), F.round("v", 5).alias("third"))
