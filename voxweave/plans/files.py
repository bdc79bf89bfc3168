"""Queries that write small files in the shared folder and read them back, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.automata import wav_samples_udf
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.shared import folder, write_text
from ..sources.wav_sink import WavFiles
from .catalog import query, read


@query("""SELECT 'u' || user_id AS segment_id, (array_agg(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END ORDER BY event_id DESC))[1] AS score FROM events WHERE event_id % 11 <> 0 GROUP BY user_id""")
def source_keyed_metrics(spark, sf_dir):
    """Tables of scores in order; the last line of a key wins, by its place in the files, and lines without a key don't count."""
    i, path = F.col("event_id"), folder(spark, "metrics")
    rows = read(spark, sf_dir, "events").orderBy("event_id").select(F.when(i % 11 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(" ").alias("segment_id"), F.lit("x").alias("eval_id"), F.when(i % 7 == 0, "nan").otherwise(F.col("value").cast("string")).alias("score"))
    rows.write.csv(path, sep="\t", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return R.keyed_metrics(R.tsv(spark, path, ("segment_id",)), ["score"])


@query("SELECT 'c' || c_custkey || '.wav' AS path FROM customer")
def source_optional_header(spark, sf_dir):
    """Lists of paths, one with a header and some without; blank lines don't count."""
    rows, path = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".wav\ttext")).alias("value")), folder(spark, "header")
    head = spark.range(1).select(F.lit("PATH\ttext\n").alias("value"))
    head.union(rows.where("c_custkey % 2 = 0").select("value")).coalesce(1).write.text(f"{path}/with")
    rows.where("c_custkey % 2 = 1").select("value").write.text(f"{path}/without")
    return R.lines_with_optional_header(spark, f"{path}/*")


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey >= 3")
def source_good_lines(spark, sf_dir):
    """Bad and blank lines don't count; the first three good ones are left out."""
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    lines = [x for r in rows for x in (json.dumps({"id": r["n_nationkey"]}), *(["", "{bad", '{"id": 99} x'] if r["n_nationkey"] % 5 == 0 else []))]
    path = write_text(spark, f"{folder(spark, 'lines')}/l.jsonl", "\n".join(lines) + "\n")
    return R.good_json_lines(spark, path, "id long", 3)


@query("SELECT n_name AS segment_id, CASE WHEN n_nationkey % 4 = 0 THEN 'none' ELSE 'region ' || n_regionkey END AS label FROM nation")
def source_labels(spark, sf_dir):
    """A label file for each nation; empty files are labels, too."""
    path = folder(spark, "labels")
    for r in read(spark, sf_dir, "nation").collect():  # 25 rows
        write_text(spark, f"{path}/{r['n_name']}.txt", "" if r["n_nationkey"] % 4 == 0 else f" region {r['n_regionkey']}\n")
    return R.labels(spark, path)


@query("""WITH s AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings) SELECT 'v' || vec_id AS name, CAST(8000 AS BIGINT) AS rate, count(*) AS n, CAST(sum(greatest(-32768, least(32767, round_even(CAST(v AS DOUBLE) * 32768, 0)))) AS BIGINT) AS total FROM s GROUP BY vec_id""")
def source_wav(spark, sf_dir):
    """Samples written as WAV files by every task, and read again."""
    spark.dataSource.register(WavFiles)
    path = folder(spark, "wav")
    rows = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    rows.write.format("wav_files").mode("append").option("path", path).option("rate", "8000").save()
    found = R.wav_files(spark, path).withColumn("s", wav_samples_udf("content"))
    return found.select("name", F.col("s.rate").alias("rate"), F.size("s.samples").cast("long").alias("n"), F.aggregate("s.samples", F.lit(0.0), lambda t, x: t + x * 32768).cast("long").alias("total"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id < 150")
def sink_parts_resume(spark, sf_dir):
    """Parts of bounded size: a first run ends early, the next one goes on behind the rows that are there."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    path = f"{folder(spark, 'parts')}/out"
    K.write_counted(rows, path, ["doc_id"], "error", 20, most=70)
    K.write_counted(rows, path, ["doc_id"], "resume", 20, most=80)
    return spark.read.parquet(path)


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id")
def sink_json_files(spark, sf_dir):
    """One JSON file for each document, written aside and then renamed."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("segments"))
    path = folder(spark, "json")
    K.write_json_files(rows.select(F.concat(F.lit("doc/"), F.col("conv_id").cast("string")).alias("name"), F.to_json(F.struct("conv_id", "segments")).alias("value")), path)
    back = spark.read.text(path, wholetext=True, pathGlobFilter="doc_*.json")
    got = F.from_json("value", "conv_id long, segments array<struct<turn:long,role:string>>")
    return back.select(got.alias("d")).select("d.conv_id", F.size("d.segments").cast("long").alias("turns"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id % 50 = 0")
def source_many_paths(spark, sf_dir):
    """Several folders, the format by the first."""
    a, b = f"{folder(spark, 'a')}/x.parquet", f"{folder(spark, 'b')}/y.parquet"
    read(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select("o_orderkey", "o_custkey").write.parquet(a)
    read(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("o_orderkey"), F.col("n_chars").alias("o_custkey")).write.parquet(b)
    return R.dataset(spark, f"{a}, {b}")


def _documents(spark, sf_dir):
    """A document for each region, in five shapes, most of them not quite JSON; its segments are the nations, with a number in between."""
    found = read(spark, sf_dir, "nation").orderBy("n_regionkey", "n_nationkey").collect()  # 25 rows
    path = folder(spark, "documents")
    for k in sorted({r["n_regionkey"] for r in found}):
        own = [r for r in found if r["n_regionkey"] == k]
        rows = [json.dumps({"start": str(r["n_nationkey"] / 2), "end": r["n_nationkey"], "sentence" if r["n_nationkey"] % 2 else "text": r["n_name"], "speaker": f"s{k}"}) for r in own]
        rows.insert(1, "7")
        listed = ", ".join(rows)
        carried = f'"meta": {{"sample_rate": {8000 + k}}}, "num_speakers": {len(own)}, "languages": ["en", "l{k}"]'
        shapes = [f'{{"segments": [{listed}], {carried}}}', f'{{"segment": [{listed}], {carried}}} and more', f"[{listed}]", "\n".join(x for x in rows if x != "7") + ",\n", f'{{"segments": [{listed}]}}']
        write_text(spark, f"{path}/r{k}.{'jsonl' if k % 5 == 3 else 'json'}", shapes[k % 5])
    return R.json_documents(spark, path)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation), o AS (SELECT *, CAST(CASE WHEN i > 0 AND n_regionkey % 5 <> 3 THEN i + 1 ELSE i END AS INTEGER) AS ord FROM n)
    SELECT 'r' || n_regionkey AS doc, ord, 'r' || n_regionkey || '_' || lpad(CAST(ord AS VARCHAR), 6, '0') AS segment_id, 's' || n_regionkey AS speaker, n_nationkey / 2.0 AS start, CAST(n_nationkey AS DOUBLE) AS "end", n_name AS text FROM o""")
def source_segments(spark, sf_dir):
    """Places count before anything is dropped."""
    found = R.segments_of(_documents(spark, sf_dir))
    return found.select("doc", F.col("ord").cast("int").alias("ord"), "segment_id", "speaker", "start", "end", "text")


@query("""SELECT 'r' || n_regionkey AS name, '{"sample_rate":' || (8000 + n_regionkey) || '}' AS meta, CAST(count(*) AS INTEGER) AS num_speakers, 'en,l' || n_regionkey AS languages FROM nation WHERE n_regionkey % 5 < 2 GROUP BY n_regionkey
    UNION ALL SELECT DISTINCT 'r' || n_regionkey, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM nation WHERE n_regionkey % 5 >= 2""")
def source_document_info(spark, sf_dir):
    found = R.carried(_documents(spark, sf_dir))
    return found.select("name", "meta", F.col("num_speakers").cast("int").alias("num_speakers"), F.array_join("languages", ",").alias("languages"))


@query("SELECT vec_id, CAST(ceil((len(embedding) + 5) / 16.0) AS BIGINT) AS n, CAST(CAST(ceil((len(embedding) + 5) / 16.0) AS BIGINT) * 16 AS BIGINT) AS samples, CAST(0 AS DOUBLE) AS first FROM embeddings")
def sample_blocks(spark, sf_dir):
    """Blocks of 16 samples with three zeros before and two behind."""
    made = R.blocks(F.transform("embedding", lambda x: x.cast("double")), 16, 3, 2)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", made.alias("b"))
    return rows.select("vec_id", F.size("b").cast("long").alias("n"), F.size(F.flatten("b")).cast("long").alias("samples"), F.col("b")[0][0].alias("first"))
