"""Scans: files, tables and made-up data as DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.automata import is_json_udf, tolerant_json_udf
from .shared import kept, numbered

AUDIO = (".wav", ".mp3", ".flac", ".m4a")
SEGMENT = "struct<segment_id:string,speaker:string,start:string,end:string,text:string,sentence:string,lang:string,language:string>"


def audio_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = AUDIO, recursive: bool = False) -> DataFrame:
    """path, name, stem and suffix of audio files; their content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path")
    wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
    return files.select("path", X.stem(F.col("path")).alias("stem"), X.suffix(F.col("path")).alias("suffix")).where(F.col("suffix").isin(*wanted))


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """name and value (JSON text) of every .json and .jsonl file. All go through the tolerant decoder: Spark's own parser
    takes a text whose first value is followed by others."""
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json*").select(X.stem(F.col("_metadata.file_path")).alias("name"), "value")
    return whole.select("name", tolerant_json_udf("value").alias("value"))


def segments_of(documents: DataFrame) -> DataFrame:
    """One row for each object of a document's segment list (under segment, under segments, or the document itself);
    places count before anything is dropped."""
    listed = lambda path: F.from_json(F.get_json_object("value", path), "array<string>")
    items = F.coalesce(listed("$.segment"), listed("$.segments"), F.when(F.substring(F.ltrim("value"), 1, 1) == "[", F.from_json("value", "array<string>")))
    rows = documents.select("name", F.posexplode(items).alias("ord", "raw")).where(F.ltrim("raw").startswith("{")).withColumn("s", F.from_json("raw", SEGMENT)).select("name", F.col("ord").cast("long"), "s.*")
    text, lang = F.coalesce("text", "sentence"), F.coalesce("lang", "language")
    own = F.coalesce(F.nullif("segment_id", F.lit("")), X.segment_id(F.col("name"), F.col("ord")))
    return rows.select(F.col("name").alias("doc"), "ord", own.alias("segment_id"), "speaker", X.to_float(F.col("start")).alias("start"), X.to_float(F.col("end")).alias("end"), text.alias("text"), lang.alias("lang"))


def carried(documents: DataFrame) -> DataFrame:
    """name, and of each document its meta (JSON text), num_speakers and languages, null where it has none."""
    at = lambda path: F.get_json_object("value", path)
    return documents.select("name", at("$.meta").alias("meta"), at("$.num_speakers").try_cast("long").alias("num_speakers"), F.from_json(at("$.languages"), "array<string>").alias("languages"))


def tsv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A headered table of strings; a missing required column is an error before anything runs."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="")
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return rows


def paths(spark: SparkSession, path: str, order: tuple[str, str] = ("path", "output_audio")) -> DataFrame:
    """id and path: the first present of two columns, blank ones skipped; the id is eval_id or the file's stem."""
    rows = tsv(spark, path)
    found = [X.present(F.col(c)) for c in order if c in rows.columns]
    if not found:
        raise ValueError(f"{path} has no column of {order}")
    at = F.coalesce(*found)
    own = X.present(F.col("eval_id")) if "eval_id" in rows.columns else F.lit(None).cast("string")
    folder = path.rsplit("/", 1)[0]
    full = F.when(F.col("_path").rlike(r"^(/|[a-z0-9]+:)"), F.col("_path")).otherwise(F.concat(F.lit(f"{folder}/"), "_path"))
    return rows.select(own.alias("id"), at.alias("_path")).where("_path is not null").select(F.coalesce("id", X.stem(F.col("_path"))).alias("id"), full.alias("path"))


def file_lines(rows: DataFrame) -> DataFrame:
    """rows of a file scan with _file, _block and _line, by which they are in the order of their files: Spark packs parts of
    files into tasks by size, but reads each part in order."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def lines_with_optional_header(spark: SparkSession, path: str, header: str = "path") -> DataFrame:
    """First cells of tables; a file's first line is dropped if it is the header."""
    lines = file_lines(spark.read.text(path)).withColumn("path", X.strip(F.split("value", "\t")[0]))
    lines = kept(lines.select("path", "_file", "_block", "_line"), "lines")
    firsts = lines.groupBy("_file").agg(F.min(F.struct("_block", "_line")).alias("f")).select("_file", "f.*")  # a row for each file
    heads = firsts.withColumn("_head", F.lit(True))
    return lines.join(heads, ["_file", "_block", "_line"], "left").where((F.col("path") != "") & ~(F.coalesce("_head", F.lit(False)) & (F.lower("path") == header))).select("path")


def keyed_metrics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each key (column segment_id, else eval_id), the last line winning; NaN is null."""
    key = next((c for c in ("segment_id", "eval_id") if c in rows.columns), None)
    if key is None:
        raise ValueError("neither segment_id nor eval_id is there")
    lines = file_lines(rows).withColumn("_key", X.present(F.col(key))).where("_key is not null")
    # A null would lose to an earlier line's value: the last line's number is taken with its place.
    last = lines.groupBy("_key").agg(F.max_by(F.struct(*(X.parse_float(F.col(c)).alias(c) for c in columns)), F.struct("_file", "_block", "_line")).alias("v"))
    return last.select(F.col("_key").alias("segment_id"), "v.*")


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """name and content of WAV files; wav_samples_udf reads them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    return files.select(X.stem(F.col("path")).alias("name"), "content")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """stem and content of each label file; an empty file is `none`."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(X.stem(F.col("_metadata.file_path")).alias("segment_id"), F.coalesce(X.present(F.col("value")), F.lit("none")).alias("label"))
    empty = spark.createDataFrame([(n.rsplit(".", 1)[0], "none") for n in empty_files(spark, folder, "*.txt")], "segment_id string, label string")
    return files.union(empty)


def empty_files(spark: SparkSession, folder: str, glob: str) -> list[str]:
    """Names of files without content, which Spark's scans leave out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{glob}")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [f.getPath().getName() for f in found or [] if not f.getLen()]


def filled(rows: DataFrame) -> DataFrame:
    """All values as strings, null as empty."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns))


def good_json_lines(spark: SparkSession, path: str, schema: str, skip: int = 0) -> DataFrame:
    """Rows of well-formed lines; the first `skip` good ones, in the order of files and lines, are left out."""
    rows = file_lines(spark.read.text(path)).where((F.trim("value") != "") & F.try_parse_json("value").isNotNull()).where(is_json_udf("value"))  # the first test is cheap, but takes what follows a value
    if skip:
        rows = numbered(rows, ["_file", "_block", "_line"], name="_place").where(F.col("_place") > skip)
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def dataset(spark: SparkSession, listed: str) -> DataFrame:
    """Comma-separated files or folders; the first one's suffix (or its folder's) names the format."""
    every = [p.strip() for p in listed.split(",") if p.strip()]
    kind = next((k for k in ("parquet", "jsonl", "json", "csv") if every[0].rstrip("/").endswith(k)), "parquet")
    return spark.read.format("json" if kind == "jsonl" else kind).options(**({"header": True} if kind == "csv" else {})).load(every)


def made_tokens(spark: SparkSession, rows: int, length: int, vocabulary: int, seed: int = 0) -> DataFrame:
    """Random ids of a fixed length, the same for the same seed on any cluster."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(vocabulary)))
    return spark.range(rows).select("id", ids.alias("input_ids"))


def pcm(samples: Column, bits: int) -> Column:
    """Integer samples as numbers in [-1, 1]."""
    top = float(1 << (bits - 1))
    return F.transform(samples, lambda s: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s.cast("double") / top)))


def blocks(samples: Column, size: int, before: int = 0, behind: int = 0) -> Column:
    """Fixed blocks of samples, with so many zeros before and behind; the last block is filled with zeros."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    padded = F.concat(zeros(F.lit(before)), samples, zeros(F.lit(behind))) if before or behind else samples

    def cut(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x) - 1), F.lit(size))
        return F.transform(starts, lambda s: F.concat(F.slice(x, s + 1, size), zeros(F.greatest(F.lit(0), size - (F.size(x) - s)))))

    return F.flatten(F.transform(F.array(padded), cut))


RECORD = T.StructType([T.StructField("index", T.StringType()), T.StructField("source_name", T.StringType()), T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("loss_mask", T.LongType())]))), T.StructField("meta", T.StringType())])
