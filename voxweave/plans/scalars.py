"""Queries over names, numbers, signals and conversations of public datasets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conversations as C
from ..functions import text as X
from ..functions.automata import split_long_udtf, split_point_udf
from ..operators import joins as J
from .catalog import query, read


def flat(messages):
    """role[type:value|...] of each message, by line feeds."""
    piece = lambda p: F.concat(p["type"], F.coalesce(F.concat(F.lit(":"), p["value"]), F.lit("")))
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("["), F.array_join(F.transform(m["parts"], piece), "|"), F.lit("]"))), "\n")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN turn % 3 = 0 THEN 'image|text:' ELSE 'text:' END || text AS parts FROM conversations),
    f AS (SELECT conv_id, min(turn) AS t FROM c GROUP BY 1), s AS (SELECT c.conv_id AS k FROM c JOIN f ON c.conv_id = f.conv_id AND c.turn = f.t WHERE role <> 'user')
    SELECT c.conv_id, string_agg(role || '[' || parts || ']', chr(10) ORDER BY turn) AS messages FROM c JOIN f ON c.conv_id = f.conv_id WHERE NOT (c.turn = f.t AND c.role = 'assistant') GROUP BY c.conv_id""")
def conversation_marked(spark, sf_dir):
    """Messages with marks become images and texts; a first message that isn't the user's is skipped."""
    value = F.concat(F.when(F.col("turn") % 3 == 0, C.MARK).otherwise(""), "text")
    who = F.when(F.col("role") == "assistant", "gpt").otherwise("human")
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", who.alias("from"), value.alias("value")))).alias("m"))
    raw = F.to_json(F.transform("m", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))))
    made = rows.select("conv_id", C.conversation(F.lit("sharegpt4v_sft"), raw, F.col("conv_id"), ("doom", "sharegpt4v_sft")).alias("c"))
    return made.where(F.size("c") > 0).select("conv_id", flat("c").alias("messages"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN turn % 3 = 1 THEN 'image' ELSE 'text:t' || turn END AS part FROM conversations),
    g AS (SELECT *, sum(CASE WHEN role = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'user') AS before FROM c)),
    r AS (SELECT conv_id, run, role, CASE WHEN role = 'assistant' THEN string_agg(part, '|text:

|' ORDER BY turn) ELSE string_agg(part, '|' ORDER BY turn) END AS parts FROM g GROUP BY 1, 2, 3),
    z AS (SELECT conv_id, 0 AS run, 'user' AS role, '' AS parts FROM r GROUP BY conv_id HAVING min(run) > 0)
    SELECT conv_id, string_agg(role || '[' || parts || ']', chr(10) ORDER BY run) AS messages FROM (SELECT * FROM r UNION ALL SELECT * FROM z) GROUP BY conv_id""")
def conversation_runs(spark, sf_dir):
    """Neighbouring messages of one role are merged."""
    value = F.when(F.col("turn") % 3 == 1, C.MARK).otherwise(F.concat(F.lit("t"), F.col("turn").cast("string")))
    who = F.when(F.col("role") == "assistant", "gpt").otherwise("human")
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", who.alias("from"), value.alias("value")))).alias("m"))
    raw = F.to_json(F.transform("m", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))))
    return rows.select("conv_id", flat(C.SOURCES["doom"](raw, F.col("conv_id"))).alias("messages"))


@query("""SELECT doc_id, 'user[text:' || CASE WHEN CAST(('0x' || left(md5(doc_id || ':short'), 8)) AS BIGINT) % 100 < 25 THEN split_part(text, '.', 1) ELSE text END || ']' || chr(10) || 'assistant[image]' AS messages FROM documents""")
def conversation_captions(spark, sf_dir):
    """Captions to draw, some of them cut at the first stop."""
    return read(spark, sf_dir, "documents").select("doc_id", flat(C.SOURCES["journeydb"](F.col("text"), F.col("doc_id"))).alias("messages"))


@query("""SELECT p_partkey, replace(replace(p_name, ' ', '_'), '/', '_') AS safe, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN p_retailprice ELSE NULL END AS number,
    CASE p_partkey % 3 WHEN 0 THEN 'Speaker-' || (p_size + 1) WHEN 1 THEN 'Speaker-' || (p_size + 1) ELSE p_brand END AS speaker, CASE WHEN p_partkey % 2 = 0 THEN trim(p_type) ELSE '' END AS answer FROM part""")
def names_and_numbers(spark, sf_dir):
    """File names, numbers that may be blank or NaN or no number, speaker labels, and what follows a mark."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    number = F.when(k % 4 == 0, " ").when(k % 4 == 1, "nan").when(k % 4 == 2, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).otherwise("NaN ")
    label = F.when(k % 3 == 0, F.concat(F.lit("SPEAKER_"), F.lpad(size, 2, "0"))).when(k % 3 == 1, F.concat(F.lit("speaker"), size)).otherwise(F.col("p_brand"))
    raw = F.concat(F.lit("noise "), F.when(k % 2 == 0, "Answer: ").otherwise("Reply "), "p_type")
    return read(spark, sf_dir, "part").select("p_partkey", X.safe_filename(F.col("p_name")).alias("safe"), X.parse_float(number).alias("number"), X.speaker_label(label).alias("speaker"), X.after_mark(raw, "Answer:").alias("answer"))


@query("""SELECT p_partkey, array_to_string(list_transform(range(0, n), lambda i: CAST(round_even(i * ((total - 1) / greatest(n - 1, 1)), 0) AS BIGINT)), ' ') AS frames FROM
    (SELECT p_partkey, CAST(p_size * 20 AS DOUBLE) AS total, CAST(greatest(2, floor(greatest(4, least(floor(p_size * 20 / 24.0 * 2), 16, p_size * 20)) / 2) * 2) AS BIGINT) AS n FROM part)""")
def frame_places(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(X.frame_indices(F.col("p_size") * 20, F.lit(24.0), 2.0, 4, 16, 2), " ").alias("frames"))


@query("""SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS likeness
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosine(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 6).alias("likeness"))


@query("""WITH f AS (SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['.json', '.txt'] WHEN 1 THEN ['.txt'] ELSE ['.md'] END) AS suffix FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE suffix WHEN '.txt' THEN 1 ELSE 2 END) AS k FROM f WHERE suffix IN ('.txt', '.json'))
    SELECT doc_id, 'x/' || doc_id || suffix AS path FROM r WHERE k = 1""")
def suffix_priority(spark, sf_dir):
    """Of the files of a key the one whose suffix comes first."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    kinds = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(".json"), F.lit(".txt"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(".txt"))).otherwise(F.array(F.lit(".md")))
    files = docs.select("doc_id", F.explode(kinds).alias("suffix")).withColumn("path", F.concat(F.lit("x/"), F.col("doc_id").cast("string"), "suffix"))
    return J.by_priority(docs, "doc_id", files, (".txt", ".json")).select("doc_id", "path")


@query("""WITH RECURSIVE p AS (SELECT p_partkey, 0::DOUBLE AS start, CAST(p_size * 4 AS DOUBLE) AS stop, 0 AS place FROM part UNION ALL SELECT p_partkey, start + 15, stop, place + 1 FROM p WHERE stop - start > 30)
    SELECT p_partkey, CAST(place AS BIGINT) AS place, start, CASE WHEN stop - start > 30 THEN start + 15 ELSE stop END AS "end" FROM p""")
def long_audio_pieces(spark, sf_dir):
    """Pieces of at most 30 seconds of audio that is loud all along, so each cut falls in the middle: a table function."""
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 4).cast("double").alias("stop"))
    pieces = split_long_udtf()(F.lit(0.0), F.col("stop").outer(), F.array().cast("array<boolean>"), F.lit(0.01))
    return rows.lateralJoin(pieces).select("p_partkey", "place", "start", "end")


@query("""WITH RECURSIVE t AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0.1) AS loud, CAST(len(embedding) AS DOUBLE) AS stop FROM embeddings),
    p AS (SELECT vec_id, loud, stop, 0::DOUBLE AS start, CAST(NULL AS DOUBLE) AS cut, 0 AS place FROM t
      UNION ALL SELECT vec_id, loud, stop, CASE WHEN cut IS NULL THEN start ELSE cut END, CASE WHEN cut IS NULL AND stop - start > 30 THEN CASE WHEN list_max(q) > 0 THEN greatest(start + 1, floor(start + 15) + list_position(q, list_max(q)) - 1) ELSE start + 15 END END, CASE WHEN cut IS NULL THEN place ELSE place + 1 END
      FROM (SELECT *, list_transform(range(0, len(w)), lambda i: least(9, i - 1 - coalesce(list_max(list_filter(range(0, i), lambda j: w[j + 1])), -1)) + least(10, coalesce(list_min(list_filter(range(i, len(w)), lambda j: w[j + 1])), len(w)) - i)) AS q
        FROM (SELECT *, loud[CAST(floor(start + 15) AS BIGINT) + 1 : CAST(floor(start + 30) AS BIGINT)] AS w FROM p WHERE cut IS NOT NULL OR stop - start > 30)))
    SELECT vec_id, CAST(place AS BIGINT) AS place, start, CASE WHEN cut IS NULL THEN stop ELSE cut END AS "end" FROM p WHERE cut IS NOT NULL OR stop - start <= 30""")
def long_audio_at_silence(spark, sf_dir):
    """Pieces of at most 30 seconds, cut where most silent frames are around, a second a frame."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0.1).alias("loud"))
    pieces = split_long_udtf()(F.lit(0.0), F.size("loud").cast("double").outer(), F.col("loud").outer(), F.lit(1.0))
    return rows.lateralJoin(pieces).select("vec_id", "place", "start", "end")


@query("""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0.1) AS loud, len(embedding) AS n FROM embeddings), f AS (SELECT vec_id, loud, n, unnest(range(0, n)) AS i FROM t),
    k AS (SELECT vec_id, i, least(9, i - 1 - coalesce(list_max(list_filter(range(0, i), lambda j: loud[j + 1])), -1)) + least(10, coalesce(list_min(list_filter(range(i, n), lambda j: loud[j + 1])), n) - i) AS quiet FROM f)
    SELECT vec_id, CASE WHEN max(quiet) > 0 THEN arg_max(i, quiet * 1000 - i) END AS at FROM k GROUP BY vec_id""")
def quiet_point(spark, sf_dir):
    """The frame with most silent frames right around it, the first of equals."""
    loud = F.transform("embedding", lambda x: x > 0.1)
    return read(spark, sf_dir, "embeddings").select("vec_id", split_point_udf(loud).alias("at"))
