"""Queries over media samples, retries, exports and shuffled streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as V
from ..operators import joins as J
from ..operators import mixing as M
from ..operators import samples as P
from ..operators.shuffle_buffer import shuffled
from ..sources import sinks as K
from ..sources.shared import folder, write_text
from ..streaming import blocks as B
from .catalog import packed, query, read, stream

IDS_SQL = "list_transform(range(0, 8), lambda i: CASE WHEN (vec_id + i) % 4 = 0 THEN CAST(-200 AS BIGINT) WHEN i = 2 THEN 901 WHEN i = 6 THEN 902 ELSE i END)"


def marked(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("vec_id") + i) % 4 == 0, -200).when(i == 2, 901).when(i == 6, 902).otherwise(i).cast("long"))
    return read(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids"))


@query(f"""WITH t AS (SELECT vec_id, {IDS_SQL} AS ids, [(1 + vec_id % 2) * 4 * 4 // 4, 2 * 2 // 4 * 1] AS n FROM embeddings), u AS (SELECT vec_id, ids, n, unnest(range(1, 9)) AS i FROM t),
    x AS (SELECT vec_id, i, ids[i] AS id, CASE WHEN ids[i] = -200 THEN n[len(list_filter(ids[:i], lambda v: v = -200))] ELSE 1 END AS times FROM u), e AS (SELECT vec_id, i, id, unnest(range(0, CAST(times AS BIGINT))) AS k FROM x)
    SELECT vec_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i, k) AS input_ids FROM e GROUP BY vec_id""")
def placeholder_expansion(spark, sf_dir):
    """Each image's placeholder stands as often as its grid has tokens."""
    counts = F.array(V.grid_tokens(1 + F.col("vec_id") % 2, F.lit(4), F.lit(4)), V.grid_tokens(F.lit(1), F.lit(2), F.lit(2)))
    return marked(spark, sf_dir).select("vec_id", F.array_join(V.expanded(F.col("ids"), -200, counts), " ").alias("input_ids"))


@query(f"""WITH t AS (SELECT vec_id, {IDS_SQL} AS ids FROM embeddings), p AS (SELECT *, list_position(ids, 901) AS b, list_position(ids, 902) AS e FROM t)
    SELECT vec_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN b > 0 AND i > b AND (coalesce(e, 0) = 0 OR i <= e) THEN x ELSE -100 END), ' ') AS labels FROM p""")
def role_span_labels(spark, sf_dir):
    return marked(spark, sf_dir).select("vec_id", F.array_join(V.span_labels(F.col("ids"), 901, 902), " ").alias("labels"))


@query("""WITH RECURSIVE s AS (SELECT vec_id, i, CASE i WHEN 0 THEN 2 + vec_id % 3 WHEN 2 THEN 1 WHEN 4 THEN vec_id % 4 ELSE 0 END AS n, CASE i WHEN 1 THEN [1, 2, 2 + vec_id % 2] WHEN 3 THEN [3, 1, 2] END AS g FROM embeddings, range(0, 5) t(i)),
    o AS (SELECT vec_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS base FROM embeddings UNION ALL SELECT o.vec_id, o.i + 1, CAST(o.base + CASE WHEN g IS NULL THEN n ELSE list_max(g) END AS BIGINT) FROM o JOIN s ON o.vec_id = s.vec_id AND o.i = s.i),
    p AS (SELECT vec_id, i, k AS a, 0 AS b, 0 AS c, base + k AS t, base + k AS h, base + k AS w FROM (SELECT s.vec_id, s.i, base, unnest(range(0, n)) AS k FROM s JOIN o ON s.vec_id = o.vec_id AND s.i = o.i WHERE g IS NULL)
      UNION ALL SELECT vec_id, i, a, b, c, base + a, base + b, base + c FROM (SELECT *, unnest(range(0, g[3])) AS c FROM (SELECT *, unnest(range(0, g[2])) AS b FROM (SELECT s.vec_id, s.i, base, g, unnest(range(0, g[1])) AS a FROM s JOIN o ON s.vec_id = o.vec_id AND s.i = o.i WHERE g IS NOT NULL))))
    SELECT p.vec_id, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY p.i, a, b, c) AS t, string_agg(CAST(h AS VARCHAR), ' ' ORDER BY p.i, a, b, c) AS h, string_agg(CAST(w AS VARCHAR), ' ' ORDER BY p.i, a, b, c) AS w, max(o.base) AS next FROM p JOIN o ON p.vec_id = o.vec_id AND o.i = 5 GROUP BY p.vec_id""")
def grid_positions(spark, sf_dir):
    """Positions in time, height and width of text and of two grids, 2 x 2 patches one id."""
    i = F.col("vec_id")
    text = lambda n: F.array_repeat(F.lit(7).cast("long"), n.cast("int"))
    grids = F.array(F.array(F.lit(1).cast("long"), F.lit(4).cast("long"), 4 + 2 * (i % 2)), F.array(*(F.lit(x).cast("long") for x in (3, 2, 4))))
    one = F.lit(-200).cast("long")
    ids = F.concat(text(2 + i % 3), F.array(one), text(F.lit(1)), F.array(one), text(i % 4))
    counts = F.transform(grids, lambda g: V.grid_tokens(g[0], g[1], g[2]))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", grids.alias("grids"), V.expanded(ids, -200, counts).alias("ids"))
    made = rows.select("vec_id", V.grid_positions(F.col("ids"), -200, F.col("grids")).alias("p"))
    return made.select("vec_id", *(F.array_join(f"p.{k}", " ").alias(k) for k in "thw"), F.col("p.next").alias("next"))


@query("""WITH s AS (SELECT vec_id // 4 AS step, vec_id, range(0, 1 + vec_id % 5) AS ids, [vec_id, vec_id + 1] AS pixels FROM embeddings), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY step) AS most FROM s)
    SELECT step, string_agg(array_to_string(list_concat(ids, list_transform(range(0, most - len(ids)), lambda x: CAST(0 AS BIGINT))), ' '), '/' ORDER BY vec_id) AS input_ids, string_agg(array_to_string(list_concat(ids, list_transform(range(0, most - len(ids)), lambda x: CAST(-100 AS BIGINT))), ' '), '/' ORDER BY vec_id) AS labels,
    string_agg(array_to_string(pixels, ' '), ' ' ORDER BY vec_id) AS pixels FROM m GROUP BY step""")
def feature_collator(spark, sf_dir):
    """Batches by rules: ids and labels padded, pixels one behind the other."""
    i = F.col("vec_id")
    ids = F.transform(F.sequence(F.lit(0), (i % 5).cast("int")), lambda x: x.cast("long"))
    rows = read(spark, sf_dir, "embeddings").select(F.floor(i / 4).alias("step"), "vec_id", ids.alias("input_ids"), ids.alias("labels"), F.array(i, i + 1).alias("pixels"))
    made = V.collate_features(rows, ["step"], "vec_id", {"input_ids": "pad", "labels": "pad_labels", "pixels": "concat"})
    lists = lambda c: F.array_join(F.transform(c, lambda v: F.array_join(v, " ")), "/").alias(c)
    return made.select("step", lists("input_ids"), lists("labels"), F.array_join("pixels", " ").alias("pixels"))


@query("SELECT conv_id % 8 AS shard, CAST(sum(len(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS BIGINT) AS tokens FROM conversations WHERE len(list_filter(string_split(text, ' '), lambda w: w <> '')) <= 256 GROUP BY 1")
def collator_pipeline(spark, sf_dir):
    """Packed, padded to a length and unpacked again: the padding is dropped with its sample, all else is there."""
    steps = (lambda b: P.padded_to(b, 300), lambda b: P.unpacked(b, ["shard", "batch"]), lambda s: s.where(F.exists("input_ids", lambda x: x != 0)))
    return V.piped(packed(spark, sf_dir), *steps).groupBy("shard").agg(F.sum(F.size("input_ids")).alias("tokens"))


@query("""SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE CAST(floor((2 + vec_id % 3) * 8) - 8 AS BIGINT) END AS n, CASE WHEN vec_id % 9 = 0 THEN 'end is not behind start' END AS error FROM embeddings""")
def segment_cut(spark, sf_dir):
    """Samples of a segment; a segment that ends before it begins is an error row."""
    i = F.col("vec_id")
    cut = V.cut_samples(F.col("embedding"), F.lit(8), F.lit(1.0), F.when(i % 9 == 0, 0.5).otherwise(2.0 + i % 3))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", cut.alias("s"))
    return rows.select("vec_id", F.when(F.col("s").isNotNull(), F.size("s")).cast("long").alias("n"), F.when(F.col("s").isNull(), "end is not behind start").alias("error"))


@query("""SELECT doc_id, 'first' AS run FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'again' FROM documents WHERE doc_id % 6 = 0""")
def failures_retried(spark, sf_dir):
    """Failed keys leave markers; they are left alone by the next run and taken up by one that retries."""
    docs, marks = read(spark, sf_dir, "documents").select("doc_id"), folder(spark, "markers")
    scored = docs.withColumn("answer", F.when(F.col("doc_id") % 3 != 0, "first"))
    good, bad = K.split_failures(scored, "answer")
    K.write_markers(bad, marks, "doc_id", "no answer")
    left = J.without_done(docs, "doc_id", good, K.read_markers(spark, marks, "doc_id", "long"))
    again = J.without_done(docs, "doc_id", good, None if left.isEmpty() else left).withColumn("answer", F.when(F.col("doc_id") % 2 == 0, "again")).where("answer is not null")
    return good.unionByName(again).withColumnRenamed("answer", "run")


@query("""SELECT 'window.DEMO_DATA = {"items":[' || string_agg('{"id":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']};' AS script FROM nation""")
def site_export(spark, sf_dir):
    """A page's data as one script of a bounded number of items."""
    path = f"{folder(spark, 'site')}/demo-data.js"
    K.write_script(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).orderBy("id"), path, "DEMO_DATA")
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\\s+$", "").alias("script"))


@query("SELECT event_id, CAST(('0x' || left(md5('9:' || event_id), 8)) AS BIGINT) AS rank FROM events")
def stream_shuffled(spark, sf_dir):
    """A streaming read in an order drawn from a seed: the rank goes with each row, whatever trigger it came with."""
    rows = stream(spark, sf_dir, "events").select("event_id", M.shuffled_rank(F.col("event_id"), 5, 4).alias("rank"))
    return B.drain(rows, "append").orderBy("rank", "event_id")


@query("""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels), c AS (SELECT doc_id, i // CAST(ceil(n / 3.0) AS BIGINT) AS node, i % CAST(ceil(n / 3.0) AS BIGINT) AS i FROM d),
    a AS (SELECT node, list(doc_id ORDER BY i) AS items FROM c GROUP BY node),
    s AS (SELECT node, items, items[1:50] AS held, CAST(NULL AS BIGINT) AS gone, least(50, len(items)) AS i FROM a
      UNION ALL SELECT node, items, list_concat(list_append(held[1:j], items[i + 1]), held[j + 2:]), held[j + 1], i + 1 FROM (SELECT *, CAST(('0x' || left(md5('14:' || node || ':' || i), 8)) AS BIGINT) % 50 AS j FROM s WHERE i < len(items))),
    e AS (SELECT node, unnest(held) AS doc_id, unnest(range(0, len(held))) AS j, len(items) - len(held) AS base FROM s WHERE i = len(items))
    SELECT gone AS doc_id, node, i - 51 AS place FROM s WHERE gone IS NOT NULL
    UNION ALL SELECT doc_id, node, base + row_number() OVER (PARTITION BY node ORDER BY CAST(('0x' || left(md5('14:' || node || ':end ' || j), 8)) AS BIGINT), j) - 1 FROM e""")
def shuffle_buffer(spark, sf_dir):
    """The order in which three nodes hand out their rows through buffers of 50, in the fifth epoch."""
    return shuffled(read(spark, sf_dir, "labels").select("doc_id"), ["doc_id"], 3, 9, 5, 50)


@query("SELECT n_nationkey AS id, n_name AS name, r AS repeat FROM nation, range(0, 3) t(r) WHERE n_nationkey % 2 = 0 AND n_nationkey < 10")
def source_cached_tensors(spark, sf_dir):
    """Rows of a listing whose tensor file is there, each as often as asked for."""
    rows, path = read(spark, sf_dir, "nation").where("n_nationkey < 10").select("n_nationkey", "n_name").collect(), folder(spark, "cached")  # 10 rows
    write_text(spark, f"{path}/metadata.csv", "id,name\n" + "".join(f"{i},{n}\n" for i, n in rows))
    for i, n in rows:
        if i % 2 == 0:
            write_text(spark, f"{path}/{n}.tensors.pth", "x")
    listed = spark.read.csv(f"{path}/metadata.csv", header=True, schema="id long, name string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tensors.pth").load(path).select(F.regexp_extract("path", r"([^/]*)\.tensors\.pth$", 1).alias("name"))
    return M.repeat(J.existing(listed, "name", files), 3).select("id", "name", F.col("repeat").cast("long").alias("repeat"))
