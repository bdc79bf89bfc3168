"""The training-data operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import closed_itemsets, hamming_search, html_blocks, lexicon_bpe, line_templates, masked_lm, mixture_packing, ngram_join, ogg_media, periodic_runs, quality_trees, string_kernel, substring_dedup
from .common import Scratch, small_batches


def vocabulary_path() -> str:
    """The public vocabulary file whose ids the tokenizing queries give; other files can be passed to the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, Scratch(spark))
    return out.select("doc_id", F.col("_vw_words").alias("n_words"), F.col("_vw_removed").alias("n_removed"), F.col("_vw_kept_sha256").alias("kept_sha256"))


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.top_k(table(spark, sf_dir, "embeddings"), Scratch(spark), "vec_id", "embedding")


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ogg_media.media_digests(ogg_media.to_media(table(spark, sf_dir, "documents")))


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_corpus(table(spark, sf_dir, "documents"), Scratch(spark))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines, and the kept text with its digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_templates.drop_recurring(docs, Scratch(spark))
    return out.select("doc_id", F.col("_vw_lines").alias("n_lines"), F.col("_vw_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), "text")


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), Scratch(spark))


def op8_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), Scratch(spark))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), Scratch(spark), 4, 85).select("doc_id", "n_shingles", "component_id")


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    small_batches(spark)
    out = quality_trees.score(docs, quality_trees.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("_vw_held_out").alias("held_out"), F.col("_vw_score").alias("score"), F.col("_vw_predicted").alias("predicted"))


def op11_closed_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = closed_itemsets.closed_itemsets(table(spark, sf_dir, "sale_lines"), Scratch(spark), "sale_id", "item_id")
    listed = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["item"].cast("string"), r["without"].cast("string"), r["alone"].cast("string"))), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["without"], r["item"])))
    return out.select(
        F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.size("rules").cast("long").alias("n_rules"),
        best["item"].alias("best_item"), F.sha2(listed.cast("binary"), 256).alias("rules_sha256"),
    )


def op12_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    out = string_kernel.predict(docs.select("doc_id", "text"), string_kernel.train(docs))
    return out.select("doc_id", F.col("_vw_held_out").alias("held_out"), F.col("_vw_lang").alias("lang_pred"), F.col("_vw_lang_score").alias("score"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; texts whose id's checksum is a multiple of 10 go round a period from some word on before."""
    small_batches(spark)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (h % 10 == 0).alias("round"), F.floor(h / 10).cast("long").alias("g"))
    docs = docs.withColumn("w", F.when(F.col("round"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    docs = docs.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    turned = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    docs = docs.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))
    runs, best = F.col("_vw_runs"), F.col("best")
    out = periodic_runs.collapse_runs(docs).withColumn("best", F.array_max(F.transform("_vw_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))))
    listed = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return out.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_hamming_top_k, op3_ogg_media, op4_masked_lm, op5_html_text, op6_line_templates, op7_mixture_packing, op8_lexicon_bpe, op9_ngram_join, op10_quality_trees, op11_closed_itemsets, op12_string_kernel, op13_periodic_runs)}

ORACLES = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT r, unnest(range(1, len(w) + 1)) AS j FROM d),
        x AS (SELECT p.r, p.j, d.w[p.j] AS word, CASE WHEN p.j + 34 <= len(d.w) THEN sha256(array_to_string(d.w[p.j:p.j + 34], ' ')) END AS h FROM p JOIN d ON p.r = d.r),
        c AS (SELECT h FROM x WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
        y AS (SELECT x.r, x.j, x.word, max(CASE WHEN c.h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY x.r ORDER BY x.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN c ON x.h = c.h),
        z AS (SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM y GROUP BY r)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(z.n_removed, 0) AS n_removed, sha256(coalesce(z.kept, '')) AS kept_sha256 FROM d LEFT JOIN z ON d.r = z.r""",
    "op2_hamming_top_k": """
        WITH x AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
            CAST(list_sum(list_transform(range(1, greatest(len(q.embedding), len(e.embedding)) + 1), lambda i: CASE WHEN coalesce(q.embedding[i] > 0, false) <> coalesce(e.embedding[i] > 0, false) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
            FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.embedding IS NOT NULL AND e.embedding IS NOT NULL),
        y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM x)
        SELECT query_id, neighbor_id, distance, rank FROM y WHERE rank <= 10""",
    "op9_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
        n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
        u AS (SELECT doc_id, unnest(sh) AS t FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT c.a, c.b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * c.common >= 85 * (x.n_shingles + y.n_shingles - c.common)),
        g(a, b) AS (SELECT a, b FROM l UNION SELECT g.a, l.b FROM g JOIN l ON g.b = l.a)
        SELECT n.doc_id, n.n_shingles, least(n.doc_id, coalesce(min(g.b), n.doc_id)) AS component_id FROM n LEFT JOIN g ON n.doc_id = g.a GROUP BY n.doc_id, n.n_shingles""",
    "op11_closed_itemsets": """
        WITH RECURSIVE x AS (SELECT DISTINCT sale_id AS b, item_id AS i FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
        t AS (SELECT count(DISTINCT b) AS baskets FROM x),
        l(items, last, b) AS (SELECT [i], i, b FROM (SELECT *, count(*) OVER (PARTITION BY i) AS n FROM x), t WHERE n >= 5 AND n * 20000 >= baskets
            UNION ALL SELECT items, last, b FROM (SELECT list_append(l.items, x.i) AS items, x.i AS last, l.b, count(*) OVER (PARTITION BY list_append(l.items, x.i)) AS n FROM l JOIN x ON l.b = x.b AND x.i > l.last), t WHERE n >= 5 AND n * 20000 >= baskets),
        f AS (SELECT items, count(*) AS support FROM l GROUP BY items),
        u AS (SELECT items, support, c, list_filter(items, lambda v: v <> c) AS rest FROM (SELECT items, support, unnest(items) AS c FROM f)),
        p AS (SELECT rest AS items, max(support) AS larger FROM u GROUP BY rest),
        r AS (SELECT u.items, u.c, a.support AS a, s.support AS s FROM u JOIN f a ON u.rest = a.items JOIN f s ON s.items = [u.c], t WHERE len(u.items) > 1 AND 100 * u.support >= 60 * a.support AND u.support * baskets > a.support * s.support),
        g AS (SELECT items, count(*) AS n_rules, (array_agg(c ORDER BY a, c))[1] AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS rules FROM r GROUP BY items)
        SELECT array_to_string(f.items, ',') AS items, CAST(len(f.items) AS BIGINT) AS n_items, f.support, coalesce(g.n_rules, 0) AS n_rules, g.best_item, sha256(coalesce(g.rules, '')) AS rules_sha256
        FROM f LEFT JOIN p ON f.items = p.items LEFT JOIN g ON f.items = g.items WHERE p.larger IS NULL OR p.larger < f.support""",
}
