"""Every query over the test tables, by name, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.automata import active_spans_udf, cut_indices_udf, repair_json_udf
from ..operators import joins as J
from ..operators import mixing as M
from ..operators import range_packing
from ..operators import samples as P
from ..operators import segments as S
from ..sources.shared import numbered
from ..streaming import blocks as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- segments: events by user, point in time, in microseconds; conversations by turn ---


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("speaker"), at.alias("start"), at.alias("end"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text")


ORDER = ["start", "event_id"]
LEAST = 3e6
E_SQL = "e AS (SELECT event_id, user_id, event_type AS speaker, epoch_us(ts) AS t FROM events)"
G_SQL = f"{E_SQL}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e)"
T_SQL = f"{G_SQL}, p AS (SELECT user_id, greatest(coalesce(quantile_cont(CAST(gap AS DOUBLE), 0.95), 0), 3000000) AS t_gap FROM g GROUP BY user_id)"
B_SQL = f"{T_SQL}, b AS (SELECT g.*, t_gap, CAST(sum(CASE WHEN gap >= t_gap THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM g JOIN p ON g.user_id = p.user_id)"
C_SQL = f"{B_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id, block ORDER BY t, event_id) - 1 AS place FROM b)"


@query(f"WITH {G_SQL} SELECT event_id, user_id, gap FROM g")
def gap_lag(spark, sf_dir):
    return S.with_gap(events(spark, sf_dir), "user_id", ORDER).select("event_id", "user_id", "gap")


@query(f"WITH {T_SQL} SELECT user_id, round(t_gap / 1000000, 3) AS t_gap FROM p")
def gap_percentile(spark, sf_dir):
    return S.gap_threshold(S.with_gap(events(spark, sf_dir), "user_id", ORDER), "user_id", LEAST).select("user_id", F.round(F.col("t_gap") / 1000000, 3).alias("t_gap"))


@query(f"WITH {B_SQL} SELECT event_id, user_id, block FROM b")
def gap_block_index(spark, sf_dir):
    return S.gap_blocks(events(spark, sf_dir), "user_id", ORDER, LEAST).select("event_id", "user_id", "block")


@query(f"WITH {C_SQL} SELECT event_id, user_id, block, place, CAST(place // 20 AS BIGINT) AS chunk FROM c")
def scene_blocks_capped(spark, sf_dir):
    return S.capped_blocks(S.gap_blocks(events(spark, sf_dir), "user_id", ORDER, LEAST), "user_id", ORDER, 20).select("event_id", "user_id", "block", "place", "chunk")


@query(f"""WITH {C_SQL}, k AS (SELECT DISTINCT doc_id % 150 AS user_id, CAST(toxic AS BIGINT) AS block, 1 + doc_id % 9 AS place, 1 AS cut FROM labels),
    l AS (SELECT user_id, max(t) - min(t) AS length FROM e GROUP BY user_id)
    SELECT c.event_id, c.user_id, CASE WHEN l.length < 120000000 THEN 0 ELSE CAST(sum(coalesce(k.cut, 0)) OVER (PARTITION BY c.user_id ORDER BY c.t, c.event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS scene
    FROM c JOIN l ON c.user_id = l.user_id LEFT JOIN k ON c.user_id = k.user_id AND c.block = k.block AND c.place = k.place""")
def scene_two_level(spark, sf_dir):
    cuts = read(spark, sf_dir, "labels").select((F.col("doc_id") % 150).alias("user_id"), F.col("toxic").cast("long").alias("block"), (1 + F.col("doc_id") % 9).alias("at"))
    return S.two_level_scenes(S.gap_blocks(events(spark, sf_dir), "user_id", ORDER, LEAST), cuts, "user_id", ORDER, 120e6).select("event_id", "user_id", "scene")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("speaker"), at.alias("start"), (at + F.floor(F.col("value") * 60).cast("long") * 1000000).alias("end"))


@query("""WITH e AS (SELECT event_id, user_id, event_type AS speaker, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS f FROM events),
    k AS (SELECT *, lag(speaker) OVER w AS ps, lag(f) OVER w AS pf FROM e WHERE f - s > 500000 WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
    i AS (SELECT *, CAST(sum(CASE WHEN ps = speaker AND s - pf <= 14400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM k)
    SELECT user_id, island, first(speaker ORDER BY s, event_id) AS speaker, min(s) AS start, last(f ORDER BY s, event_id) AS "end", count(*) AS turns FROM i GROUP BY user_id, island""")
def merge_close_turns(spark, sf_dir):
    return S.merge_turns(timed(spark, sf_dir), "user_id", ["event_id"], 4 * 3600e6, 500_000)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS speaker, CAST(epoch_us(ts) AS DOUBLE) AS s, CAST(epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS DOUBLE) AS f, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
    w AS (SELECT user_id, i, 0::BIGINT AS place, s, f, speaker FROM e WHERE i = 1
      UNION ALL SELECT user_id, i, CASE WHEN fold THEN place ELSE place + 1 END, CASE WHEN fold THEN s ELSE s2 END, CASE WHEN fold THEN greatest(f, f2) ELSE f2 END, speaker2
      FROM (SELECT e.user_id, e.i, w.place, w.s, w.f, e.s AS s2, e.f AS f2, e.speaker AS speaker2,
          w.speaker = e.speaker AND ((e.f - e.s < 1.5e9 AND e.s - w.f < 3600e6 AND w.f - w.s < 30e9) OR (w.f - w.s < 1.5e9 AND e.s - w.f < 7200e6)) AS fold
        FROM w JOIN e ON w.user_id = e.user_id AND e.i = w.i + 1))
    SELECT user_id, place, arg_max(s, i) AS start, arg_max(f, i) AS "end", arg_max(speaker, i) AS speaker FROM w GROUP BY user_id, place""")
def short_turn_fold(spark, sf_dir):
    return S.fold_short_turns(timed(spark, sf_dir), "user_id", ["start", "event_id"], 1.5e9, 3600e6, 30e9, 1.5e9, 7200e6)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS speaker, CAST(epoch_us(ts) AS DOUBLE) AS s, CAST(epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS DOUBLE) AS f FROM events),
    q AS (SELECT *, s AS a, 0 AS k FROM e WHERE f - s > 3e9 UNION ALL SELECT user_id, event_id, speaker, s, f, a + 1.5e9, k + 1 FROM q WHERE f - a > 3e9),
    r AS (SELECT user_id, event_id, speaker, s AS at_, s, f, 0 AS k, false AS piece FROM e WHERE f - s <= 3e9 UNION ALL SELECT user_id, event_id, speaker, s, a, CASE WHEN f - a > 3e9 THEN a + 1.5e9 ELSE f END, k, true FROM q),
    x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_, event_id, k) AS i FROM r),
    w AS (SELECT user_id, i, 0::BIGINT AS place, s, f, speaker FROM x WHERE i = 1
      UNION ALL SELECT user_id, i, CASE WHEN fold THEN place ELSE place + 1 END, CASE WHEN fold THEN s ELSE s2 END, CASE WHEN fold THEN greatest(f, f2) ELSE f2 END, speaker2
      FROM (SELECT x.user_id, x.i, w.place, w.s, w.f, x.s AS s2, x.f AS f2, x.speaker AS speaker2,
          NOT x.piece AND w.speaker = x.speaker AND ((x.f - x.s < 1.5e9 AND x.s - w.f < 3600e6 AND w.f - w.s < 3e9) OR (w.f - w.s < 1.5e9 AND x.s - w.f < 7200e6)) AS fold
        FROM w JOIN x ON w.user_id = x.user_id AND x.i = w.i + 1))
    SELECT user_id, place, arg_max(s, i) AS start, arg_max(f, i) AS "end", arg_max(speaker, i) AS speaker FROM w GROUP BY user_id, place""")
def turn_fold_split(spark, sf_dir):
    """The fold with turns that are too long cut into pieces, here in the middle as nothing is silent."""
    return S.fold_short_turns(timed(spark, sf_dir), "user_id", ["start", "event_id"], 1.5e9, 3600e6, 3e9, 1.5e9, 7200e6, 3e9, 1e8)


SP = r"[\x09-\x0D\x1C-\x20\x85]+"


@query(rf"""SELECT conv_id AS doc, turn AS ord, conv_id || '_' || lpad(CAST(turn AS VARCHAR), 6, '0') AS segment_id, role AS speaker, regexp_replace(text, '{SP}', '', 'g') AS norm,
    CASE WHEN length(x) > 20 THEN left(x, 20) || '...' ELSE x END AS short FROM (SELECT *, regexp_replace(translate(text, chr(10), ' '), '^{SP}|{SP}$', '', 'g') AS x FROM conversations)""")
def normalize_segment(spark, sf_dir):
    rows = S.normalized(read(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn"), {"speaker": ("speaker", "role"), "text": ("text", "sentence")})
    return rows.select("doc", "ord", "segment_id", "speaker", X.without_space(F.col("text")).alias("norm"), X.shorten(F.col("text"), 20).alias("short"))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(nullif(role, '')))), ',') AS speakers, count(DISTINCT nullif(role, '')) AS num_speakers FROM conversations GROUP BY conv_id")
def doc_summary(spark, sf_dir):
    role = F.nullif("role", F.lit(""))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set(role)), ",").alias("speakers"), F.count_distinct(role).alias("num_speakers"))


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality, l.quality IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_lookup_default(spark, sf_dir):
    return J.lookup(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id", "quality", "none")


@query("SELECT d.doc_id, d.n_chars, l.quality, l.toxic, e.label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def three_way_enrich(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return J.enrich(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", read(spark, sf_dir, "labels"), vectors)


@query(rf"""WITH c AS (SELECT *, regexp_replace(text, '{SP}', '', 'g') AS norm FROM conversations)
    SELECT a.conv_id, a.turn, coalesce((SELECT min(b.turn) FROM c b WHERE b.conv_id = a.conv_id AND b.role = a.role AND b.turn <> a.turn AND b.norm <> a.norm), a.turn) AS reference FROM c a""")
def same_speaker_reference(spark, sf_dir):
    return S.same_speaker_reference(turns(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "reference")


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS seen FROM conversations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seen) AS rank FROM f)
    SELECT c.conv_id, c.turn, r.rank FROM conversations c JOIN r ON c.conv_id = r.conv_id AND c.role = r.role""")
def speaker_first_appearance(spark, sf_dir):
    return S.speakers_by_appearance(turns(spark, sf_dir), ["conv_id"], "turn", 1).select("conv_id", "turn", "rank")


@query("""WITH c AS (SELECT *, turn // 4 AS scene FROM conversations), f AS (SELECT conv_id, scene, role, min(turn) AS seen FROM c GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, scene ORDER BY seen) - 1 AS rank FROM f)
    SELECT c.conv_id, c.turn, 'Speaker-' || r.rank AS speaker, c.role AS original_speaker FROM c JOIN r ON c.conv_id = r.conv_id AND c.scene = r.scene AND c.role = r.role""")
def scene_speaker_normalize(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("scene", F.floor(F.col("turn") / 4))
    found = S.speakers_by_appearance(rows, ["conv_id", "scene"], "turn", 0)
    return found.select("conv_id", "turn", F.concat(F.lit("Speaker-"), F.col("rank").cast("string")).alias("speaker"), F.col("speaker").alias("original_speaker"))


@query("""SELECT conv_id, turn, array_to_string(list(role || ':' || turn) OVER w, ' ') AS context FROM conversations WINDOW w AS (PARTITION BY conv_id, turn // 4 ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def context_window5(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("scene", F.floor(F.col("turn") / 4))
    found = S.trailing_context(rows, ["conv_id", "scene"], "turn", F.concat("speaker", F.lit(":"), F.col("turn").cast("string")))
    return found.select("conv_id", "turn", F.array_join("context", " ").alias("context"))


@query("""WITH s AS (SELECT a.vec_id AS o, b.vec_id AS p, b.label AS m, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS s FROM embeddings a JOIN embeddings b ON abs(a.vec_id - b.vec_id) <= 5 AND a.vec_id <> b.vec_id),
    r AS (SELECT o, m, row_number() OVER (PARTITION BY o ORDER BY s DESC, p) AS rank FROM s WHERE s >= 0.2)
    SELECT e.vec_id, coalesce(r.m, e.label) AS new_label FROM embeddings e LEFT JOIN r ON e.vec_id = r.o AND r.rank = 1""")
def embedding_relabel(spark, sf_dir):
    return S.relabel_by_neighbours(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", least=0.2).select("vec_id", "new_label")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS at FROM embeddings")
def argmax_label(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", X.first_argmax(F.col("embedding")).alias("at"))


@query("SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS mean_cents FROM lineitem WHERE l_quantity >= 2 GROUP BY l_orderkey")
def weighted_mean(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_quantity >= 2").select("l_orderkey", F.col("l_quantity").cast("long").alias("n"), (F.round(F.col("l_extendedprice") * 100).cast("long") * F.col("l_quantity").cast("long")).alias("c"))
    return rows.groupBy("l_orderkey").agg((F.sum("c").cast("double") / F.nullif(F.sum("n"), F.lit(0)).cast("double")).alias("mean_cents"))


@query("SELECT l_orderkey, max(l_linenumber) >= 7 AS poisoned, CASE WHEN max(l_linenumber) >= 7 THEN NULL ELSE round(avg(l_tax), 6) END AS mean FROM lineitem GROUP BY l_orderkey")
def ensemble_mean_nan(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_linenumber") >= 7, F.lit(float("nan"))).otherwise(F.col("l_tax")))
    bad = F.max(F.isnan("v"))
    return rows.groupBy("l_orderkey").agg(bad.alias("poisoned"), F.when(~bad, F.round(F.avg("v"), 6)).alias("mean"))


@query("SELECT vec_id, round(20 * log10(greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / len(embedding)), 1e-12)), 4) AS dbfs, round(CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE), 6) AS peak FROM embeddings")
def rms_dbfs(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rms = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / F.size("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(20 * F.log10(F.greatest(rms, F.lit(1e-12))), 4).alias("dbfs"), F.round(F.array_max(F.transform(v, lambda x: F.abs(x))), 6).alias("peak"))


HALF = 20 * math.log10(2)  # dB below the loudest frame


@query("""WITH e AS (SELECT vec_id, embedding AS v, len(embedding) AS n, unnest(range(0, (len(embedding) - 8) // 4 + 1)) AS f FROM embeddings),
    r AS (SELECT vec_id, n, f, sqrt(list_sum(list_transform(v[f * 4 + 1:f * 4 + 8], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 8) AS rms FROM e), m AS (SELECT *, max(rms) OVER (PARTITION BY vec_id) AS top FROM r),
    l AS (SELECT vec_id, n, f, lag(f) OVER (PARTITION BY vec_id ORDER BY f) AS p FROM m WHERE rms > greatest(top * 0.5, pow(10, -2.25))),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR (f > p + 1 AND f * 4 - least(n, p * 4 + 8) > 1) THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY f) AS island FROM l)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY island) - 1 AS place, min(f) * 4 AS start, least(n, max(f) * 4 + 8) AS "end" FROM g GROUP BY vec_id, n, island""")
def vad_segments(spark, sf_dir):
    spans = active_spans_udf(F.transform("embedding", lambda x: x.cast("double")), 8, 4, 1, 4, HALF)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(spans).alias("place", "span")).select("vec_id", F.col("place").cast("long"), "span.*")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def anti_existing(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    return J.without_done(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", labels.where("quality = 1"), labels.where("toxic = 1"))


@query("SELECT d.doc_id FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id")
def existence_filter(spark, sf_dir):
    return J.existing(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", read(spark, sf_dir, "labels"))


@query("SELECT lang, doc_id, n_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def ranked_topk_per_lang(spark, sf_dir):
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 5")


@query("SELECT doc_id, doc_id % 7 AS shard FROM documents WHERE doc_id % 7 = 3")
def modulo_shard(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("shard")).where("shard = 3")


@query("SELECT doc_id, CAST(doc_id // CAST(ceil((SELECT max(doc_id) + 1 FROM documents) / 7.0) AS BIGINT) AS BIGINT) AS shard FROM documents")
def contiguous_shard(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    total = docs.agg(F.max("doc_id") + 1).first()[0] or 0  # ids are places; one number comes to the driver
    return docs.withColumn("shard", M.contiguous_shard(F.col("doc_id"), max(1, total), 7))


@query("SELECT doc_id, CAST(('0x' || left(md5('42:' || doc_id), 8)) AS BIGINT) AS rank FROM documents")
def hash_shuffle(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", M.shuffled_rank(F.col("doc_id"), 42).alias("rank")).orderBy("rank", "doc_id")


@query("SELECT o_custkey, count(*) AS orders, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o, max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey")
def manifest_pivot(spark, sf_dir):
    per = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    made = per.groupBy("o_custkey").agg(F.sum("n").alias("orders"), F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("m"))
    return made.select("o_custkey", "orders", *(F.try_element_at("m", F.lit(s)).alias(s.lower()) for s in "FOP"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rank FROM documents) WHERE rank = 1")
def ordered_dedup(spark, sf_dir):
    # Equal texts by a 256-bit digest, so that texts aren't shuffled; the minimum is pre-aggregated.
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


# --- training samples: conversations with embeddings as codec ids ---

CODEC_GLOBAL, CODEC_SEMANTIC = "bicodec_global", "bicodec_semantic"  # fixed names of the codec's tokens
TOK_SQL = "array_to_string(list_transform({0}, lambda x: '<|{1}_' || CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) || '|>'), ' ')"


def codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("long"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt"), ids.alias("ids"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", ((F.col("conv_id") * 7 + F.col("turn")) % 700).alias("utt"))


def global_tokens(c: str = "ids"):
    return X.codec_tokens(F.col(c), CODEC_GLOBAL, 32)


def semantic_tokens(c: str = "ids"):
    return X.codec_tokens(F.slice(c, 33, 1000), CODEC_SEMANTIC)


G_TOK, S_TOK = TOK_SQL.format("embedding[1:32]", CODEC_GLOBAL), TOK_SQL.format("embedding[33:]", CODEC_SEMANTIC)
K_SQL = f"k AS (SELECT vec_id AS utt, {G_TOK} AS g, {S_TOK} AS s FROM embeddings), c AS (SELECT conv_id, turn, role, text, (conv_id * 7 + turn) % 700 AS utt FROM conversations)"


@query(f"SELECT vec_id, {G_TOK} AS global_tokens, {S_TOK} AS semantic_tokens FROM embeddings")
def codec_tokens(spark, sf_dir):
    return codec(spark, sf_dir).select(F.col("utt").alias("vec_id"), global_tokens().alias("global_tokens"), semantic_tokens().alias("semantic_tokens"))


@query(f"WITH {K_SQL} SELECT c.conv_id, c.turn, '<asr>' || k.g || k.s || '</asr>' AS user_content, '<text>' || c.text || '</text>' AS assistant_content FROM c JOIN k ON c.utt = k.utt WHERE trim(c.text) <> ''")
def sample_asr(spark, sf_dir):
    rows = spoken(spark, sf_dir).where(X.present(F.col("text")).isNotNull()).join(codec(spark, sf_dir), "utt")
    m = P.messages(("user", F.concat(F.lit("<asr>"), global_tokens(), semantic_tokens(), F.lit("</asr>"))), ("assistant", F.concat(F.lit("<text>"), "text", F.lit("</text>"))))
    return rows.withColumn("messages", m).select("conv_id", "turn", F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"))


@query(f"""WITH {K_SQL} SELECT c.conv_id, c.turn, '<tts>' || r.g || '<text>' || c.text || '</text>' AS user_content, k.s AS assistant_content
    FROM c JOIN k ON c.utt = k.utt JOIN k r ON r.utt = (c.utt + 1) % 700 WHERE trim(c.text) <> ''""")
def sample_tts(spark, sf_dir):
    tokens = codec(spark, sf_dir)
    rows = spoken(spark, sf_dir).where(X.present(F.col("text")).isNotNull()).withColumn("ref", (F.col("utt") + 1) % 700)
    rows = rows.join(tokens, "utt").join(tokens.select(F.col("utt").alias("ref"), F.col("ids").alias("ref_ids")), "ref")
    return rows.select("conv_id", "turn", F.concat(F.lit("<tts>"), global_tokens("ref_ids"), F.lit("<text>"), "text", F.lit("</text>")).alias("user_content"), semantic_tokens().alias("assistant_content"))


@query(f"""WITH {K_SQL}, h AS (SELECT a.conv_id, a.turn, count(*) AS n, count(k.utt) AS found, string_agg(b.role || ': ' || b.text, chr(10) ORDER BY b.turn) AS lines, string_agg(k.s, ' ' ORDER BY b.turn) AS tokens
        FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 4 AND a.turn - 1 LEFT JOIN k ON b.utt = k.utt GROUP BY 1, 2)
    SELECT c.conv_id, c.turn, h.lines AS history, h.tokens AS history_tokens, k.s AS assistant_content FROM c JOIN h ON c.conv_id = h.conv_id AND c.turn = h.turn AND h.n = h.found JOIN k ON c.utt = k.utt""")
def sample_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-4, -1)
    rows = spoken(spark, sf_dir).withColumn("h", F.collect_list(F.struct("turn", "utt", F.concat("role", F.lit(": "), "text").alias("line"))).over(w)).where(F.size("h") > 0)
    tokens = codec(spark, sf_dir)
    rows = J.gather_all(rows, F.transform("h", lambda x: x["utt"]), "utt_h", tokens.select(F.col("utt").alias("utt_h"), semantic_tokens().alias("s")), "s", ["conv_id", "turn"])
    found = rows.join(tokens, "utt")
    return found.select("conv_id", "turn", F.array_join(F.transform("h", lambda x: x["line"]), "\n").alias("history"), F.array_join("values", " ").alias("history_tokens"), semantic_tokens().alias("assistant_content"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'user' ELSE role END AS role, text AS content,
    CASE WHEN turn % 3 = 0 THEN turn % 2 WHEN turn % 5 <> 0 AND role = 'assistant' THEN 1 ELSE 0 END AS loss_mask FROM conversations""")
def messages_normalize(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    raw = F.array(F.struct(F.when(F.col("turn") % 5 == 0, F.lit("")).otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, (F.col("turn") % 2).cast("string")).otherwise(F.lit("x")).alias("loss_mask")))
    return rows.select("conv_id", "turn", P.normalize_messages(raw)[0].alias("m")).select("conv_id", "turn", "m.*")


@query("SELECT source, count(*) AS samples, CAST(sum(n_chars) AS BIGINT) AS tokens, round(avg(n_chars), 4) AS mean, round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 6) AS ratio FROM documents GROUP BY source")
def source_counters(spark, sf_dir):
    per = read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("samples"), F.sum("n_chars").alias("tokens"))
    total = per.agg(F.sum("tokens").alias("all"))  # one row
    return per.crossJoin(F.broadcast(total)).select("source", "samples", "tokens", F.round(F.col("tokens") / F.col("samples"), 4).alias("mean"), F.round(F.col("tokens") / F.col("all"), 6).alias("ratio"))


@query("SELECT source, step, tokens, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY step) AS BIGINT) AS consumed FROM (SELECT source, doc_id // 100 AS step, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY 1, 2)")
def source_running_tokens(spark, sf_dir):
    per = read(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("doc_id") / 100).alias("step")).agg(F.sum("n_chars").alias("tokens"))
    return per.withColumn("consumed", F.sum("tokens").over(Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))


MIX = M.Mixture(("en", "fr", "de", "es"), (4.0, 2.0, 1.0, 1.0))


@query("""WITH t AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS ds_idx, row_number() OVER (PARTITION BY lang ORDER BY doc_id) / CASE lang WHEN 'en' THEN 4.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END AS turn FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')),
    m AS (SELECT min(e) AS last FROM (SELECT max(turn) AS e FROM t GROUP BY lang)) SELECT doc_id, lang, CAST(ds_idx AS BIGINT) AS ds_idx, CAST(turn AS DOUBLE) AS turn FROM t, m WHERE turn <= last""")
def interleave_proportional(spark, sf_dir):
    return M.interleave(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], MIX)


@query("""SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS chatml, upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || text || chr(10) AS "default",
    CASE role WHEN 'user' THEN '[INST] ' || text || ' [/INST]' WHEN 'system' THEN '<<SYS>>' || chr(10) || text || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE text || '</s>' END AS llama2,
    CASE role WHEN 'system' THEN text || chr(10) || chr(10) ELSE '<|' || upper(left(role, 1)) || lower(substr(role, 2)) || '|>: ' || text || chr(10) || chr(10) END AS janus FROM conversations""")
def chat_template_text(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", *(f(F.col("role"), F.col("text")).alias(n) for n, f in P.TEMPLATES.items()))


W_SQL = "list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: CAST(length(w) AS BIGINT))"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {W_SQL} AS ids FROM conversations),
    p AS (SELECT conv_id, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(CASE WHEN role = 'assistant' THEN ids ELSE list_transform(ids, lambda x: CAST(-100 AS BIGINT)) END ORDER BY turn)) AS labels FROM t GROUP BY conv_id)
    SELECT conv_id, array_to_string(ids[-64:], ' ') AS input_ids, array_to_string(labels[-64:], ' ') AS labels, CAST(len(list_filter(labels[-64:], lambda x: x <> -100)) AS BIGINT) AS loss_tokens FROM p""")
def loss_mask_labels(spark, sf_dir):
    made = P.labelled_turns(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", P.word_tokens(F.col("text")), 64)
    return made.select("conv_id", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"), F.size(F.filter("labels", lambda x: x != P.IGNORED)).cast("long").alias("loss_tokens"))


@query(f"""WITH t AS (SELECT doc_id, list_append({W_SQL}, CAST(0 AS BIGINT)) AS ids FROM documents), p AS (SELECT doc_id, ids, unnest(range(0, CAST(ceil(len(ids) / 128.0) AS BIGINT))) AS chunk FROM t)
    SELECT doc_id, chunk, CAST(len(ids[chunk * 128 + 1:chunk * 128 + 128]) AS BIGINT) AS n, CAST(list_sum(ids[chunk * 128 + 1:chunk * 128 + 128]) AS BIGINT) AS total FROM p""")
def pretrain_chunks(spark, sf_dir):
    made = P.token_chunks(read(spark, sf_dir, "documents").select("doc_id", "text"), P.word_tokens(F.col("text")), 128, 0)
    return made.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("input_ids").cast("long").alias("n"), F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"""WITH t AS (SELECT d.doc_id, l.quality, ({W_SQL})[1:32] AS ids FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT doc_id, array_to_string(ids, ' ') AS input_ids, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i = len(ids) THEN quality ELSE -100 END), ' ') AS labels FROM t""")
def classification_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    ids, labels = P.classification(P.word_tokens(F.col("text")), F.col("quality"), 32)
    return rows.select("doc_id", F.array_join(ids, " ").alias("input_ids"), F.array_join(labels, " ").alias("labels"))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") % 8).alias("shard"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.size(P.word_tokens(F.col("text"))).cast("long").alias("n"), P.word_tokens(F.col("text")).alias("ids"))


Z_SQL = f"z AS (SELECT conv_id % 8 AS shard, conv_id * 1000 + turn AS ord, CAST(len({W_SQL}) AS BIGINT) AS n, {W_SQL} AS ids FROM conversations)"


def first_fit_sql(budget: int, buffer: int, force: bool, table: str) -> str:
    """Rows (shard, ord, n, batch): each step of the recursion takes in a sample or, if enough wait or all are in, a batch."""
    rows = "STRUCT(ord BIGINT, n BIGINT)[]"
    fits = f"acc.used + x.n <= {budget}" + (" OR acc.used = 0" if force else "")
    take = f"""list_reduce(waiting, lambda acc, x: CASE WHEN {fits} THEN {{'used': acc.used + x.n, 'taken': list_append(acc.taken, x), 'rest': acc.rest}}
        ELSE {{'used': acc.used, 'taken': acc.taken, 'rest': list_append(acc.rest, x)}} END, {{'used': 0::BIGINT, 'taken': []::{rows}, 'rest': []::{rows}}})"""
    return f"""{table}_a AS (SELECT shard, list({{'ord': ord, 'n': n}} ORDER BY ord) AS items FROM z {'' if force else f'WHERE n <= {budget}'} GROUP BY shard),
    {table}_s AS (SELECT shard, items, 1::BIGINT AS i, []::{rows} AS waiting, (-1)::BIGINT AS batch, []::{rows} AS taken FROM {table}_a
      UNION ALL SELECT shard, items, CASE WHEN ready THEN i ELSE i + 1 END, CASE WHEN ready THEN r.rest ELSE list_append(waiting, items[i]) END, CASE WHEN ready THEN batch + 1 ELSE batch END, CASE WHEN ready THEN r.taken ELSE []::{rows} END
      FROM (SELECT *, i > len(items) OR (len(waiting) >= {buffer} AND coalesce(list_sum(list_transform(waiting, lambda x: x.n)), 0) >= {budget}) AS ready, {take} AS r FROM {table}_s WHERE i <= len(items) OR len(waiting) > 0)),
    {table} AS (SELECT shard, x.ord AS ord, x.n AS n, batch FROM (SELECT shard, batch, unnest(taken) AS x FROM {table}_s))"""


Q_SQL = f"{Z_SQL}, {first_fit_sql(256, 8, False, 'f')}, q AS (SELECT f.*, z.ids FROM f JOIN z ON f.shard = z.shard AND f.ord = z.ord)"


@query(f"""WITH RECURSIVE {Z_SQL}, y AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ord) AS i FROM z WHERE n <= 256),
    w AS (SELECT shard, ord, n, i, 0::BIGINT AS batch, n AS used FROM y WHERE i = 1 UNION ALL SELECT y.shard, y.ord, y.n, y.i, CASE WHEN w.used + y.n > 256 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used + y.n > 256 THEN y.n ELSE w.used + y.n END FROM w JOIN y ON w.shard = y.shard AND y.i = w.i + 1)
    SELECT shard, ord, n, batch FROM w""")
def pack_sequential(spark, sf_dir):
    return P.pack_sequential(sized(spark, sf_dir), "shard", "ord", "n", 256).select("shard", "ord", "n", "batch")


@query(f"WITH RECURSIVE {Z_SQL}, {first_fit_sql(256, 8, False, 'f')} SELECT * FROM f")
def pack_first_fit(spark, sf_dir):
    return P.pack_first_fit(sized(spark, sf_dir), "shard", "ord", "n", 256)


@query(f"WITH RECURSIVE {Z_SQL.replace('conv_id % 8', 'conv_id * 0')}, {first_fit_sql(256, 8, False, 'f')} SELECT * FROM f")
def pack_hot_shard(spark, sf_dir):
    """All rows in one shard, packed by ranges."""
    return range_packing.pack(sized(spark, sf_dir).withColumn("shard", F.lit(0)), "shard", "ord", "n", range_packing.first_fit(256, 8, False)).select("shard", "ord", "n", "batch")


@query(f"WITH RECURSIVE {Z_SQL}, {first_fit_sql(64, 8, True, 'f')} SELECT * FROM f")
def pack_force_first(spark, sf_dir):
    return P.pack_first_fit(sized(spark, sf_dir), "shard", "ord", "n", 64, force=True)


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit batches, collated."""
    rows = sized(spark, sf_dir)
    return P.collate(P.pack_first_fit(rows, "shard", "ord", "n", 256).join(rows.select("shard", "ord", "ids"), ["shard", "ord"]), ["shard", "batch"], "ord", "ids")


def texts_of(*columns: str) -> list:
    return [F.array_join(c, " ").alias(c) for c in columns]


COLLATED = f"""{Q_SQL}, o AS (SELECT shard, batch, flatten(list(ids ORDER BY ord)) AS input_ids, flatten(list(list_transform(ids, lambda x, i: CASE WHEN i = 1 AND ord <> low THEN -100 ELSE x END) ORDER BY ord)) AS labels,
        flatten(list(list_transform(ids, lambda x, i: i - 1) ORDER BY ord)) AS position_ids, max(n) AS max_length FROM (SELECT *, min(ord) OVER (PARTITION BY shard, batch) AS low FROM q) GROUP BY shard, batch),
    s AS (SELECT shard, batch, sum(n) OVER (PARTITION BY shard, batch ORDER BY ord) AS e, ord FROM q), u AS (SELECT shard, batch, '0 ' || string_agg(CAST(e AS VARCHAR), ' ' ORDER BY ord) AS cu FROM s GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {COLLATED} SELECT o.shard, o.batch, array_to_string(input_ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels, array_to_string(position_ids, ' ') AS position_ids, cu AS cu_seq_lens, max_length FROM o JOIN u ON o.shard = u.shard AND o.batch = u.batch")
def pack_collate(spark, sf_dir):
    return packed(spark, sf_dir).select("shard", "batch", *texts_of("input_ids", "labels", "position_ids", "cu_seq_lens"), "max_length")


@query(f"""WITH RECURSIVE {COLLATED}, k AS (SELECT *, CAST(300 - len(input_ids) AS BIGINT) AS p FROM o)
    SELECT k.shard, k.batch, array_to_string(list_concat(input_ids, list_transform(range(0, p), lambda x: CAST(0 AS BIGINT))), ' ') AS input_ids, array_to_string(list_concat(labels, list_transform(range(0, p), lambda x: CAST(-100 AS BIGINT))), ' ') AS labels,
    array_to_string(list_concat(position_ids, range(0, p)), ' ') AS position_ids, cu || ' 300' AS cu_seq_lens, greatest(max_length, p) AS max_length FROM k JOIN u ON k.shard = u.shard AND k.batch = u.batch""")
def pack_pad_to_length(spark, sf_dir):
    return P.padded_to(packed(spark, sf_dir), 300).select("shard", "batch", *texts_of("input_ids", "labels", "position_ids", "cu_seq_lens"), "max_length")


@query(f"WITH RECURSIVE {Q_SQL} SELECT shard, batch, row_number() OVER (PARTITION BY shard, batch ORDER BY ord) - 1 AS place, array_to_string(ids, ' ') AS input_ids, n FROM q")
def pack_unpack(spark, sf_dir):
    return P.unpacked(packed(spark, sf_dir), ["shard", "batch"]).select("shard", "batch", F.col("place").cast("long").alias("place"), F.array_join("input_ids", " ").alias("input_ids"), F.size("input_ids").cast("long").alias("n"))


@query(f"WITH RECURSIVE {Q_SQL} SELECT shard, batch, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY ord) AS seq_lens, CAST(max(n) AS BIGINT) AS longest FROM q GROUP BY shard, batch")
def batch_seq_lens(spark, sf_dir):
    lens = F.zip_with(F.slice("cu_seq_lens", F.lit(2), F.size("cu_seq_lens") - 1), F.slice("cu_seq_lens", F.lit(1), F.size("cu_seq_lens") - 1), lambda b, a: b - a)
    return packed(spark, sf_dir).select("shard", "batch", lens.alias("lens")).select("shard", "batch", F.array_join("lens", " ").alias("seq_lens"), F.array_max("lens").alias("longest"))


@query(f"WITH RECURSIVE {COLLATED} SELECT o.shard, o.batch, array_to_string(list_append(list_filter(list_transform(position_ids, lambda p, i: CASE WHEN p = 0 THEN i - 1 END), lambda x: x IS NOT NULL), CAST(len(position_ids) AS BIGINT)), ' ') AS cu_seq_lens FROM o")
def cu_seqlens(spark, sf_dir):
    return packed(spark, sf_dir).select("shard", "batch", F.array_join(P.cu_seq_lens(F.col("position_ids")), " ").alias("cu_seq_lens"))


@query(f"""WITH RECURSIVE {COLLATED}, f4 AS (SELECT shard, batch, input_ids AS x, position_ids AS p, CAST(ceil(len(input_ids) / 4.0) AS BIGINT) AS k, unnest(range(0, 4)) AS rank FROM o)
    SELECT shard, batch, rank, array_to_string(list_transform(range(rank * k + 1, rank * k + k + 1), lambda i: coalesce(x[i], 0)), ' ') AS shard_ids,
    array_to_string(list_transform(range(rank * k + 1, rank * k + k + 1), lambda i: CASE WHEN coalesce(p[i + 1], 0) = 0 THEN -100 ELSE x[i + 1] END), ' ') AS shard_labels FROM f4""")
def seq_shard(spark, sf_dir):
    made = P.shard_sequence(packed(spark, sf_dir), "input_ids", "position_ids", 4)
    return made.select("shard", "batch", F.col("rank").cast("long"), *texts_of("shard_ids", "shard_labels"))


@query(f"WITH RECURSIVE {COLLATED} SELECT shard, batch, array_to_string(input_ids, ' ') AS input_ids FROM o")
def seq_gather(spark, sf_dir):
    """Shards of a sequence, put together again."""
    made = P.shard_sequence(packed(spark, sf_dir).withColumn("size", F.size("input_ids")), "input_ids", "position_ids", 4)
    return P.gathered(made, ["shard", "batch"], "size").select("shard", "batch", F.array_join("input_ids", " ").alias("input_ids"))


@query(f"""WITH {Z_SQL}, m AS (SELECT *, max(n) OVER (PARTITION BY shard, ord // 2000) AS most FROM z)
    SELECT shard, ord, array_to_string(list_concat(ids, list_transform(range(0, most - n), lambda x: CAST(0 AS BIGINT))), ' ') AS input_ids, array_to_string(list_concat(ids, list_transform(range(0, most - n), lambda x: CAST(-100 AS BIGINT))), ' ') AS labels,
    array_to_string(list_transform(range(0, most), lambda i: CASE WHEN i < n THEN 1 ELSE 0 END), ' ') AS attention_mask FROM m""")
def collate_padded(spark, sf_dir):
    made = P.padded(sized(spark, sf_dir).withColumn("step", F.floor(F.col("ord") / 2000)), ["shard", "step"], "ids")
    return made.select("shard", "ord", *texts_of("input_ids", "labels", "attention_mask"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(('0x' || left(md5('7:' || doc_id), 8)) AS BIGINT), doc_id) - 1 AS place FROM documents)
    SELECT doc_id, place // 32 AS step, (place % 32) // 8 AS micro FROM r WHERE place // 32 < (SELECT count(*) // 32 FROM documents)""")
def map_loader(spark, sf_dir):
    """Steps and micro batches without packing, in an order drawn for the epoch; the incomplete last step goes."""
    rows = read(spark, sf_dir, "documents").select("doc_id", M.shuffled_rank(F.col("doc_id"), 7).alias("rank"))
    return P.loader(numbered(rows, ["rank", "doc_id"], name="place").withColumn("place", F.col("place") - 1), "place", 32, 4).select("doc_id", "step", "micro")


@query("""WITH b AS (SELECT doc_id, doc_id AS place, (SELECT count(*) FROM labels) AS t FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id FROM labels)), r AS (SELECT *, unnest(range(0, CAST(ceil(1000.0 / t) AS BIGINT))) AS round FROM b)
    SELECT place, (round * t + place) // 4 AS step, (round * t + place) % 4 AS micro, round > 0 AS padding_flag FROM r WHERE round * t + place < 1000""")
def step_loop(spark, sf_dir):
    """250 steps of 4 batches: the batches start again, and copies are marked."""
    places = numbered(read(spark, sf_dir, "labels").select("doc_id"), ["doc_id"], name="place").select((F.col("place") - 1).alias("place"))
    return P.stepped(places, "place", 4, 250).select("place", F.col("step").cast("long"), F.col("micro").cast("long"), "padding_flag")


@query("SELECT event_id AS step, CASE WHEN event_id <= 500 THEN (2048 - 200) * event_id // 500 + 200 ELSE 2048 END AS budget FROM events")
def warmup_budget(spark, sf_dir):
    """A step for each event."""
    step = F.col("event_id")
    return read(spark, sf_dir, "events").select(step.alias("step"), P.warmed_budget(step, 2048, 500, 200).alias("budget"))


@query("""WITH RECURSIVE g AS (SELECT doc_id // 200 AS step, list({'d': doc_id, 'n': n_chars} ORDER BY n_chars DESC, doc_id) AS items FROM documents GROUP BY 1),
    w AS (SELECT step, items, 1::BIGINT AS i, list_transform(range(0, 8), lambda x: CASE WHEN x = 0 THEN items[1].n::HUGEINT * items[1].n ELSE 0::HUGEINT END) AS loads, 0::BIGINT AS bin FROM g
      UNION ALL SELECT step, items, i + 1, list_transform(loads, lambda x, k: CASE WHEN k = b THEN x + items[i + 1].n::HUGEINT * items[i + 1].n ELSE x END), CAST(b - 1 AS BIGINT) FROM (SELECT *, list_position(loads, list_min(loads)) AS b FROM w WHERE i < len(items)))
    SELECT step, items[i].d AS doc_id, items[i].n AS n, bin FROM w""")
def lpt_balance(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 200).alias("step"), "doc_id", F.col("n_chars").alias("n"))
    return P.balance(docs, "step", "doc_id", "n", 8)


@query(r"""SELECT event_id, nullif(regexp_extract(regexp_replace(regexp_replace('<think>{x}</think>' || chr(10) || '```json' || chr(10) || props || chr(10) || '```', '(?is)<think>.*?</think>', '', 'g'), '(?i)```(json)?', '', 'g'), '(?s)(\{.*\})', 1), '') AS block FROM events""")
def think_strip_json_block(spark, sf_dir):
    raw = F.concat(F.lit("<think>{x}</think>\n```json\n"), "props", F.lit("\n```"))
    return read(spark, sf_dir, "events").select("event_id", X.json_block(raw).alias("block"))


@query("SELECT event_id, props AS value FROM events")
def json_repair(spark, sf_dir):
    raw = F.concat(F.lit("<think>plan</think>```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return read(spark, sf_dir, "events").select("event_id", repair_json_udf(raw).alias("value"))


@query("SELECT event_id, list_sort(list_distinct(list_filter([event_id % 7, 3], lambda x: x > 0 AND x < 10))) AS cuts FROM events")
def cut_index_parse(spark, sf_dir):
    raw = F.concat(F.lit("cuts: ["), (F.col("event_id") % 7).cast("string"), F.lit(", 3, 3.0, 99] done"))
    return read(spark, sf_dir, "events").select("event_id", cut_indices_udf(raw, F.lit(10)).alias("cuts"))


@query("""SELECT conv_id, turn, (t = '') OR length(t) > 10 OR lower(t) IN ('happy', 'sad', 'angry', 'neutral', 'surprised', 'fearful', 'disgusted') OR (length(t) >= 4 AND contains(lower(text), lower(t))) AS bad
    FROM (SELECT *, coalesce(trim(split_part(text, ' ', 2 + CAST(turn % 3 AS INTEGER))), '') AS t FROM conversations)""")
def bad_tag_predicate(spark, sf_dir):
    tag = F.split_part("text", F.lit(" "), (2 + F.col("turn") % 3).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.bad_tag(tag, F.col("text")).alias("bad"))


@query("""WITH w AS (SELECT epoch_us(ts) // 86400000000 AS step, user_id % 8 AS worker, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS own FROM events GROUP BY 1, 2),
    a AS (SELECT step, CAST(sum(own) AS BIGINT) AS total, max(own) AS greatest, sum(own) / count(own) AS mean, list(own ORDER BY worker) AS gathered FROM w GROUP BY step)
    SELECT step, worker, own, total, greatest, mean, gathered FROM w JOIN a USING (step)""")
def worker_reduce(spark, sf_dir):
    """What eight workers reduce and gather for each day."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("step")
    rows = read(spark, sf_dir, "events").select(day, F.pmod("user_id", F.lit(8)).alias("worker"), F.floor(F.col("value") * 1000).alias("milli"))
    return J.all_reduced(rows, "step", "worker", "milli")


# --- scalars of the data plane ---


@query("""SELECT s AS step, round(CASE WHEN s < 100 THEN s / 100.0 ELSE 1 END, 9) AS "constant", round(CASE WHEN s < 100 THEN s / 100.0 ELSE 0.1 + 0.9 * (1 - least(1, (s - 100) / 900.0)) END, 9) AS linear,
    round(CASE WHEN s < 100 THEN s / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(3.141592653589793 * least(1, (s - 100) / 900.0))) END, 9) AS cosine FROM (SELECT event_id AS s FROM events)""")
def lr_schedules(spark, sf_dir):
    """A step for each event; the schedules end at 1000."""
    s = F.col("event_id")
    made = {k: X.warmup_schedule(s, 100, 1000, k, 0.0 if k == "constant" else 0.1) for k in ("constant", "linear", "cosine")}
    return read(spark, sf_dir, "events").select(s.alias("step"), *(F.round(c, 9).alias(k) for k, c in made.items()))


@query("SELECT CAST(ceil(sum(n_chars) * 1.05 / (32 * 2048 * 0.9)) AS BIGINT) AS steps FROM documents")
def steps_per_epoch(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.ceil(F.sum("n_chars") * 1.05 / (32 * 2048 * 0.9)).cast("long").alias("steps"))


@query("SELECT o_custkey, round(sum(o_totalprice * n) / sum(n), 7) AS loss FROM (SELECT *, 1 + o_orderkey % 5 AS n FROM orders) GROUP BY o_custkey")
def token_weighted_loss(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("n", 1 + F.col("o_orderkey") % 5)
    return rows.groupBy("o_custkey").agg(F.round(F.sum(F.col("o_totalprice") * F.col("n")) / F.sum("n"), 7).alias("loss"))


@query("SELECT vec_id, array_to_string(list_transform(m, lambda x: CASE WHEN x IN (-200, -201) THEN 0 ELSE x END), ' ') AS input_ids, CAST(len(list_filter(m, lambda x: x = -200)) AS BIGINT) AS images_in, CAST(len(list_filter(m, lambda x: x = -201)) AS BIGINT) AS images_out FROM (SELECT vec_id, list_transform(range(0, 12), lambda i: CASE WHEN (vec_id + i) % 5 = 0 THEN -200 WHEN (vec_id + i) % 7 = 0 THEN -201 ELSE i END) AS m FROM embeddings)")
def modality_mask(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when((F.col("vec_id") + i) % 5 == 0, -200).when((F.col("vec_id") + i) % 7 == 0, -201).otherwise(i).cast("long"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids"))
    m = X.mask_tokens(F.col("ids"), {"in": -200, "out": -201})
    count = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    return rows.select("vec_id", F.array_join(m["input_ids"], " ").alias("input_ids"), count(m["in_mask"]).alias("images_in"), count(m["out_mask"]).alias("images_out"))


@query("""WITH x AS (SELECT p_partkey, p_size * 37 AS a, p_partkey % 900 + 30 AS b FROM part), y AS (SELECT *, greatest(28, round_even(a / 28.0, 0) * 28) AS h, greatest(28, round_even(b / 28.0, 0) * 28) AS w, sqrt(a * b / 400000.0) AS down, sqrt(100000.0 / (a * b)) AS up FROM x)
    SELECT p_partkey, CAST(CASE WHEN h * w > 400000 THEN greatest(28, floor(a / down / 28) * 28) WHEN h * w < 100000 THEN ceil(a * up / 28) * 28 ELSE h END AS BIGINT) AS h,
    CAST(CASE WHEN h * w > 400000 THEN greatest(28, floor(b / down / 28) * 28) WHEN h * w < 100000 THEN ceil(b * up / 28) * 28 ELSE w END AS BIGINT) AS w FROM y""")
def resize_geometry(spark, sf_dir):
    h, w = X.resized(F.col("p_size") * 37, F.col("p_partkey") % 900 + 30, 28, 100_000, 400_000)
    return read(spark, sf_dir, "part").select("p_partkey", h.alias("h"), w.alias("w"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(l_quantity, 30) - greatest(l_linenumber * 5, 10)) AS DOUBLE) AS shared FROM lineitem")
def interval_overlap(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.overlap(F.col("l_linenumber") * 5, F.col("l_quantity"), F.lit(10), F.lit(30)).cast("double").alias("shared"))


@query("""WITH v AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations), d AS (SELECT doc_id % 100 AS conv_id, CASE doc_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'system' END AS role, doc_id FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY doc_id) AS nth FROM d) SELECT v.conv_id, v.turn, n.doc_id AS value FROM v LEFT JOIN n ON v.conv_id = n.conv_id AND v.role = n.role AND v.nth = n.nth""")
def positional_zip(spark, sf_dir):
    places = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    values = read(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("conv_id"), F.when(F.col("doc_id") % 3 == 0, "user").when(F.col("doc_id") % 3 == 1, "assistant").otherwise("system").alias("role"), F.col("doc_id").alias("index"), F.col("doc_id").alias("value"))
    return J.zip_by_place(places, values, ["conv_id", "role"], "turn").select("conv_id", "turn", "value")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, unnest([l_partkey % 8, l_suppkey % 8]) AS expert, unnest([3, 1]) AS w, CAST(l_quantity AS BIGINT) AS x FROM lineitem),
    o AS (SELECT l_orderkey, l_linenumber, sum(w * (x * (expert + 1) + expert)) AS mixed FROM t GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, CAST(mixed AS DOUBLE) / 4 AS mixed FROM o""")
def expert_permute(spark, sf_dir):
    """Each token goes to its two experts, is worked on there in their order, and comes back as a weighted sum."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("x"), F.explode(F.array(F.struct((F.col("l_partkey") % 8).alias("expert"), F.lit(3).alias("w")), F.struct((F.col("l_suppkey") % 8).alias("expert"), F.lit(1).alias("w")))).alias("to"))
    return J.through_experts(rows.select("l_orderkey", "l_linenumber", "x", "to.*"), ["l_orderkey", "l_linenumber"], "expert", F.col("x") * (F.col("expert") + 1) + F.col("expert"), "w").select("l_orderkey", "l_linenumber", (F.col("mixed").cast("double") / 4).alias("mixed"))


# --- streams: everything available now, read as a stream ---


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batch = read(spark, sf_dir, name)
    one = any(f.rsplit("/", 1)[-1] == f"{name}.parquet" for f in batch.inputFiles())
    reader = spark.readStream.schema(batch.schema)
    rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one else reader.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    found = B.drain(B.tumbling(stream(spark, sf_dir, "events"), "ts", "event_type", "value", "6 hours", "1 day"), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' * k AS start, event_type, count(*) AS n, max(value) AS largest FROM events, range(0, 2) r(k) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    found = B.drain(B.sliding(stream(spark, sf_dir, "events"), "ts", "event_type", "value", "12 hours", "6 hours", "1 day"), "complete")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "largest")


@query("""WITH RECURSIVE e AS (SELECT user_id % 8 AS shard, event_id AS ord, 1 + event_id % 50 AS n, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS i FROM events),
    w AS (SELECT shard, ord, n, i, 0::BIGINT AS batch, n AS used FROM e WHERE i = 1 UNION ALL SELECT e.shard, e.ord, e.n, e.i, CASE WHEN w.used + e.n > 256 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used + e.n > 256 THEN e.n ELSE w.used + e.n END FROM w JOIN e ON w.shard = e.shard AND e.i = w.i + 1)
    SELECT shard, batch, ord, n FROM w""")
def stream_pack(spark, sf_dir):
    rows = stream(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("shard"), F.col("event_id").alias("ord"), (1 + F.col("event_id") % 50).alias("n"))
    return B.drain(B.pack(rows, "shard", "ord", "n", 256), "append")


@query("SELECT user_id, count(*) AS n, CAST(min(epoch_us(ts)) AS DOUBLE) AS first, CAST(max(epoch_us(ts) + 1000000) AS DOUBLE) AS last FROM events GROUP BY user_id")
def stream_accumulate(spark, sf_dir):
    at = F.unix_micros("ts").cast("double")
    rows = stream(spark, sf_dir, "events").select("user_id", at.alias("start"), (at + 1000000).alias("end"))
    found = B.drain(B.accumulate(rows, "user_id", "start", "end"), "update")
    return found.groupBy("user_id").agg(*(F.max_by(c, "n").alias(c) for c in ("first", "last")), F.max("n").alias("n")).select("user_id", "n", "first", "last")


from . import files, media, records, scalars, streams, tokens  # noqa: E402, F401  they add their queries
