"""Queries over annotations, sample records and order, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts as T
from ..functions import text as X
from ..functions.scoring import scored
from ..functions.tokenizing import ByteEncoder, encoded
from ..operators import joins as J
from ..operators import samples as P
from ..sources.shared import numbered
from .catalog import G_TOK, K_SQL, S_TOK, codec, query, read, spoken


#: The task that samples with a thought name; any name does.
TASK = "THOUGHT"


@query(f"""WITH {K_SQL}, r AS (SELECT vec_id AS ref, {G_TOK} AS g FROM embeddings)
    SELECT c.conv_id, c.turn, '<bos><task_start>TTS<task_end><history_start><audio_his_start><audio_his_end><history_end><target_start><text_start>' || c.text || '<text_end><audio_ref_start>' || coalesce(r.g, k.g) || '<audio_ref_end><target_end><output_start>' AS user_content,
    '<audio_tar_start>' || k.g || ' ' || k.s || '<audio_tar_end><output_end><eos>' AS assistant_content FROM c JOIN k ON c.utt = k.utt LEFT JOIN r ON r.ref = CASE WHEN c.turn % 2 = 0 THEN c.utt + 1 ELSE c.utt + 100000 END WHERE trim(c.text) <> ''""")
def sample_tts_reference(spark, sf_dir):
    """The reference voice is that of the named segment, else the target's own."""
    ref = F.when(F.col("turn") % 2 == 0, F.col("utt") + 1).otherwise(F.col("utt") + 100_000)
    rows = spoken(spark, sf_dir).where(X.present(F.col("text")).isNotNull()).join(codec(spark, sf_dir), "utt").withColumn("ref", ref)
    voices = codec(spark, sf_dir).select(F.col("utt").alias("voice"), X.codec_tokens(F.col("ids"), T.GLOBAL, 32).alias("reference"))
    rows = J.with_fallback(rows, "ref", voices, "voice", "reference", X.codec_tokens(F.col("ids"), T.GLOBAL, 32))
    audio = T.target_tokens(F.col("ids"), F.slice("ids", 33, 1000))
    return rows.select("conv_id", "turn", T.user_content("TTS", T.tts_target(F.col("text"), F.col("reference"))).alias("user_content"), T.assistant_content(audio).alias("assistant_content"))


@query(f"""WITH {K_SQL} SELECT c.conv_id, c.turn, '<bos><task_start>ASR<task_end><history_start><audio_his_start><audio_his_end><history_end><target_start><audio_tar_start>' || k.g || ' ' || k.s || '<audio_tar_end><audio_ref_start><audio_ref_end><target_end><output_start>' AS user_content,
    '<text_start>' || c.text || '<text_end><output_end><eos>' AS assistant_content FROM c JOIN k ON c.utt = k.utt WHERE trim(c.text) <> ''""")
def sample_asr_tags(spark, sf_dir):
    rows = spoken(spark, sf_dir).where(X.present(F.col("text")).isNotNull()).join(codec(spark, sf_dir), "utt")
    audio = T.target_tokens(F.col("ids"), F.slice("ids", 33, 1000))
    return rows.select("conv_id", "turn", T.user_content("ASR", T.asr_target(audio)).alias("user_content"), T.transcript_content(F.col("text")).alias("assistant_content"))


@query(f"""WITH {K_SQL}, h AS (SELECT a.conv_id, a.turn, count(*) AS n, count(k.utt) AS found, string_agg(CASE WHEN b.low = b.turn THEN k.g || ' ' || k.s ELSE k.s END, ' ' ORDER BY b.turn) AS past, string_agg(trim(b.text) || CASE WHEN b.role = 'system' THEN '' ELSE '[' || b.role || ']' END, chr(10) ORDER BY b.turn) FILTER (WHERE trim(b.text) <> '') AS under
        FROM c a JOIN (SELECT b.*, a.turn AS at, min(b.turn) OVER (PARTITION BY b.conv_id, a.turn) AS low FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 4 AND a.turn - 1) b ON a.conv_id = b.conv_id AND a.turn = b.at LEFT JOIN k ON b.utt = k.utt GROUP BY 1, 2)
    SELECT c.conv_id, c.turn, '<bos><task_start>{TASK}<task_end><history_start><audio_his_start>' || h.past || '<audio_his_end><history_end><target_start><text_start>' || c.text || '<text_end><audio_ref_start>' || k.g || '<audio_ref_end><target_end><output_start>' AS user_content,
    '<under_start>' || coalesce(h.under, '') || '<under_end><cot_start>' || CASE WHEN c.turn % 2 = 0 THEN 'thought ' || c.turn ELSE '<Emotion>: ' || c.role || chr(10) || '<Valid duration | Total duration>: ' || c.turn || ' | ' || c.conv_id || chr(10) || '<Loudness | Expressive Intensity>:  | ' || CASE WHEN c.turn % 3 = 0 THEN chr(10) || '[Summary] short' ELSE '' END END
      || '<cot_end><audio_tar_start>' || k.g || ' ' || k.s || '<audio_tar_end><output_end><eos>' AS assistant_content
    FROM c JOIN h ON c.conv_id = h.conv_id AND c.turn = h.turn AND h.n = h.found JOIN k ON c.utt = k.utt""")
def sample_thought(spark, sf_dir):
    """The full sample: spoken history, what lies under it, the thought or what stands for it, and the target's sound."""
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-4, -1)
    past = F.struct("turn", "utt", "text", F.when(F.col("role") == "system", None).otherwise(F.col("role")).alias("emotion_tag"))
    rows = spoken(spark, sf_dir).withColumn("h", F.collect_list(past).over(w)).where(F.size("h") > 0)
    tokens = codec(spark, sf_dir)
    sounds = tokens.select(F.col("utt").alias("utt_h"), F.struct(F.col("ids").alias("global_ids"), F.slice("ids", 33, 1000).alias("semantic_ids")).alias("s"))
    rows = J.gather_all(rows, F.transform("h", lambda x: x["utt"]), "utt_h", sounds, "s", ["conv_id", "turn"]).join(tokens, "utt")
    audio, own = T.target_tokens(F.col("ids"), F.slice("ids", 33, 1000)), X.codec_tokens(F.col("ids"), T.GLOBAL, 32)
    given = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("thought "), F.col("turn").cast("string"))).otherwise(" ")
    thought = T.thought_text(given, F.col("role"), F.col("turn"), F.col("conv_id"), F.lit(None), F.lit(" "), F.when(F.col("turn") % 3 == 0, F.lit(" short ")))
    user = T.user_content(TASK, T.tts_target(F.col("text"), own), T.history_tokens(F.col("values")))
    return rows.select("conv_id", "turn", user.alias("user_content"), T.assistant_content(audio, T.under_text(F.col("h")), thought).alias("assistant_content"))


@query("""WITH t AS (SELECT user_id, event_id // 5 AS part, list(event_type || CASE WHEN event_id % 4 = 0 THEN '' ELSE '(' || event_id % 3 || '-' || event_id % 3 + 1 || ')' END ORDER BY event_id) AS items FROM events GROUP BY 1, 2),
    d AS (SELECT user_id, part, list_filter(items, lambda x, i: list_position(items, x) = i) AS u FROM t) SELECT user_id, part, CASE WHEN length(array_to_string(u, '；')) > 40 THEN left(array_to_string(u, '；'), 40) || '...' ELSE array_to_string(u, '；') END AS text FROM d""")
def acoustic_events(spark, sf_dir):
    at = lambda k: F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 3 + k).cast("string"))
    event = F.struct("event_id", F.col("event_type").alias("label"), at(0).alias("start"), at(1).alias("end"))
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 5).alias("part")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    return rows.select("user_id", "part", T.acoustic_events(F.col("events"), 40).alias("text"))


@query("""SELECT p_partkey, '总时长=' || printf('%.3f', p_size / 8.0) || '；响度=' || CASE WHEN p_partkey % 3 = 0 THEN '?' ELSE printf('%.3f', -p_size / 4.0) END || '；自然度=' || printf('%.3f', CAST(p_partkey % 5 AS DOUBLE)) AS text FROM part""")
def feature_text(spark, sf_dir):
    loud = F.when(F.col("p_partkey") % 3 != 0, -F.col("p_size") / 4)
    return read(spark, sf_dir, "part").select("p_partkey", T.feature_text({"duration": F.col("p_size") / 8, "loudness": loud, "naturalness score": F.col("p_partkey") % 5}).alias("text"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '情绪不明' WHEN turn % 3 = 1 THEN CASE WHEN length(role || 'ly spoken') > 10 THEN left(role || 'ly spoken', 10) || '...' ELSE role || 'ly spoken' END ELSE role END AS emo_tag,
    CASE WHEN turn % 2 = 0 THEN 'acts ' || turn ELSE '无法根据当前历史判断' END AS act, true AS need_cot, '无法根据当前历史判断' AS goal, CASE WHEN turn % 4 = 0 THEN '' ELSE 'sum' END AS summ,
    '因为上下文分析失败，所以说了“' || coalesce(nullif(CASE WHEN length(t) > 80 THEN left(t, 80) || '...' ELSE t END, ''), '这句台词') || '”。' AS failed_summ FROM (SELECT *, trim(translate(text, chr(10), ' ')) AS t FROM conversations)""")
def annotation_assembly(spark, sf_dir):
    turn, role = F.col("turn"), F.col("role")
    none = F.lit(None).cast("string")
    parsed = F.struct(F.when(turn % 3 == 1, F.concat(role, F.lit("ly spoken"))).alias("emo_tag"), F.when(turn % 4 != 0, "sum").alias("summ"), F.when(turn % 2 == 0, F.concat(F.lit("acts "), turn.cast("string"))).alias(T.DIMENSIONS[0]), *(none.alias(d) for d in T.DIMENSIONS[1:]))
    made = T.annotation(parsed, F.when(turn % 3 == 2, role).otherwise(""))
    rows = read(spark, sf_dir, "conversations").withColumns({"a": made, "f": T.failed_annotation(F.col("text"), role)})
    return rows.select("conv_id", "turn", "a.emo_tag", F.col(f"a.{T.DIMENSIONS[0]}.text").alias("act"), F.col(f"a.{T.DIMENSIONS[5]}.need_cot").alias("need_cot"), F.col(f"a.{T.DIMENSIONS[4]}.text").alias("goal"), "a.summ", F.col("f.summ").alias("failed_summ"))


@query("""WITH w AS (SELECT conv_id, turn, role, text, turn // 4 AS scene, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) - 1 AS place FROM conversations),
    l AS (SELECT a.conv_id, a.turn, string_agg('#' || (b.place - greatest(0, a.place - 4)) || ' | 说话人=' || b.role || ' | 原emo-tag=?' || chr(10) || '台词：' || CASE WHEN length(trim(translate(b.text, chr(10), ' '))) > 120 THEN left(trim(translate(b.text, chr(10), ' ')), 120) || '...' ELSE trim(translate(b.text, chr(10), ' ')) END, chr(10) ORDER BY b.turn) AS lines
      FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.scene = b.scene AND b.place BETWEEN a.place - 4 AND a.place GROUP BY 1, 2) SELECT conv_id, turn, 'Annotate the last line.' || chr(10) || lines || chr(10) || 'Answer in JSON.' AS prompt FROM l""")
def annotation_prompt(spark, sf_dir):
    w = Window.partitionBy("conv_id", "scene").orderBy("turn").rowsBetween(-4, 0)
    rows = read(spark, sf_dir, "conversations").withColumn("scene", F.floor(F.col("turn") / 4)).withColumn("past", F.collect_list(F.struct("turn", "role", "text")).over(w))
    lines = F.transform("past", lambda s, i: T.window_line(i, s["role"], F.lit(""), s["text"], F.lit(""), F.lit("")))
    return rows.select("conv_id", "turn", T.prompt("Annotate the last line.", lines, "Answer in JSON.").alias("prompt"))


@query("""WITH f AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN CAST(n_chars AS DOUBLE) END AS duration, CASE WHEN d.doc_id % 6 = 0 THEN CAST(n_chars AS DOUBLE) / 2 END AS loudness, CAST(l.quality AS DOUBLE) AS naturalness_score, CAST(e.label AS DOUBLE) AS noise_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id)
    SELECT *, duration IS NULL AND loudness IS NULL AND naturalness_score IS NULL AND noise_score IS NULL AS missing FROM f""")
def public_features(spark, sf_dir):
    """Raw and score columns under their public names; a segment without any counts as missing."""
    docs = read(spark, sf_dir, "documents")
    raw = docs.where("doc_id % 3 = 0").select("doc_id", F.col("n_chars").cast("double").alias("total_duration_sec"), F.when(F.col("doc_id") % 6 == 0, F.col("n_chars") / 2).alias("rms_dbfs"))
    scores = [read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("utmosv2")), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("double").alias("dnsmos"))]
    rows = J.enrich(docs.select("doc_id"), "doc_id", raw, *scores)
    names = {"total_duration_sec": "duration", "rms_dbfs": "loudness", "utmosv2": "naturalness_score", "dnsmos": "noise_score"}
    return rows.select("doc_id", *(F.col(k).alias(v) for k, v in names.items()), (F.coalesce(*map(F.col, names)).isNull()).alias("missing"))


@query("""WITH t AS (SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n FROM documents) SELECT doc_id, CAST(n AS BIGINT) AS n FROM t WHERE n <> 1""")
def drop_degenerate(spark, sf_dir):
    """Samples of a single id go."""
    rows = read(spark, sf_dir, "documents")
    ids = P.word_tokens(X.first_key(rows.columns, ["content", "text"]))
    return rows.select("doc_id", F.size(ids).cast("long").alias("n")).where("n <> 1")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END AS rank, o_orderpriority FROM orders""")
def fixed_order_rank(spark, sf_dir):
    return J.in_order(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ("1-URGENT", "3-MEDIUM", "2-HIGH"), unknown=True)


@query("""WITH m AS (SELECT o_custkey, o_orderpriority AS model, max(o_orderkey) AS entry FROM orders GROUP BY 1, 2), k AS (SELECT *, CASE model WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 END AS rank FROM m)
    SELECT o_custkey, string_agg(model || '=' || entry, ' ' ORDER BY rank) AS models, count(*) AS n FROM k WHERE rank IS NOT NULL GROUP BY o_custkey""")
def ordered_models(spark, sf_dir):
    """Of each item the entries of the listed models, in the list's order."""
    per = read(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("model")).agg(F.max("o_orderkey").alias("entry"))
    ranked = J.in_order(per, "model", ("1-URGENT", "3-MEDIUM", "2-HIGH"))
    found = ranked.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("rank", "model", "entry"))).alias("all"))
    return found.select("o_custkey", F.array_join(F.transform("all", lambda x: F.concat(x["model"], F.lit("="), x["entry"].cast("string"))), " ").alias("models"), F.size("all").cast("long").alias("n"))


@query("SELECT count(*) AS items, CAST(sum(n) AS BIGINT) AS models, max(n) AS most FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)")
def gallery_totals(spark, sf_dir):
    per = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("models"), F.max("n").alias("most"))


@query("""WITH t AS (SELECT doc_id, list_transform([0.1, 0.25, 0.5, 0.5, 1.0, (doc_id % 7) / 4.0, 0.0], lambda x: greatest(1, least(150, CAST(ceil(x * 100) AS BIGINT)))) AS s FROM documents)
    SELECT doc_id, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ' ') AS steps FROM t""")
def epoch_points(spark, sf_dir):
    points = F.array(*(F.lit(x) for x in (0.1, 0.25, 0.5, 0.5, 1.0)), (F.col("doc_id") % 7) / 4, F.lit(0.0))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.epoch_steps(points, 100, 150), " ").alias("steps"))


@query("SELECT p_partkey, ((p_size - 1) // 4 + 1) * ((p_partkey % 600 + 64) // 16) * ((p_partkey % 400 + 64) // 16) AS tokens FROM part")
def latent_lengths(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.latent_length(F.col("p_size"), F.col("p_partkey") % 600 + 64, F.col("p_partkey") % 400 + 64).alias("tokens"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '[[' || event_id % 9 || '], [1, 2]]' END AS listed FROM events""")
def bracket_literal(spark, sf_dir):
    rest = F.when(F.col("event_id") % 5 == 0, "[[1], [2]").otherwise(F.concat(F.lit("[["), (F.col("event_id") % 9).cast("string"), F.lit("], [1, 2]], \"x\": [3]};")))
    return read(spark, sf_dir, "events").select("event_id", X.bracketed(F.concat(F.lit('window.DATA = {"other": [0], "featured": '), rest), '"featured": [').alias("listed"))


H_SQL = "CAST(('0x' || left(md5(vec_id || ':5:' || {i} || ':{what}'), 8)) AS BIGINT)"


@query(f"""WITH t AS (SELECT vec_id, list_transform(range(0, 24), lambda i: CASE WHEN i IN (2, 14) THEN -1 WHEN i IN (11, 22) THEN -2 ELSE i + vec_id % 3 END) AS ids FROM embeddings),
    s AS (SELECT vec_id, i, e, least(i + 3, e) AS low FROM (SELECT vec_id, unnest([2, 14]) AS i, unnest([11, 22]) AS e FROM embeddings)),
    c AS (SELECT *, CASE WHEN {H_SQL.format(i="i", what="drop")} % 100 < 60 THEN least(CAST(floor((e - low) * 0.5 * ({H_SQL.format(i="i", what="size")} % 1000) / 1000 + 0.5) AS BIGINT), e - low) ELSE 0 END AS cut FROM s),
    p AS (SELECT vec_id, cut, low + {H_SQL.format(i="i", what="at")} % (e - low - cut + 1) AS a FROM c), l AS (SELECT vec_id, list({{'a': a, 'b': a + cut}}) AS gone FROM p GROUP BY vec_id)
    SELECT t.vec_id, array_to_string(list_filter(ids, lambda x, k: len(list_filter(gone, lambda g: k - 1 >= g.a AND k - 1 < g.b)) = 0), ' ') AS input_ids FROM t JOIN l ON t.vec_id = l.vec_id""")
def history_span_drop(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.when(i.isin(2, 14), -1).when(i.isin(11, 22), -2).otherwise(i + F.col("vec_id") % 3).cast("long"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids"))
    return rows.select("vec_id", F.array_join(P.drop_history_spans(F.col("ids"), F.col("vec_id"), -1, -2, 60, 0.5, 2, 5), " ").alias("input_ids"))


class Lengths:
    """A stand-in model: the length of a text; it refuses texts with a z."""

    def open(self) -> None:
        self.ready = True

    def score(self, items: list[str]) -> list[float]:
        if any("z" in x for x in items):
            raise ValueError("z")
        return [float(len(x)) for x in items]

    def close(self) -> None:
        self.ready = False


@query("SELECT doc_id, CASE WHEN contains(text, 'z') THEN NULL ELSE CAST(length(text) AS DOUBLE) END AS score FROM documents")
def score_with_fallback(spark, sf_dir):
    return scored(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", Lengths, "score", "double", 16).drop("text")


@query("SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM documents WHERE lang = 'en') WHERE place <= 25")
def first_valid(spark, sf_dir):
    """The first rows in order that pass a test: sorted within partitions, then merged up to the limit."""
    rows = read(spark, sf_dir, "documents").where("lang = 'en'").orderBy("n_chars", "doc_id").limit(25)
    return rows.select("doc_id", F.row_number().over(Window.orderBy("n_chars", "doc_id")).cast("long").alias("place"))  # the limit's rows


@query("SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts), epoch_us(ts) + CAST(floor(value) AS BIGINT), event_id) AS place FROM events")
def stable_order(spark, sf_dir):
    """Places in the order of start and end, ties by place of origin, without one task for all."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = read(spark, sf_dir, "events").select("event_id", at.alias("start"), (at + F.floor("value").cast("long")).alias("end"))
    return numbered(rows, ["start", "end", "event_id"], name="place").select("event_id", "place")


@query("SELECT doc_id, doc_id % 8 AS rank, n_chars FROM documents")
def redistribute(spark, sf_dir):
    """Rows go to their ranks and come back in their first order."""
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 8).alias("rank"), "n_chars")
    return rows.repartition("rank").sortWithinPartitions("rank", "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")


@query("SELECT conv_id, turn // 4 AS scene, string_agg(role || turn, ' ' ORDER BY turn % 3, turn) AS segments, count(*) AS n FROM conversations GROUP BY 1, 2")
def scene_lists(spark, sf_dir):
    """Scenes as ordered lists of their segments."""
    per = read(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 4).alias("scene")).agg(F.array_sort(F.collect_list(F.struct((F.col("turn") % 3).alias("start"), "turn", "role"))).alias("all"))
    return per.select("conv_id", "scene", F.array_join(F.transform("all", lambda s: F.concat(s["role"], s["turn"].cast("string"))), " ").alias("segments"), F.size("all").cast("long").alias("n"))


@query("""SELECT doc_id // 100 AS step, CAST(sum(n_chars) AS BIGINT) AS tokens, round(avg(n_chars), 4) AS mean, CAST(sum(CAST(n_chars AS HUGEINT) * n_chars) AS DOUBLE) AS squares, round(sum(n_chars) / 2.5, 4) AS tokens_per_second FROM documents GROUP BY 1""")
def step_meters(spark, sf_dir):
    """Tokens, mean length and squared lengths of each step, and tokens a second at a given time a step."""
    n = F.col("n_chars")
    return read(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("step")).agg(F.sum(n).alias("tokens"), F.round(F.avg(n), 4).alias("mean"), F.sum((n * n).cast("decimal(38,0)")).cast("double").alias("squares"), F.round(F.sum(n) / 2.5, 4).alias("tokens_per_second"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * F.col("s_suppkey") * 10).cast("double").alias("p"))


@query("""WITH g AS (SELECT DISTINCT CAST(s_suppkey * s_suppkey * 10 AS DOUBLE) AS p FROM supplier), x AS (SELECT c_custkey, round(abs(c_acctbal)) AS v FROM customer),
    r AS (SELECT c_custkey, p, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(v - p), p) AS k FROM x, g) SELECT c_custkey, p AS nearest FROM r WHERE k = 1""")
def nearest_point(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.round(F.abs("c_acctbal")).alias("v"))
    return J.nearest(rows, "v", _grid(spark, sf_dir), "p").select("c_custkey", "nearest")


@query("""WITH t AS (SELECT doc_id, octet_length(encode(text)) + 1 AS n FROM documents), p AS (SELECT doc_id, n, unnest(range(0, CAST(ceil(n / 512.0) AS BIGINT))) AS chunk FROM t)
    SELECT doc_id, chunk, CAST(least(512, n - chunk * 512) AS BIGINT) AS n FROM p""")
def encoded_chunks(spark, sf_dir):
    """Texts through an encoder (here the bytes of UTF-8), an end id, pieces of at most 512."""
    rows = encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", ByteEncoder)
    return P.token_chunks(rows, F.col("ids"), 512, 0).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("input_ids").cast("long").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, role, octet_length(encode('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))) AS n FROM conversations),
    e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) - n AS behind FROM t)
    SELECT conv_id, CAST(least(200, sum(n)) AS BIGINT) AS n, CAST(coalesce(sum(greatest(0, least(n, 200 - behind))) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS labels FROM e GROUP BY conv_id""")
def encoded_chat(spark, sf_dir):
    """Turns in a chat template through an encoder, the last 200 ids of each conversation; the assistant's are labels."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", P.TEMPLATES["chatml"](F.col("role"), F.col("text")).alias("text"))
    made = P.labelled_turns(encoded(turns, "text", ByteEncoder), "conv_id", "turn", "role", F.col("ids"), 200)
    return made.select("conv_id", F.size("input_ids").cast("long").alias("n"), F.size(F.filter("labels", lambda x: x != P.IGNORED)).cast("long").alias("labels"))
