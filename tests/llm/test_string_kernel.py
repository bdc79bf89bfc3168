import math
import random
import zlib

import numpy as np
import pytest

from voxweave.llm import queries, string_kernel
from voxweave.llm.string_kernel import ORDERS, Kernel, codes_of, kernel_of, predict, ridge, train

WORDS = {"en": "the and of house stone river water which there", "fr": "les des été où rivière maison avec élève être", "de": "über straße und nicht haus wasser groß schön", "es": "año niño casa río el los también corazón"}


def signs(text):
    out = [0]
    for b in text.encode():
        s = ord(chr(b).lower()) - 96 if chr(b).lower() in "abcdefghijklmnopqrstuvwxyz" else 0 if b < 128 else 27 + b % 32 if b < 192 else 59 + b % 4
        if s or out[-1]:
            out.append(s)
    return tuple(out) if not out[-1] else (*out, 0)


def plain_grams(text):
    s = signs(text)
    return [{s[i : i + n] for i in range(len(s) - n + 1)} - {(0,) * n} for n in range(1, ORDERS + 1)]


def plain_kernel(a, b, counting):
    """Mean over lengths of the cosine between sets, of the n-grams that count."""
    total = 0.0
    for x, y, known in zip(plain_grams(a), plain_grams(b), counting, strict=True):
        x, y = x & known, y & known
        total += len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0
    return total / ORDERS


def texts_of(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return [" ".join(r.choice(WORDS[lang].split()).capitalize() if r.random() < 0.2 else r.choice(WORDS[lang].split()) for _ in range(r.randint(1, 30))) + r.choice([".", "!!", " 12\n", ""]) for _ in range(n)]


def test_kernel_is_that_of_sets():
    marks = [t for k in WORDS for t in texts_of(k, 3, 1)]
    kernel = kernel_of([[np.unique(c) for c, _ in codes_of([t.encode()])[1]] for t in marks])
    held = [plain_grams(t) for t in marks]
    counting = [{g for h in held for g in h[n] if sum(g in x[n] for x in held) > 1} for n in range(ORDERS)]
    assert kernel.sizes[-1] == sum(map(len, counting))
    some = ["", "!?", *texts_of("de", 70, 2), "É é ß", "word\x00中文" * 3]
    got = kernel.with_landmarks([t.encode() for t in some])
    want = np.array([[plain_kernel(t, m, counting) for m in marks] for t in some])
    assert np.abs(got - want).max() < 1e-5
    few = kernel_of([[np.unique(c) for c, _ in codes_of([t.encode()])[1]] for t in marks], 50)
    assert few.sizes[-1] == 50 and few.with_landmarks([b"the house"]).shape == (1, 12)


def test_ridge_solves_its_equations():
    r = np.random.default_rng(0)
    kernel = Kernel([np.arange(1, 20, dtype=np.int32)] + [np.zeros(0, np.int32)] * 3, [[np.sort(r.choice(np.arange(1, 20, dtype=np.int32), 9, False))] + [np.zeros(0, np.int32)] * 3 for _ in range(5)])
    values, langs = r.random((40, 5)), np.array(["a", "b", "b", "b"] * 10)
    w = ridge(kernel, values, langs, ["a", "b"], 1e-3)
    v, q = np.linalg.eigh(kernel.kernel(kernel.marks))
    x = np.concatenate([values @ (q / np.sqrt(v)), np.full((40, 1), 0.1)], 1)
    share = np.where(langs == "a", 40 / 20, 40 / 60)
    best = lambda a: (share[:, None] * (x @ a - (langs[:, None] == np.array(["a", "b"]))) ** 2).sum() + 0.04 * (a * a).sum()
    mine = np.concatenate([np.sqrt(v)[:, None] * (q.T @ w[:-1]), w[-1:] / 0.1])
    assert all(best(mine) <= best(mine + r.normal(0, 0.01, mine.shape)) + 1e-6 for _ in range(20))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, lang, i % 3) for lang in WORDS for i, t in enumerate(texts_of(lang, 120, 3), 1000 * list(WORDS).index(lang))]
    rows += [(1, rows[1][1], "en", 0), (9001, None, "en", 0), (9002, "text of none", None, 1), (9003, "123 ?", "de", 1), (9004, "", "fr", 2), (None, rows[0][1], "en", 0), (9005, "what", "und", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_held_out(corpus):
    got = predict(corpus, train(corpus, 60, 24)).collect()
    assert len(got) == corpus.count()
    held = [r for r in got if r["_vw_held_out"] and r["doc_id"] < 9000]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held) and len(held) > 60
    assert sum(r["lang"] == r["_vw_lang"] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["_vw_lang"] == "und" and by[i]["_vw_lang_score"] == 0 for i in (9001, 9003, 9004))
    assert by[9002]["_vw_lang"] == "en" and 0 <= by[9002]["_vw_lang_score"] <= 1 and not by[None]["_vw_held_out"]
    a, b = (r for r in got if r["doc_id"] == 1)
    assert a["_vw_lang_score"] == b["_vw_lang_score"]


def test_labels_that_may_not_be_learned_from_change_nothing(spark, corpus):
    from pyspark.sql import functions as F

    other = corpus.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    a, b = (sorted((str(r["doc_id"]), r["_vw_lang"], r["_vw_lang_score"]) for r in predict(corpus.drop("lang"), train(x, 60, 24)).collect()) for x in (corpus, other))
    assert a == b


def test_nothing_to_learn_from(spark, corpus):
    for some in (corpus.where("doc_id = 9002"), corpus.limit(0)):
        assert {r["_vw_lang"] for r in predict(corpus, train(some)).collect()} == {"und"}
    assert predict(corpus.limit(0), train(corpus, 20, 8)).count() == 0
    one = train(corpus.where("lang = 'fr'"), 20, 8)
    assert {r["_vw_lang"] for r in predict(corpus.where("doc_id < 100"), one).collect()} == {"fr"}
    with pytest.raises(ValueError, match="whole numbers"):
        train(corpus.withColumn("doc_id", string_kernel.F.col("text")))


def test_query(spark):
    rows = queries.op12_string_kernel(spark, "/root/testdata/sf0.001").collect()
    lang = {r["doc_id"]: r["lang"] for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert len(rows) == len(lang) and set(rows[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
