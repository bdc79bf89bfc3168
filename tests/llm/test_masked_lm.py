"""LM scoring against plain loops, and the window network on rows that it hasn't seen."""

import collections
import math

import numpy as np
import pyarrow.parquet as pq

from voxweave.llm import masked_lm
from voxweave.llm.common import Scratch, word_hashes

WORDS = [f"{a}{b}x" for a in "abcdefghijklmnopqrst" for b in "uvwxyz"]


def body(seed, n):
    return " ".join(WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n))


def shape(word):
    core = word[:-1] if not word[-1:].isalnum() and word[-1] < 128 else word
    return (65 <= word[0] <= 90) * 16 + (len(core) < len(word)) * 8 + (not (core.isascii() and core.isalpha())) * 4 + (len(word) > 3) + (len(word) > 6) + (len(word) > 10)


def test_shapes():
    words = ["a", "B", "Bc.", ".", "é", "Éa,", "don't", "x1", "1", "1.", "ABCDEFGHIJKL!", "abcé", "日本語"]
    raw = " ".join(words).encode()
    x = masked_lm.Words([raw, b"", b" \n", raw])
    assert x.shapes.tolist() == [shape(w.encode()) for w in words * 2] and x.n.tolist() == [len(words), 0, 0, len(words)]


def softmax_by_hand(net, classes, wide, t):
    """P(class) at place t of a sequence with two ends about it, number by number."""
    p = {k: x.astype(float) for k, x in net.p.items()}
    h = p["b"].copy()
    for k, o in enumerate((-2, -1, 1, 2)):
        h += (p["e"][classes[t + o]] + p["e"][wide[t + o]]) @ p["w"][k]
    z = np.exp(np.tanh(h) @ p["v"] + p["c"])
    return z / z.sum()


def test_scores_are_the_network_s_own_and_sum_to_one(spark):
    texts = [body(i, 40) for i in range(30)] + ["", None, " \n", "one", body(3, 40), "a a a a Big, 12"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk int").repartition(3)
    model, chunks, answers = masked_lm.fit(docs, Scratch(spark), 700)
    got = {r["doc_id"]: r for r in masked_lm.score(model, chunks, answers).collect()}
    words = [(t or "").split() for t in texts]
    count = collections.Counter(w for d in words for w in d)
    hashed = lambda w: int(word_hashes([w.encode()])[0])
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    frequent = sorted((w for w in count if count[w] > 1), key=lambda w: (-count[w], signed(hashed(w))))[: masked_lm.FREQUENT]
    number = {w: i + 1 for i, w in enumerate(frequent)}
    of = {w: number.get(w, masked_lm.FREQUENT + 1 + shape(w.encode())) for w in count}
    wide = {w: masked_lm.CLASSES + (hashed(w) >> 20) % masked_lm.HASHED for w in of}
    sizes = collections.Counter()
    for w, c in of.items():
        sizes[c] += count[w]
    assert [sizes[c] for c in range(masked_lm.CLASSES)] == model.classes.tolist()
    end = masked_lm.CLASSES + masked_lm.HASHED
    for i, d in enumerate(words):
        want = 0.0
        classes, other = [0, 0, *(of[w] for w in d), 0, 0], [end, end, *(wide[w] for w in d), end, end]
        for t, w in enumerate(d):
            soft = softmax_by_hand(model.net, classes, other, t + 2)
            want += math.log(soft[of[w]] * count[w] / sizes[of[w]])
            if i in (0, 35):
                assert abs(sum(soft[of[v]] * count[v] / sizes[of[v]] for v in of) - 1) < 1e-5
        assert got[i]["n_tokens"] == len(d) and abs(got[i]["log_prob"] - want) < 1e-3 * (1 + abs(want))
    assert abs(got[3]["mean_log_prob"] - got[34]["mean_log_prob"]) < 1e-6  # equal texts
    assert got[30]["mean_log_prob"] is None and got[30]["log_prob"] == 0.0
    assert masked_lm.score_corpus(docs.limit(0), Scratch(spark)).count() == 0


def test_network_beats_class_frequencies_on_unseen_text():
    r = np.random.default_rng(1)

    def text(n):  # every word follows from those two before and two behind it, nearly always
        w = [0, 1]
        while len(w) < n:
            w.append(int((w[-1] + 2 * w[-2] + 1) % 29) if r.random() < 0.9 else int(r.integers(0, 29)))
        return " ".join(WORDS[i] for i in w).encode()

    train, held = [text(400) for _ in range(150)], [text(400) for _ in range(10)]
    keys = np.sort(word_hashes([w.encode() for w in WORDS[:29]]))
    number = np.arange(1, 30)
    net = masked_lm.WindowNetwork()
    for _ in range(3):
        for x in train:
            net.learn(*masked_lm.Words([x]).inputs(keys, number))
    classes, wide = masked_lm.Words(held).inputs(keys, number)
    own = classes[classes > 0]
    share = np.bincount(masked_lm.Words(train).inputs(keys, number)[0], minlength=masked_lm.CLASSES)[1:] / (150 * 400)
    assert net.log_probs(classes, wide).mean() > np.log(share[own - 1]).mean() + 0.5


def test_gradients_are_those_of_the_loss():
    net, r = masked_lm.WindowNetwork(), np.random.default_rng(3)
    classes = np.concatenate([[0, 0], r.integers(1, masked_lm.CLASSES, 30), [0, 0]])
    wide = np.where(classes > 0, masked_lm.CLASSES + classes, masked_lm.CLASSES + masked_lm.HASHED)
    before = {k: x.astype(np.float64) for k, x in net.p.items()}
    loss = lambda p: -(setattr(net, "p", p) or net.log_probs(classes, wide).mean())
    slopes = {}
    for k, place in (("e", (5, 2)), ("e", (int(wide[9]), 1)), ("w", (0, 3, 4)), ("w", (2, 1, 0)), ("b", (7,)), ("v", (3, int(classes[8]))), ("c", (int(classes[5]),))):
        up, down = ({n: x.copy() for n, x in before.items()} for _ in range(2))
        up[k][place] += 1e-4
        down[k][place] -= 1e-4
        slopes[k, place] = (loss(up) - loss(down)) / 2e-4
    net.p = {k: x.copy() for k, x in before.items()}
    net.step(classes, wide)
    for (k, place), slope in slopes.items():
        assert abs(10 * net.m[k][place] - slope) < 1e-4 + 1e-3 * abs(slope)  # the first step's mean is a tenth of the gradient


def test_held_out_documents_are_likelier_than_by_counts(monkeypatch):
    """On text that the network hasn't learned from, its two levels beat unigrams clearly, whatever the number of classes."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    train, held = ([d["text"].encode() for d in docs if d["text"] and (d["doc_id"] % 5 == 0) is k] for k in (False, True))
    count = collections.Counter(masked_lm.Words(train, False).hashes.tolist())
    means = {}
    for classes, frequent in ((128, 95), (64, 31)):
        monkeypatch.setattr(masked_lm, "CLASSES", classes)
        monkeypatch.setattr(masked_lm, "FREQUENT", frequent)
        top = np.array([w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:frequent]], np.uint64)
        order = np.argsort(top)
        top, number = top[order], order + 1
        net, seen = masked_lm.WindowNetwork(), np.zeros(classes)
        for i in range(0, len(train), 100):
            own, wide = masked_lm.Words(train[i : i + 100]).inputs(top, number)
            seen += np.bincount(own[own > 0], minlength=classes)
            net.learn(own, wide)
        words = masked_lm.Words(held)
        own, wide = words.inputs(top, number)
        known = np.array([count[w] for w in words.hashes.tolist()])
        some, of = known > 0, own[own > 0]
        means[classes] = (net.log_probs(own, wide)[some] + np.log(known[some] / seen[of[some]])).mean()
        means["unigram"] = np.log(known[some] / seen.sum()).mean()
    assert min(means[128], means[64]) > means["unigram"] + 0.3, means


def test_a_text_longer_than_a_chunk(spark):
    docs = spark.createDataFrame([(1, body(1, 3000)), (2, "a b"), (3, body(1, 3000))], "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: r for r in masked_lm.score_corpus(docs, Scratch(spark), 500).collect()}
    assert got[1]["n_tokens"] == 3000 and got[1]["log_prob"] == got[3]["log_prob"]
