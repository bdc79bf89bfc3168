"""Boosted trees against an exhaustive search of splits and a walk by hand; awkward rows."""

import math

import numpy as np

from voxweave.llm import quality_trees as Q


def data(n=400, features=4, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, features)), 1)  # many ties
    y = (x[:, 1] + 0.5 * x[:, 2] ** 2 + r.normal(0, 0.4, n) > 0.4).astype(float)
    return x, y


def test_first_split_is_the_best_of_all(monkeypatch):
    monkeypatch.setattr(Q, "TREES", 1)
    monkeypatch.setattr(Q, "DEPTH", 1)
    for seed in range(5):
        x, y = data(seed=seed)
        model = Q.fit(x, y)
        share = y.mean()
        g, h = share - y, np.full(len(y), share * (1 - share))
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + Q.L2)
        found = []
        for f in range(x.shape[1]):
            for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, Q.BINS + 1)[1:-1], method="lower")):
                right = x[:, f] > t
                if right.sum() >= Q.LEAST_ROWS and (~right).sum() >= Q.LEAST_ROWS:
                    found.append((worth(right) + worth(~right), f, t))
        best = max(v for v, _, _ in found)
        f, t = int(model.feature[0]), float(model.threshold[0])
        assert any(abs(v - best) < 1e-9 and (f, t) == (a, b) for v, a, b in found)
        right = x[:, f] > t
        for node, rows in ((model.left[0], ~right), (model.left[0] + 1, right)):
            assert math.isclose(model.value[node], -Q.RATE * g[rows].sum() / (h[rows].sum() + Q.L2))


def test_scores_are_those_of_walking_down_each_tree():
    x, y = data(300)
    model = Q.fit(x, y)
    assert len(model.roots) == Q.TREES
    got = model.scores(np.vstack([x, [[np.inf] * 4, [-np.inf] * 4, [0.0] * 4]]))
    for row, s in zip(np.vstack([x, [[np.inf] * 4, [-np.inf] * 4, [0.0] * 4]]), got):
        total = model.base
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] + (row[model.feature[at]] > model.threshold[at])
            total += model.value[at]
        assert math.isclose(s, 1 / (1 + math.exp(-total)), rel_tol=1e-12)
    loss = lambda s: -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()
    assert loss(got[:300]) < 0.5 * loss(np.full(300, y.mean()))


def test_awkward_rows(spark):
    r = np.random.default_rng(2)
    good = [" ".join(r.choice(["the", "of", "harbour", "stone", "walks"], 40)) + "." for _ in range(60)]
    bad = ["$$$ " * int(k) for k in r.integers(5, 60, 60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (502, " \n"), (None, good[0]), (0, good[0]), (503, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    got = Q.score(docs, model).collect()
    assert got[0].asDict().keys() >= {"doc_id", "text", "score", "quality", "_vw_score"} and len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[500]["_vw_score"] == by[501]["_vw_score"] and all(0 <= r["_vw_score"] <= 1 and r["_vw_predicted"] == (r["_vw_score"] >= 0.7) for r in got)
    assert len({r["_vw_score"] for r in got if r["text"] == good[0]}) == 1 and by[None]["_vw_held_out"] is False
    # Labels of held-out rows change nothing.
    held = [r["doc_id"] for r in got if r["_vw_held_out"]]
    other = spark.createDataFrame([(i, int(i < 60) ^ (i in held), 0) for i in range(120)] + [(4, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["_vw_score"] for r in Q.score(docs, Q.train(docs, other)).collect()} == {i: r["_vw_score"] for i, r in by.items()}
