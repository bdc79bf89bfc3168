"""Top k by Hamming distance against all pairs."""

import numpy as np
import pytest

from voxweave.llm import hamming_search
from voxweave.llm.common import Scratch


def brute(rows, k, every):
    size = max((len(v) for i, v in rows if i is not None and v is not None), default=0)
    code = [(i, tuple(x is not None and x > 0 for x in v) + (False,) * (size - len(v))) for i, v in rows if i is not None and v is not None]
    want = []
    for q, a in ((i, c) for i, c in code if i % every == 0):
        near = sorted((sum(x != y for x, y in zip(a, c)), i) for i, c in code)[:k]
        want += [(q, i, d, r + 1) for r, (d, i) in enumerate(near)]
    return want


def case(name):
    r = np.random.default_rng(1)
    if name == "copies":  # a code that many rows share, null vectors and ids
        return [(i, [float(x) for x in r.normal(size=24)]) for i in range(0, 900, 3)] + [(5000 + i, [1.0] * 24) for i in range(40)] + [(7, None), (None, [1.0] * 24)]
    if name == "wide":  # more than one word of bits, ties at every distance
        base = r.normal(size=130)
        return [(i, [float(x) for x in base * np.where(np.arange(130) == i % 130, -1, 1)]) for i in range(250)]
    return [(1, [1.0, None, -1.0]), (50, [1.0]), (100, []), (100, [1.0, 2.0, 3.0, 4.0]), (150, [None, None]), (3, [0.0, 0.0])]  # lengths, nulls inside, repeated ids


@pytest.mark.parametrize("name", ["copies", "wide", "lengths"])
@pytest.mark.parametrize("blocks", [False, True])
def test_top_k(spark, monkeypatch, name, blocks):
    if blocks:
        monkeypatch.setattr(hamming_search, "BLOCK", 40)
        monkeypatch.setattr(hamming_search, "ASKED", 3)
    rows = case(name)
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, code string, id int")
    got = hamming_search.top_k(table, Scratch(spark), "vec_id", "embedding", 7, 50).collect()
    if name == "lengths":  # a repeated id asks once for each of its rows: only distances can be told apart
        assert {tuple(r)[0] for r in got} == {50, 100, 150}
        assert {tuple(r) for r in got if r["query_id"] != 100} == {x for x in brute(rows, 7, 50) if x[0] != 100}
    else:
        assert sorted(map(tuple, got)) == sorted(brute(rows, 7, 50))


def test_empty_tables(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming_search.top_k(table, Scratch(spark), "vec_id", "embedding").count() == 0
    nulls = spark.createDataFrame([(0, None), (None, [1.0])], "vec_id long, embedding array<float>")
    assert hamming_search.top_k(nulls, Scratch(spark), "vec_id", "embedding").count() == 0
