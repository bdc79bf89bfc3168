"""Packing by ranges against a single pass, for packers that forget and packers that don't."""

import random

import pytest

from voxweave.operators import range_packing as R
from voxweave.operators.samples import first_fit, next_fit


def rows(seed, n):
    r = random.Random(seed)
    return [(0 if r.random() < 0.8 else r.randint(1, 3), i, r.choice([r.randint(0, 30), r.randint(1, 120)])) for i in range(n)]


@pytest.mark.parametrize(("packer", "plain"), [
    (R.first_fit(100, 4, False), lambda s: first_fit(s, 100, 4, False)),
    (R.first_fit(60, 3, True), lambda s: first_fit(s, 60, 3, True)),
    (R.first_fit(400, 60, False), lambda s: first_fit(s, 400, 60, False)),  # long buffers: carries differ for long
    (R.next_fit(100), lambda s: next_fit(s, 100)),
])
def test_as_in_one_pass(spark, packer, plain):
    made = rows(5, 700)
    df = spark.createDataFrame(made, "k int, o long, t int").repartition(5)
    got = {(r["k"], r["o"]): r["batch"] for r in R.pack(df, "k", "o", "t", packer, 6).collect()}
    want = {}
    for k in range(4):
        own = [r for r in made if r[0] == k]
        want |= {(k, o): b for (_, o, _), b in zip(own, plain([t for *_, t in own]), strict=True) if b >= 0}
    assert got == want


def test_empty(spark):
    assert R.pack(spark.createDataFrame([], "k int, o long, t int"), "k", "o", "t", R.next_fit(5)).count() == 0
