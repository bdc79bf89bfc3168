"""The buffer against a plain loop, whatever the Arrow batches."""

import pytest

from voxweave.operators.mixing import Mixture, interleave
from voxweave.operators.shuffle_buffer import draw, shuffled


def plain(rows, seed, node, size):
    held, out = [], []
    for i, r in enumerate(rows):
        if len(held) < size:
            held.append(r)
        else:
            j = draw(seed, node, str(i)) % size
            out.append(held[j])
            held[j] = r
    return out + [held[j] for j in sorted(range(len(held)), key=lambda j: (draw(seed, node, f"end {j}"), j))]


@pytest.mark.parametrize(("nodes", "size", "batch"), [(1, 7, 10), (3, 20, 4), (4, 1, 1000), (2, 1000, 3)])
def test_as_a_plain_loop(spark, nodes, size, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(i, f"t{i}", i * i) for i in range(101)], "id long, t string, place_ long").repartition(5)
        rows = [r.asDict() for r in shuffled(df, ["id"], nodes, 3, 2, size).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    each = -(-101 // nodes)
    for node in range(nodes):
        got = [r["id"] for r in sorted((r for r in rows if r["node"] == node), key=lambda r: r["place"])]
        assert got == plain(list(range(101))[node * each : (node + 1) * each], 5, node, size)
    assert len(rows) == 101 and all(r["t"] == f"t{r['id']}" for r in rows)


def test_empty(spark):
    assert shuffled(spark.createDataFrame([], "id long"), ["id"], 2, 1).count() == 0


def test_changing_weights_are_known_but_refused(spark):
    mix = Mixture(("a", "b"), (1.0, 2.0), "changing")
    with pytest.raises(ValueError, match="constant"):
        interleave(spark.createDataFrame([("a", 1)], "s string, i int"), "s", ["i"], mix)
    with pytest.raises(ValueError, match="no such schedule"):
        Mixture(("a",), (1.0,), "other")
