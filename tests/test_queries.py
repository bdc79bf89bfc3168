"""Every query against its SQL on the small tables."""

import duckdb
import pytest

from voxweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    rows = found.collect()
    assert rows
    if name not in catalog.ORACLES:
        return
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    order = [columns.index(c) for c in found.columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == expected


def test_same_with_other_partitions(spark):
    name = "gap_block_index"
    many = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
