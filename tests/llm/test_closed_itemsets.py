import hashlib
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxweave.llm import queries
from voxweave.llm.closed_itemsets import Class, closed_itemsets, merged, n_lists, total
from voxweave.llm.common import Scratch


def plain_sets(baskets, least):
    """Supports of all frequent sets, level by level."""
    level, out = {(): set(baskets)}, {}
    while level:
        following = {}
        for c, held in level.items():
            for i in {i for b in held for i in baskets[b] if not c or i > c[-1]}:
                if len(own := {b for b in held if i in baskets[b]}) >= least:
                    following[(*c, i)] = own
        out |= {c: len(held) for c, held in following.items()}
        level = following
    return out


def plain_result(rows, least=5, per=20_000, confidence=60):
    """items -> (support, rules) of closed sets."""
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    sets, out = plain_sets(baskets, max(least, -(-len(baskets) // per))), {}
    larger = {}
    for c, n in sets.items():
        for k in range(len(c)):
            rest = c[:k] + c[k + 1 :]
            larger[rest] = max(larger.get(rest, 0), n)
    for c, n in sets.items():
        if larger.get(c, 0) < n:
            rules = [(i, sets[rest], sets[(i,)]) for k, i in enumerate(c) if len(c) > 1 and 100 * n >= confidence * sets[rest := c[:k] + c[k + 1 :]] and n * len(baskets) > sets[rest] * sets[(i,)]]
            out[c] = (n, rules)
    return out


def found(df):
    return {tuple(r["items"]): (r["support"], [tuple(x) for x in r["rules"]]) for r in df.collect()}


rows_of_items = st.lists(st.tuples(st.sets(st.integers(0, 6), min_size=1).map(lambda s: tuple(sorted(s))), st.integers(1, 3)), min_size=1, max_size=12)


@settings(max_examples=300, deadline=None)
@given(rows_of_items, st.integers(1, 4), st.integers(0, 2), st.data())
def test_class_has_the_sets_closed_in_it(rows, least, more, data):
    support = sum(n for _, n in rows) + more
    count = lambda c, rows=rows: sum(n for r, n in rows if set(c) <= set(r))
    every = [c for k in range(1, 8) for c in itertools.combinations(range(7), k)]
    closed = lambda c, n, rows=rows: all(count((*c, z), rows) < n for z in range(7) if z not in c)
    got = list(Class(rows, support, least).closed())
    assert sorted(got) == sorted((list(c), count(c)) for c in every if count(c) >= least and closed(c, count(c)))
    second = data.draw(st.sampled_from([i for r, _ in rows for i in r]))
    part = [(r, n) for r, n in rows if second in r]
    if (n := sum(n for _, n in part)) >= least:
        got = [([*own, second], s) for own, s in Class(part, n, least, second).closed()]
        assert sorted(got) == sorted((list(c), count(c, part)) for c in every if c[-1] == second and count(c, part) >= least and closed(c, count(c, part), part))


@settings(max_examples=200, deadline=None)
@given(rows_of_items)
def test_merging_lists_counts_what_both_hold(rows):
    lists = n_lists(rows)
    for a, b in itertools.combinations(sorted(lists), 2):
        assert total(merged(lists[a], lists[b])) == sum(n for r, n in rows if a in r and b in r)
    assert all(x == sorted(x) and all(p[1] < q[1] for p, q in itertools.pairwise(x)) for x in lists.values())


def made(seed, baskets=120, items=14, big=()):
    r = random.Random(seed)
    rows = []
    for b in range(baskets):
        own = {min(items - 1, int(r.expovariate(0.3))) for _ in range(r.randint(1, 6))}
        own |= {3, 9} if 2 in own and r.random() < 0.9 else set()
        rows += [(b, 10 * i) for i in own]
    for k, n in enumerate(big):
        rows += [(1000 + k, 10 * i) for i in r.sample(range(items * 6), n)]
    return rows


@pytest.mark.parametrize("seed", range(1, 3))
def test_against_plain_search(spark, seed):
    big = [(), (50,), (70, 40, 40)][seed]
    rows = made(seed, big=big)
    rows += rows[:30] + [(None, 10), (5, None), (7000, 10), (7001, 99)]
    df = spark.createDataFrame([(b, i, 1) for b, i in rows], "sale_id long, item_id int, n long")
    for least, most in ((8, 200_000), (8, 2), (3, 1)):
        want = plain_result(rows, least)
        assert len(want) > 30 and any(len(c) > 2 for c in want)
        assert found(closed_itemsets(df, Scratch(spark), "sale_id", "item_id", least, most_rows=most)) == want
    assert found(closed_itemsets(df, Scratch(spark), "sale_id", "item_id", 2, per=10, confidence=30)) == plain_result(rows, 2, 10, 30)


def test_many_like_baskets_and_long_sets(spark):
    rows = [(b, i) for b in range(6) for i in range(40)] + [(b, 100 + i) for b in range(10, 40) for i in range(3)]
    df = spark.createDataFrame(rows, "b long, i long")
    got = found(closed_itemsets(df, Scratch(spark), "b", "i"))
    assert set(got) == {tuple(range(40)), (100, 101, 102)}
    assert got[100, 101, 102] == (30, [(100 + k, 30, 30) for k in range(3)])
    assert found(closed_itemsets(df, Scratch(spark), "b", "i", most_rows=0)) == got


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], "b long, i long, items string")
    assert closed_itemsets(empty, Scratch(spark), "b", "i").count() == 0
    nulls = spark.createDataFrame([(None, 1, "x"), (1, None, "y")], "b long, i long, items string")
    assert closed_itemsets(nulls, Scratch(spark), "b", "i").count() == 0
    one = spark.createDataFrame([(b, 7, "x") for b in range(5)] * 2, "b long, i long, items string")
    assert found(closed_itemsets(one, Scratch(spark), "b", "i")) == {(7,): (5, [])}
    assert closed_itemsets(one.where("b < 4"), Scratch(spark), "b", "i").count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        closed_itemsets(one, Scratch(spark), "items", "i")


def test_query(spark, tmp_path):
    rows = made(5, 200, big=(60,))
    spark.createDataFrame([(b, i, "x") for b, i in rows], "sale_id long, item_id long, flag string").write.parquet(f"{tmp_path}/sale_lines.parquet")
    got = {r["items"]: tuple(r)[1:] for r in queries.op11_closed_itemsets(spark, str(tmp_path)).collect()}
    want = {}
    for c, (n, rules) in plain_result(rows).items():
        best = min(rules, key=lambda r: (r[1], r[0]))[0] if rules else None
        want[",".join(map(str, c))] = (len(c), n, len(rules), best, hashlib.sha256(";".join("%d:%d:%d" % r for r in rules).encode()).hexdigest())
    assert got == want and any(v[2] > 1 for v in got.values())
