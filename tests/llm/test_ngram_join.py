"""The T-occurrence search by itself, and joins whose groups, names or lists are awkward, against all pairs."""

import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from voxweave.llm import ngram_join
from voxweave.llm.common import Scratch

WORDS = [f"{a}{b}x" for a in "abcdefghijklmnopqrst" for b in "uvwxyz"]


def body(seed, n):
    return " ".join(WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n))


@given(st.lists(st.sets(st.integers(0, 30), max_size=20), min_size=1, max_size=9), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_merging_finds_what_stands_in_enough_lists(sets, least):
    want = {v: c for v, c in collections.Counter(v for s in sets for v in s).items() if c >= least}
    assert dict(ngram_join.merge_skip([sorted(s) for s in sets], least)) == want


@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=14), min_size=2, max_size=10), st.sampled_from([50, 80, 85, 100]), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_search_connects_what_links(sets, percent, joined):
    group = list(range(len(sets)))
    group[:joined] = [0] * len(group[:joined])
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    every = list(range(len(sets)))
    up = list(group)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b) and up[i] != up[j]:
                up = [up[j] if u == up[i] else u for u in up]
    got = list(group)
    for i, j in ngram_join.search(arrays, every, every, group, percent):
        assert 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
        got = [got[j] if u == got[i] else u for u in got]
    assert {tuple(k for k, u in enumerate(got) if u == g) for g in got} == {tuple(k for k, u in enumerate(up) if u == g) for g in up}


def components(rows, shingle, percent):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    up = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and up[i] != up[j] and 100 * len(a & b) >= percent * len(a | b):
                up = [up[j] if u == up[i] else u for u in up]
    return {i: (len(s), min(rows[k][0] for k, u in enumerate(up) if u == up[n])) for n, ((i, _), s) in enumerate(zip(rows, sets))}


def test_equal_names_hot_lists_and_blocks_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 400)  # blocks of very few sets
    monkeypatch.setattr(ngram_join, "SENT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    parts, r, rows = [body(900 + k, 20) for k in range(8)], np.random.default_rng(2), []
    for i in range(90):  # nearly all shingles are in hot lists, yet few documents link
        rows.append((i, " ".join(parts[k] for k in r.permutation(8)[:4])))
    for i in range(90, 130):
        w = body(3, 60).split()
        w[int(r.integers(0, 60))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, body(1000 + i, int(r.integers(1, 50)))) for i in range(40)] + [(300, None), (301, ""), (302, body(3, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join_components(docs, Scratch(spark), 4, 85, bits=5).collect()}
    assert got == components(rows, 4, 85)


def test_counters_grow_with_the_text():
    sizes = [0, 1, 10**6, 10**8, 5 * 10**8, 3 * 10**10, 10**14]
    counts = [ngram_join.counters(n) for n in sizes]
    assert counts == sorted(counts) and all(c & (c - 1) == 0 for c in counts)
    assert counts[0] == ngram_join.LEAST_COUNTERS and counts[-1] == ngram_join.MOST_COUNTERS
    for n, c in zip(sizes, counts):  # as many bytes for each counter, within a factor of two
        assert c in (ngram_join.LEAST_COUNTERS, ngram_join.MOST_COUNTERS) or ngram_join.COUNTER_BYTES / 2 <= n / c <= ngram_join.COUNTER_BYTES


def test_steps_rise_and_bound_counts():
    counts = np.unique(np.concatenate([np.arange(70_000), 2 ** np.arange(17, 33)]))
    told = ngram_join.steps(counts)
    assert (np.diff(told.astype(int)) >= 0).all() and len(set(told[1:10].tolist())) == 9
    assert counts[told < ngram_join.steps(np.array([ngram_join.SHORT_LIST]))[0]].max() < ngram_join.SHORT_LIST


@pytest.mark.parametrize("count, chunk, flush", [(16, 4, 1), (64, 64, 50), (1 << 12, 1 << 8, 1 << 22)])
def test_counters_are_those_of_a_plain_count(spark, monkeypatch, count, chunk, flush):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    bodies = [body(k % 30, 5 + k % 40) for k in range(120)] + ["", None, "one"]
    docs = spark.createDataFrame([(i, i, i, t) for i, t in enumerate(bodies)], "doc_id long, k1 long, k2 long, text string").repartition(5)
    sets = ngram_join.sets_of(docs, count)
    want = np.zeros(count, np.int64)
    for t in bodies:
        np.add.at(want, (ngram_join.shingles((t or "").encode()) & np.uint64(count - 1)).astype(int), 1)
    assert ngram_join.sketch_of(sets, count).tolist() == ngram_join.steps(want).tolist()
    assert sets.where("chunk is null").count() == len(bodies)
    assert ngram_join.sketch_of(sets.where(F.lit(False)), count).tolist() == [0] * count


@pytest.mark.parametrize("count, short", [(1, 20_000), (16, 1)])
def test_links_do_not_depend_on_the_counters(spark, monkeypatch, count, short):
    monkeypatch.setattr(ngram_join, "counters", lambda _: count)  # one counter tells nothing apart
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    r, rows = np.random.default_rng(5), []
    for i in range(60):
        w = body(i % 6, 40 + i % 6).split()
        w[int(r.integers(0, 40))] = f"new{i % 9}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, body(50, 30) + " " + body(2000 + i, 12)) for i in range(20)] + [(200, None), (201, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join_components(docs, Scratch(spark)).collect()}
    assert got == components(rows, 4, 85)
