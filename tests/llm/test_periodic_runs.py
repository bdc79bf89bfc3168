import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from voxweave.llm import periodic_runs, queries
from voxweave.llm.periodic_runs import Extensions, kept_places, numbered, runs_of


def plain_runs(words, least=12):
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            e = i + p
            if e - s >= max(least, 2 * p) and not any(all(words[k] == words[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def sequences(draw):
    ids = draw(st.lists(st.integers(0, 3), max_size=50))
    for _ in range(draw(st.integers(0, 2))):
        part = ids[draw(st.integers(0, len(ids))) :][: draw(st.integers(1, 9))]
        ids = ids[: draw(st.integers(0, len(ids)))] + part * draw(st.integers(0, 5)) + part[: draw(st.integers(0, 4))]
    return numbered([b"%d" % i for i in ids])


@settings(max_examples=400, deadline=None)
@given(sequences(), st.sampled_from([2, 3, 5, 12]))
def test_runs_are_those_of_plain_search(ids, least):
    assert runs_of(ids, least) == plain_runs(ids, least)


def test_wrong_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x * periodic_runs.U64(0))  # everything looks equal
    for k in range(60):
        ids = numbered([b"%d" % (zlib.crc32(b"%d %d" % (k, i % (3 + k % 7))) % 3 if i < 25 else i % 2) for i in range(40)])
        assert runs_of(ids, 4) == plain_runs(ids, 4)


def test_extensions():
    ids = [0, 1] * 30 + [2, 3] * 30 + [0, 1] * 30
    x = Extensions(ids)
    for i, j in [(50, 52), (0, 120), (4, 6), (2, 4), (0, 2), (1, 121), (118, 119)]:
        k = 0
        while j + k < len(ids) and ids[i + k] == ids[j + k]:
            k += 1
        assert x.ahead(i, j) == k


def test_long_text():
    ids = list(range(700)) * 30 + [1] * 5000
    assert runs_of(ids) == [(0, 21_000, 700), (21_000, 5000, 1)]


def test_awkward_rows(spark):
    schema = "doc_id long, text string, text_ string, `n runs` array<int>"
    rows = [(1, None, "x", [1]), (2, "", None, None), (None, "a " * 13, None, []), (4, " \n", "", None), (4, "a " * 13, "", None), (5, "a b c d e f a b c d e f a", "", None), (6, "a b " * 5, "", None)]
    got = sorted((tuple(r) for r in periodic_runs.collapse_runs(spark.createDataFrame(rows, schema)).drop("text_", "n runs").collect()), key=str)
    run = lambda *r: [r]
    assert got == sorted([(1, None, [], 0, 0), (2, "", [], 0, 0), (None, "a", run(0, 13, 1), 13, 12), (4, "", [], 0, 0), (4, "a", run(0, 13, 1), 13, 12), (5, "a b c d e f", run(0, 13, 6), 13, 7), (6, "a b a b a b a b a b", [], 10, 0)], key=str)
    assert periodic_runs.collapse_runs(spark.createDataFrame([], schema)).count() == 0


def test_query(spark, tmp_path):
    rows = [(i, " ".join(f"w{zlib.crc32(b'%d %d' % (i, k)) % (3 + i)}" for k in range(i % 37 * 3)) + ("\tx y \n" * 14 if i % 5 == 0 else "")) for i in range(150)] + [(None, "a " * 20), (151, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, turned = {}, 0
    for i, text in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
        if h % 10 == 0 and n:
            g, turned = h // 10, turned + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        kept = b" ".join(w for w, k in zip(words, kept_places(n, runs), strict=True) if k)
        inside = [any(s + q <= k < s + size for s, size, q in runs) for k in range(n)]
        assert kept == b" ".join(w for w, x in zip(words, inside, strict=True) if not x)
        s, size, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digest = lambda x: hashlib.sha256(x).hexdigest()
        want[i] = (i, len(runs), s, size, q, 1000 * size // q if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), digest(kept if runs or h % 10 == 0 else b" ".join(words)))
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == want and turned > 5 and sum(r[1] > 0 for r in want.values()) > 20
