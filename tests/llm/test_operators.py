"""The training-data operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxweave.llm import html_blocks, lexicon_bpe, mixture_packing, ngram_join, quality_trees, substring_dedup
from voxweave.llm.common import Scratch, components
from voxweave.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(40)]  # no digits: those are variable fields
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, k1 long, `odd name` int"


def body(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


def awkward():
    long = body(1, 400)
    near = long.split()
    near[7] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, long), (8, long), (9, " ".join(near)), (9, long), (None, long), (None, None), (10, "a b " * 80),
        (11, body(2, 60) + " " + " ".join(long.split()[50:120])), (12, body(3, 34)), (13, body(3, 34)), (14, "é" * 3000 + " İstanbul ΑΣ ﬁ ½ <|endoftext|> 日本語 don't"), (15, body(4, 20_000)), (7, long),
    ]
    return [(i, t, None, None if i == 3 else "s" * ((i or 0) % 3), 0, "x", 5, 1) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def test_substring_dedup(spark, docs, empty):
    got = substring_dedup.remove_repeats(docs, Scratch(spark))
    assert got.columns[: len(docs.columns)] == docs.columns
    texts = [r["text"] for r in docs.collect()]
    starts = collections.Counter(tuple(w[i : i + 35]) for w in map(words_of, texts) for i in range(len(w) - 34))
    want = collections.Counter()
    for r in docs.collect():
        w = words_of(r["text"])
        gone = {k for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        want[r["doc_id"], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["_vw_words"], r["_vw_removed"], r["_vw_kept_sha256"]) for r in got.collect()) == want
    assert substring_dedup.remove_repeats(empty, Scratch(spark)).count() == 0


@given(st.lists(st.sampled_from("abc"), max_size=80))
@settings(max_examples=50, deadline=None)
def test_spans_cover_every_window_once(words):
    wh = np.array([ord(w) * 2654435761 for w in words], np.uint64)
    lo, n, _, _ = substring_dedup.spans_of(wh, np.array([len(wh)]), 12)
    assert [i for a, k in zip(lo, n) for i in range(a, a + k)] == list(range(max(0, len(words) - 11)))


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = words_of((text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return collections.Counter((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def test_ngram_join(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = ngram_join.join_components(docs, Scratch(spark)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    assert ngram_join.join_components(empty, Scratch(spark)).count() == 0


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    r, base, rows = np.random.default_rng(5), body(9, 150).split(), []
    for i in range(160):
        w = list(base)
        for k in r.integers(0, len(w), int(r.integers(0, 6))):
            w[k] = f"e{i}{k}"
        rows.append((i, " ".join(w)))
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()
    roots = {r["node"]: r["root"] for r in got}
    assert len({roots[i] for i in range(41)}) == 1 and roots[100] == roots[101] == roots[102] != roots[0]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_lexicon_bpe(spark, docs, empty):
    t, want = library(), collections.Counter()
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    for size in (7, 1000):
        assert collections.Counter(map(tuple, lexicon_bpe.encode(docs, vocabulary_path(), Scratch(spark), size).collect())) == want
    assert lexicon_bpe.encode(empty, vocabulary_path(), Scratch(spark)).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_splitting_and_merging_as_the_library_does(text):
    t, v = library_once(), lexicon_bpe.vocabulary(vocabulary_path())
    ids = [i for w in lexicon_bpe.Coder(v, None).split(text) for i in ([v.special[w]] if w in v.special else v.merge(w))]
    assert ids == t.encode(text, add_special_tokens=False).ids


_LIBRARY = []


def library_once():
    if not _LIBRARY:
        _LIBRARY.append(library())
    return _LIBRARY[0]


def test_transducer(tmp_path):
    words = {w.encode(): [i] for i, w in enumerate(["a", "ab", "abc", "xbc", "tops", "stops", "stop", "é"])}
    (tmp_path / "t").write_bytes(lexicon_bpe.to_bytes(lexicon_bpe.build(words)))
    t = lexicon_bpe.Transducer(str(tmp_path / "t"))
    asked = [*words, b"", b"b", b"abcd", b"st"]
    got = t.numbers(asked)
    assert [t.ids[t.starts[n]] if n >= 0 else None for n in got] == [*(i for i, in words.values()), None, None, None, None]
    assert len(t.final) < sum(map(len, words))  # suffixes are shared


def test_packing(spark, docs, empty):
    t = library()
    rows = mixture_packing.pack(docs, vocabulary_path(), Scratch(spark), 64).toPandas()
    ids = [t.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()]
    assert rows.length.sum() == sum(map(len, ids))
    crc = collections.Counter(zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids)
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length).tolist()[:-1]]
        assert s.length.sum() == 64 or bin(s.length.sum()).count("1") == 1
    whole = rows[rows.length == rows.doc_tokens]
    assert set(whole.ids_crc32) <= set(crc)
    assert mixture_packing.pack(empty, vocabulary_path(), Scratch(spark)).count() == 0


def dealt(totals, weights, length, x):
    """What every queue holds of the first x tokens, by walking down the tree with plain numbers."""
    tree = mixture_packing.Packer(totals, length, weights).tree
    out = []
    for q in range(len(totals)):
        v = x
        for node, side in zip(tree.node[q].tolist(), tree.side[q].tolist()):
            if node >= 0:
                left = min(int(tree.left[node]), max(v * int(tree.ratio[node]) >> mixture_packing.BITS, v - int(tree.right[node])))
                v = v - left if side else left
        out.append(v)
    return out


@given(st.lists(st.integers(1, 700), min_size=1, max_size=40), st.sampled_from([None, [3.0, 1.0], [0.0, 5.0, 0.001]]), st.integers(1, 64))
@settings(max_examples=150, deadline=None)
def test_mixture(totals, few, length):
    weights = (few * len(totals))[: len(totals)] if few else None
    packer = mixture_packing.Packer(totals, length, weights)
    seen, n = collections.defaultdict(list), len(totals)
    row, start, size, window, offset = packer.pieces(np.arange(n), np.zeros(n, np.int64), np.array(totals))
    for q in range(n):  # each token lies in exactly one piece
        assert start[row == q].tolist() == [0, *np.cumsum(size[row == q]).tolist()[:-1]] and size[row == q].sum() == totals[q]
    for w, o, k in zip(window.tolist(), offset.tolist(), size.tolist()):
        seen[w].append((o, k))
    full = sum(totals) // length
    for w, parts in seen.items():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at == length if w < full else bin(at).count("1") == 1
    assert len(seen) == full + bin(sum(totals) % length).count("1")
    for w in {0, full // 2, full}:
        want = dealt(totals, weights, length, w * length)
        assert [int(size[(row == q) & (window < w)].sum()) for q in range(n)] == want and sum(want) == w * length
    # Parts of documents give the same pieces as whole queues, cut where the parts end.
    cut = np.array([t // 3 for t in totals])
    some = cut > 0
    r2, s2, n2, w2, o2 = packer.pieces(np.arange(n)[some], np.zeros(some.sum(), np.int64), cut[some])
    whole = {(q, t): (w, o + t - s) for q, s, k, w, o in zip(row.tolist(), start.tolist(), size.tolist(), window.tolist(), offset.tolist()) for t in range(s, s + k)}
    names = np.flatnonzero(some)
    assert all(whole[int(names[q]), t] == (w, o + t - s) for q, s, k, w, o in zip(r2.tolist(), s2.tolist(), n2.tolist(), w2.tolist(), o2.tolist()) for t in range(s, s + k))


def test_mixture_keeps_target_proportions_with_many_queues():
    r = np.random.default_rng(4)
    totals = r.integers(1, 3000, 5000).tolist()  # more queues than a window has tokens
    packer = mixture_packing.Packer(totals, 2048)
    depth, total, q = packer.tree.node.shape[1], sum(totals), np.arange(len(totals))
    last = np.zeros(len(totals), np.int64)
    for w in range(0, packer.windows + 1, 97):
        got = packer.upto(q, np.full(len(q), w))
        assert got.sum() == w * 2048 and (got >= last).all() and np.abs(got - np.array(totals) * (w * 2048 / total)).max() <= depth
        last = got
    targets = [5.0, 3.0, 2.0, 0.5]
    packer = mixture_packing.Packer([10_000, 40_000, 30_000, 9_000], 100, targets)
    for w in range(1, 200):  # all queues live
        got = packer.upto(np.arange(4), np.full(4, w))
        assert np.abs(got - np.array(targets) / 10.5 * w * 100).max() <= 3
    a, b = (packer.upto(np.arange(4), np.full(4, w)) for w in (300, 500))  # the first has run dry: the others keep their proportions
    assert a[0] == 10_000 and np.abs((b - a)[1:] - np.array([3.0, 2.0, 0.5]) / 5.5 * 20_000).max() <= 4


def test_packing_names_sources_and_pieces(spark, docs, monkeypatch):
    t = library()
    rows = [(i, body(i, 5 + i % 40), f"site{i % 150}") for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixture_packing.pack(many, vocabulary_path(), Scratch(spark), 64, {"site3": 2.0, "site4": 1.0, "nowhere": 9.0}).toPandas()
    ids = {i: np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for i, x, _ in rows}
    for p in got.itertuples():
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id]) and p.source == f"site{p.doc_id % 150}"
    assert got.length.sum() == sum(map(len, ids.values()))
    assert set(got[got.sequence_id < 2].source) <= {"site3", "site4"}
    first = got[got.sequence_id == 0].groupby("source").length.sum()
    assert abs(first["site3"] - 64 * 2 / 3) <= 1
    monkeypatch.setattr(mixture_packing, "MOST_QUEUES", 100)
    with pytest.raises(ValueError, match="different sources"):
        mixture_packing.pack(many, vocabulary_path(), Scratch(spark), 64)


def test_quality_trees(spark, docs, empty):
    d, labels = (spark.read.parquet(f"{SF}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_trees.score(d, quality_trees.train(d, labels)).join(labels, "doc_id").toPandas()
    held = got[got["_vw_held_out"]]
    assert len(held) > 50 and (held["_vw_predicted"] == held["quality"]).mean() > 0.95
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got["doc_id"], got["_vw_held_out"]))
    model = quality_trees.train(docs, labels.limit(0))
    assert {r["_vw_score"] for r in quality_trees.score(docs, model).collect()} == {0.5}
    assert quality_trees.score(empty, model).count() == 0


def test_html(spark):
    page = (
        '<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></ul></nav><!-- <p>no</p> -->'
        '<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A &amp; B&nbsp;title</h1><p>First <b>para</b>\n graph &lt;here&gt;.<p>Second one<br>goes on, with many words in it.</p></article>'
        '<section class="comments"><p>Nice text, thanks a lot!</p></section><footer>&copy; us</footer>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", page[: page.index("goes on") + 4] + "<"), (1, "u", page)]
    got = html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert got[0]["text"] == "A & B title\n\nFirst para graph <here>.\n\nSecond one goes on, with many words in it."
    assert got[0] == got[4] and got[1]["text"] == got[2]["text"] == "" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[3]["text"].endswith("Second one goes<") or got[3]["text"].endswith("Second one goes")


def test_html_held_out():
    model, right, total = html_blocks.trained(), 0, 0
    for page, labels in html_blocks.made_pages(150, seed=99):
        x, mask = html_blocks.padded([html_blocks.vectors(html_blocks.blocks_of(page))])
        right += int(((model.scores(x, mask)[:, 0] >= 0.5) == (np.array(labels) > 0)).sum())
        total += len(labels)
    assert right / total > 0.97


def test_pipeline(spark, empty):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "passages", "packing"]
    kept = corpus_pipeline.near_copies(spark, d, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    want = {i for i, _, c in brute_components(rows) if i == c}
    assert {r["doc_id"] for r in kept} == want and len(kept) == len(want)
    assert corpus_pipeline.run(spark, SF).count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
