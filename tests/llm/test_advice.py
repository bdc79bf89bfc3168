"""Cases that a review found: what the operators left out before."""

import collections

import numpy as np

WORDS = [f"{a}{b}x" for a in "abcdefghijklmnopqrst" for b in "uvwxyz"]


def body(seed, n):
    return " ".join(WORDS[i] for i in np.random.default_rng(seed).integers(0, len(WORDS), n))


def test_near_copies_keep_one_of_each_component_whatever_its_ids(spark):
    import corpus_pipeline

    one, two, three = body(1, 120), body(2, 120), body(3, 120)
    rows = [(None, one), (None, two), (None, one), (7, three), (7, body(4, 120)), (7, three), (None, three), (9, two + " more"), (None, body(5, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    want = [(None, one), (7, three), (7, body(4, 120)), (9, two + " more"), (None, body(5, 120))]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def brute_links(rows, shingle, percent):
    """Components as frozensets of row numbers, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    up = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and up[i] != up[j]:
                up = [up[j] if u == up[i] else u for u in up]
    return {frozenset(i for i, u in enumerate(up) if u == g) for g in set(up)}


def test_near_copies_links_from_four_fifths_of_five_word_shingles(spark):
    import corpus_pipeline

    rows = []
    for i, n in enumerate([8, 9, 10, 12, 60, 150, 300]):
        text = body(200 + i, n)
        w = text.split()
        rows += [text, text + " " + body(300 + i, max(1, round(n * 0.2))), text + " " + body(400 + i, max(1, round(n * 0.3)))]
        w[n // 2] = "changed"
        rows.append(" ".join(w))
    rows += [body(500, 8), body(500, 8) + " more"]  # four shingles of five
    rows = [(i, t) for i, t in enumerate(rows)]
    want = brute_links(rows, 5, 80)
    assert want != brute_links(rows, 4, 85)
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r["doc_id"] for r in got} == {min(g) for g in want}


def test_html_goes_on_after_stray_quotes():
    from voxweave.llm import html_blocks

    page = """<article><p class=it's>One.</p><p title="a"">Two.</p><p "x>Three.</p><a href='u'' b=">">Four.</a><p data-x=a"b id = main>Five.</p><p =">Six.</p><p title=>Seven.</p></article>"""
    got = html_blocks.blocks_of(page)
    assert [t for _, t, _ in got] == ["One.", "Two.", "Three.", "Four.", "Five.", "Six.", "Seven."]
    assert [p[-1][1] for p, t, _ in got if t in ("One.", "Five.")] == [("it", "s"), ("main",)]
    assert html_blocks.blocks_of('<p>One.</p><p title="never closed>Two.</p>')[0][1] == "One."
