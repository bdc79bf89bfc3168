"""The template tree against a plain version that compares tuples of tokens, and boilerplate of every amount."""

import collections
import itertools
import re

import numpy as np
import pytest

from voxweave.llm import line_templates
from voxweave.llm.common import Scratch

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(40)]  # no digits: those are variable fields


def body(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


def tokens(line):
    return tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0d]+", line))


def templates(t):
    """All templates that a line belongs to, as tuples with None at variable places."""
    out, free = [t], len(t) - 3
    parts = min(5, free)
    if parts >= 2:
        part = [0] * 3 + [k * parts // free + 1 for k in range(free)]
        for gone in itertools.combinations(range(1, parts + 1), 2 if parts > 3 else 1):
            out.append((gone, tuple(None if p in gone else x for x, p in zip(t, part))))
    return out


def shingles(text):
    words = [x for line in text.split("\n") for x in tokens(line)]
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def groups_of(texts):
    """Near copies, by the similarity of all pairs; no pair is so near the bound that a sketch may take it either way."""
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] & sets[j]:
            x = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert not 0.6 < x < 0.86, (x, texts[i][:200], texts[j][:200])
            if x > 0.75:
                up[root(j)] = root(i)
    return [root(i) for i in range(len(texts))]


def plain(rows, least=8):
    """Text after text without the lines of recurring templates."""
    texts = sorted({t or "" for t in rows})
    name = dict(zip(texts, groups_of(texts), strict=True))
    lines = {t: {x for line in t.split("\n") if (x := tokens(line))} for t in texts}
    times = collections.Counter(k for t in rows for x in lines[t or ""] for k in templates(x))
    common = {k for k, n in times.items() if n >= least}
    leaf = collections.Counter((len(x), x[:3]) for t in rows for x in lines[t or ""])
    common = {k for k in common if leaf[(len(k), k[:3]) if not (k and isinstance(k[0], tuple)) else (len(k[1]), k[1][:3])] >= least}
    names = collections.defaultdict(set)
    for t in texts:
        for k in {k for x in lines[t] for k in templates(x) if k in common}:
            names[k].add(name[t])
    gone = {k for k in names if len(names[k]) >= least}
    return ["\n".join(x for x in (t or "").split("\n") if not gone & set(templates(tokens(x)) if tokens(x) else ())) if t is not None else None for t in rows]


def run(spark, texts, parts=3):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, leaf int").repartition(parts)
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(docs, Scratch(spark)).collect()}
    assert all(r["leaf"] == 1 and r["_vw_lines"] == (texts[i] or "").count("\n") + 1 for i, r in got.items())
    return [got[i]["text"] for i in range(len(texts))]


def test_as_the_plain_version(spark):
    r, texts = np.random.default_rng(1), []
    site = [f"posted in the section {{}} of {body(900 + k, 4)} by {{}} and friends" for k in range(3)]  # three templates of one leaf
    for i in range(60):
        lines = [body(i * 10 + k, int(r.integers(1, 14))) for k in range(int(r.integers(0, 4)))]
        lines += [site[int(r.integers(0, 3))].format(body(5000 + i, 1), body(7000 + i, 1)), f"Page {i} of the long list"]
        if i % 2:
            lines += ["Read more", "Menu"]
        if i % 3 == 0:
            lines.insert(0, "all rights reserved by nobody at all \t")
        texts.append("\n".join(x for _, x in sorted(zip(r.random(len(lines)), lines))))
    texts += [body(77, 30) + "\n" + body(78, 20)] * 12 + ["copied line of the text\n" + body(79, 9)] * 9  # copies
    base = [body(600 + k, 25) for k in range(6)]
    for i in range(20):  # near copies
        lines = [x.split() for x in base]
        lines[i % 6][int(r.integers(0, 25))] = f"changed{WORDS[i]}"
        texts.append("\n".join(" ".join(x) for x in lines))
    texts += [None, "", "\n\n", " \t", "Menu", "Menu\n" * 30, "x" * 100_000 + "\n" + body(5, 50_000), body(5, 3)]
    want = plain(texts)
    assert run(spark, texts) == want
    assert sum(a != b for a, b in zip(texts, want)) > 50 and want[60:101] == texts[60:101]


@pytest.mark.parametrize(("shared", "own"), [(1, 1), (3, 1), (6, 2), (10, 3), (20, 8)])
def test_boilerplate_goes_whatever_part_of_a_document_it_is(spark, shared, own):
    rule = [body(1000 + k, 8) for k in range(shared)]
    texts = ["\n".join([*rule[: shared // 2], *(body(5000 + 100 * i + k, 10) for k in range(own)), *rule[shared // 2 :]]) for i in range(200)]
    texts += ["\n".join([body(9, 9), *rule])] * 900  # copies of one text with the same boilerplate
    got = run(spark, texts)
    assert not any(x in set(rule) for t in got for x in t.split("\n"))
    assert [t.split("\n") for t in got[:200]] == [[x for x in t.split("\n") if x not in set(rule)] for t in texts[:200]]


def left(texts, line):
    return sum(line(x) for t in texts for x in t.split("\n"))


def test_documents_of_recurring_lines_only(spark):
    """A log: every line is one of thirty templates, and no document has a line of its own."""
    r = np.random.default_rng(3)
    forms = [f"{body(3000 + k, 4)} at {{}} after {{}} {body(4000 + k, 3)}" for k in range(30)]
    texts = ["\n".join(forms[k].format(int(r.integers(1e6)), int(r.integers(1e6))) for k in r.choice(30, 8, False)) for _ in range(200)]
    assert set(run(spark, texts)) == {""}


@pytest.mark.parametrize(("groups", "size"), [(40, 6), (10, 60), (8, 150)])
def test_boilerplate_in_groups_of_near_copies(spark, groups, size):
    """What unrelated groups share goes, however large the groups are; what only their copies share stays."""
    texts = []
    for g in range(groups):
        base = [body(100 * g + k, 25).split() for k in range(6)]
        for i in range(size):
            lines = [list(x) for x in base]
            lines[i % 6][i % 25] = f"changed{WORDS[i % 40]}{chr(97 + i % 26)}"
            texts.append("\n".join([*map(" ".join, lines), "imprint and contact of the whole network of sites"]))
    got = run(spark, texts)
    assert [t + "\nimprint and contact of the whole network of sites" for t in got] == texts


def test_large_cluster_of_near_copies_stays(spark):
    """Up to five words changed in each: similarities with the base from 0.87 on."""
    r, base, texts = np.random.default_rng(5), [body(60 + k, 20).split() for k in range(15)], []
    for i in range(1500):
        lines = [list(x) for x in base]
        for k in range(int(r.integers(0, 6))):
            lines[int(r.integers(15))][int(r.integers(20))] = f"other{WORDS[(7 * i + k) % 40]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"
        texts.append("\n".join(map(" ".join, lines)))
    assert run(spark, texts) == texts


def test_where_the_tree_is_blind(spark):
    """A word that varies among the leading ones, or three of them in different parts: no common template."""
    texts = [f"{body(i, 11)}\nposted {body(900 + i, 1)}q{i} under the section of local news\n".replace("0", "o") for i in range(9)]
    texts = [t.translate(str.maketrans("0123456789", "abcdefghij")) for t in texts]
    assert run(spark, texts) == texts


def test_empty_table(spark):
    assert line_templates.drop_recurring(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark)).count() == 0
