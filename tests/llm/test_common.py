"""Hashes of words taken from running sums, against words split one by one."""

import collections

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from voxweave.llm import common


def check(raw, lower=False):
    x = common.HashedWords(raw, lower)
    words = (raw.lower() if lower else raw).split()
    assert [(raw.lower() if lower else raw)[a:b] for a, b in zip(x.start.tolist(), x.end.tolist())] == words
    return dict(zip(words, x.hashes.tolist()))


@given(st.text(alphabet="aAbB \t\n\v\f\r\x1c\x85\u00a0\u3000é日.", max_size=60), st.booleans())
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_split(text, lower):
    got = check(text.encode(), lower)
    assert all(common.word_hashes([w])[0] == h for w, h in got.items())  # wherever a word stands
    assert len(set(got.values())) == len(got)


def test_pieces_and_long_words(monkeypatch):
    common._powers.cache_clear()
    monkeypatch.setattr(common, "PIECE", 64)
    monkeypatch.setattr(common, "LONG_WORD", 20)
    r = np.random.default_rng(1)
    words = ["x" * int(n) for n in r.integers(1, 40, 200)] + ["y" * 500, "Z" * 64, "q"]
    for sep in (" ", "\n\n", "  " * 40):
        got = check(sep.join(words).encode())
        assert len(set(got.values())) == len(set(words))
    common._powers.cache_clear()


def test_no_collisions_among_like_words():
    words = [f"{a}{b}{c}{d}" for a in "abAB" for b in "abcdefgh" for c in "01234567" for d in range(2000)]
    assert len(set(common.word_hashes([w.encode() for w in words]).tolist())) == len(words)
    assert max(collections.Counter((common.word_hashes([w.encode() for w in words]) & np.uint64(255)).tolist()).values()) < 2400  # 2,000 on average
