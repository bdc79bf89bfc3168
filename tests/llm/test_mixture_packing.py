"""Ids of whole slices of texts, against the tokenizers library and the split pattern."""

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from voxweave.llm import mixture_packing, pieces
from voxweave.llm.queries import vocabulary_path

LATIN = st.text(alphabet=st.one_of(st.sampled_from("'smtdrevlSLVE a5\n-"), st.characters(max_codepoint=255)), max_size=40)


def library(t, texts):
    return [np.array(t.tokenizer.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts]


class Counted(dict):
    """Counts how often a word is looked up."""

    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)

    def __getitem__(self, k):
        self.asked += 1
        return super().__getitem__(k)


def test_each_different_word_is_looked_up_once_for_a_slice():
    t, r = mixture_packing.Tokens(vocabulary_path()), np.random.default_rng(3)
    words = [f"word{chr(97 + i)}" for i in range(20)] + ["Don't", "caf\u00e9", "7", "--"]
    texts = [" ".join(words[i] for i in r.integers(0, len(words), 500)) for _ in range(60)]
    t.memo = Counted()
    assert t.encode(texts) == library(t, texts)
    assert 0 < t.memo.asked <= 2 * len(words)  # not once for each of the 30,000 words


@given(LATIN)
@example("'s's 'septem 'r 're're ''s -'s '")
@settings(max_examples=500, deadline=None)
def test_words_of_latin_bytes_are_those_of_the_pattern(text):
    start, words = pieces.latin_words(text.encode("latin-1"))
    assert [w.decode("latin-1") for w in words.to_pylist()] == pieces.split_words(text)
    assert start.tolist() == [m.start() for m in pieces.SPLIT_LATIN.finditer(text.lower())]


@given(st.lists(st.one_of(LATIN, st.text(max_size=20), st.just("a <|endoftext|> b")), max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_of_mixed_texts(texts):
    t = mixture_packing.tokens_of(vocabulary_path())
    assert t.encode(texts) == library(t, texts)


def test_long_texts_and_a_memo_that_is_full(monkeypatch):
    monkeypatch.setattr(mixture_packing, "SLICE_BYTES", 50)
    monkeypatch.setattr(mixture_packing, "MEMO", 5)
    t = mixture_packing.Tokens(vocabulary_path())
    texts = ["It's one. " * 100, "x" * 300, "short", "", "a" * 49 + " b'll " + "c" * 60, " " * 200, "They're\u00a0at 100\u00bd\n" * 30]
    assert t.encode(texts) == library(t, texts)
