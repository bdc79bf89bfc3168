"""Words of a lower-casing BPE vocabulary with word ends: normalising and splitting as its tokenizer file declares.

Fixed values: the split pattern, the order NFC, white space, lower case, and the end-of-word mark are the file's own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

END = "</w>"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000").union(map(chr, range(0x2000, 0x200B)))
# Letters and numbers of Unicode 16 that version 15.1 hasn't, and their lower case.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {0x10D50 + i: 0x10D70 + i for i in range(22)}


class Kinds(dict):
    """Character -> a letter that stands for its kind; those of contractions stand for themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cn":
            kind = next((k for k, r in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)) if any(a <= code <= b for a, b in r)), kind)
        self[code] = x = c if c in "'strevmld" else " " if c in WHITE else "L" if kind[0] == "L" else "0" if kind[0] == "N" else "!"
        return x


KINDS = Kinds()
SPLIT = re.compile(rf"{CONTRACTIONS}|[Lstrevmld]+|0|['!]+")


def _ranges(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == kind)


#: The same split for texts whose characters are all below 256: NFC leaves those alone.
SPLIT_LATIN = re.compile(rf"{CONTRACTIONS}|[{_ranges('L')}]+|[{_ranges('N')}]|[^\t-\r \x85\xa0{_ranges('L')}{_ranges('N')}]+")

#: Characters below 256: their lower case, and kinds as SPLIT_LATIN tells them apart.
LATIN_LOWER = "".join(chr(i).lower() for i in range(256)).encode("latin-1")
SPACE, LETTER, NUMBER, OTHER = range(4)
WHITE_LATIN = re.compile(r"[\t-\r \x85\xa0]")
_KIND = np.array([SPACE if chr(i) in WHITE else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(256)], np.uint8)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next unused one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


LETTERS = byte_letters()
TO_LETTERS = dict(enumerate(LETTERS))


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def split_words(text: str) -> list[str]:
    """The words of a text that holds no special token."""
    if is_latin(text):
        return SPLIT_LATIN.findall(text.lower())
    # Lower-casing goes character by character: no final form of sigma.
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().translate(NEW_LOWER)
    return [text[m.start() : m.end()] for m in SPLIT.finditer(text.translate(KINDS))]


def latin_words(raw: bytes) -> tuple[np.ndarray, pa.Array]:
    """split_words of a text in Latin-1: where each word starts, and the words, lower-cased, in Latin-1 too.

    Words end where the kind changes and around each number. An apostrophe that no other sign stands before takes the
    letters of a contraction along, and what is left of the letters is the next word.
    """
    raw = np.frombuffer(raw.translate(LATIN_LOWER) + b"   ", np.uint8)
    kind = _KIND[raw]
    edge = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))
    at = np.flatnonzero(edge & (raw == ord("'")))
    for tail in CONTRACTIONS.replace("'", "").split("|"):
        ok = at
        for k, c in enumerate(tail.encode(), 1):
            ok = ok[raw[ok + k] == c]
        edge[ok + 1] = False
        edge[ok + len(tail) + 1] = True
    edge = np.flatnonzero(edge)  # the last one is that of the white space at the end
    word = np.flatnonzero(kind[edge] != SPACE)
    offsets = np.append(0, np.cumsum(edge[word + 1] - edge[word]))
    return edge[word], pa.Array.from_buffers(pa.large_binary(), len(word), [None, pa.py_buffer(offsets), pa.py_buffer(raw[kind != SPACE])])


def latin_cuts(text: str, most: int) -> Iterator[str]:
    """A text in Latin-1, cut at white space into pieces that have `most` characters and what is left of a word."""
    at = 0
    while m := WHITE_LATIN.search(text, at + most):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def letters(word: str) -> str:
    """A word's bytes as printable letters."""
    return word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(TO_LETTERS)
