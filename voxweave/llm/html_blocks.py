"""HTML extraction: a recurrent block labeller.

A page becomes the sequence of its text blocks: leaf text between block-level tags. Each block has a vector of its hashed tag
path (tags, and the words of class, id and role attributes), of all its hashed words (logarithms of counts, of length 1 together), and of lengths and link
density. A bidirectional LSTM in numpy reads the page's whole sequence, so each block is classified with the rest of the page in
view; blocks labelled as main text are joined. The network is trained on made-up pages whose labels are known (see
made_pages), always the same ones, so its weights are the same everywhere; one task trains it, once for each driver.

Tags are read as HTML does, but lose less: a quote opens a value only right after "=" and if the closing one ends the value,
anywhere else it is a character like others; "<" within a tag's name or attribute names begins no tag; scripts and styles that
are never closed end at the next block, other elements of RAW that are never closed hide nothing.

Null html counts as empty and gives an empty text; pages that end anywhere (inside a tag, comment or script too) are read as
far as they go; very long pages are whole; ties at 0.5 are main text; repeated rows give equal texts; an empty table gives
an empty result; other columns are ignored. Scripts, styles and comments are never blocks.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import HashedWords, batch_of, need, slices

#: Elements that don't break the line; every other tag ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style template noscript iframe svg math canvas object".split())
#: Where a script or style ends that is never closed.
NEXT_BLOCK = re.compile(r"<(?:/?(?:body|div|section|article|main|table|ul|ol)|p|h[1-6]|nav|aside|header|footer|form)(?=[\s/>])", re.I)
#: An opening tag of these ends an open element of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div main aside nav footer header form".split())
#: Name and value as HTML reads them: a quote opens a value only right after "=", anywhere else it is a character like others.
ATTRIBUTE = re.compile(r"([^\s/><][^\s/>=<]*+)(?>\s*+=\s*+(?>\"([^\"]*+)\"(?=[\s/>]|\Z)|'([^']*+)'(?=[\s/>]|\Z)|([^\s>][^\s>]*+))?+)?+")
_ATTRIBUTE = re.sub(r"\((?!\?)", "(?:", ATTRIBUTE.pattern)
TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?>[\s/]++|{_ATTRIBUTE})*+)(>|\Z)", re.S)
NAMES = frozenset(("class", "id", "role"))
WORDS = re.compile(r"[A-Za-z][a-z]*")

PATH, TEXT, NUMBERS, HIDDEN = 160, 256, 8, 20
INPUTS = PATH + TEXT + NUMBERS
#: Blocks of one slice of time, for pages of more blocks.
STEP = 10_000


@functools.lru_cache(1 << 16)
def _slot(key: str, size: int) -> tuple[int, float]:
    h = xxhash.xxh3_64_intdigest(key)
    return h % size, 1.0 if h >> 40 & 1 else -1.0


@functools.lru_cache(1 << 14)
def _path_vector(path: tuple) -> np.ndarray:
    """Tags and attribute words of all open elements, hashed; the innermost count once more."""
    v = np.zeros(PATH)
    for depth, (tag, attrs) in enumerate(path):
        keys = [f"t:{tag}", *(f"a:{a}" for a in attrs)]
        if depth == len(path) - 1:
            keys.append(f"last:{tag}")
        for k in keys:
            i, s = _slot(k, PATH)
            v[i] += s
    return np.clip(v, -2, 2)


@functools.lru_cache(1 << 12)
def _attributes(text: str) -> tuple[str, ...]:
    found = [x for m in ATTRIBUTE.finditer(text) if m[1].lower() in NAMES for x in WORDS.findall(m[2] or m[3] or m[4] or "")]
    return tuple(dict.fromkeys(w[:-1] if len(w) > 3 and w[-1] == "s" else w for w in map(str.lower, found)))


def blocks_of(page: str) -> list[tuple[tuple, str, float]]:
    """(path, text, share of its characters inside links) of every block with text, in page order."""
    out, stack, pieces, linked, at, end = [], [], [], 0, 0, len(page)
    closes: dict[str, re.Pattern | None] = {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append((tuple(path), text, min(1.0, linked / len(text))))
            pieces.clear()
            linked = 0

    path: list = []
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            if not pieces:
                path = list(stack)
            pieces.append(page[at:start])
            if any(t == "a" for t, _ in stack):
                linked += start - at
        if start == end:
            break
        m = TOKEN.match(page, start)
        if not m:  # a sign that begins no tag
            if page[start + 1 : start + 2] == "/" and page[start + 2 : start + 3] and not page[start + 2].isalpha():  # a bogus comment
                close = page.find(">", start)
                at = end if close < 0 else close + 1
                continue
            if not pieces:
                path = list(stack)
            pieces.append("<")
            at = start + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1]
        if not m[4]:
            break  # cut off inside a tag
        if not closing and tag in RAW and not m[3].rstrip().endswith("/"):
            if tag not in closes:  # searched for once if there is none
                closes[tag] = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I)
            close = closes[tag] and closes[tag].search(page, at)
            if close:
                flush()
                gt = page.find(">", close.start())
                at = end if gt < 0 else gt + 1
                continue
            closes[tag] = None
            if tag in ("script", "style"):
                flush()
                block = NEXT_BLOCK.search(page, at)
                at = block.start() if block else end
            continue
        if tag == "br":
            pieces and pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in SIBLINGS.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES:
                    break
        stack.append((tag, _attributes(m[3])))
    flush()
    return out


def vectors(blocks: list[tuple[tuple, str, float]], start: int = 0, stop: int | None = None) -> np.ndarray:
    """Of blocks start to stop of a page. All words of every block are hashed, a-z as A-Z; together they have length 1 in a block."""
    end, blocks = len(blocks), blocks[start:stop]
    x = np.zeros((len(blocks), INPUTS), np.float32)
    if not blocks:
        return x
    raw = [text.encode("utf-8", "replace") for _, text, _ in blocks]
    found = HashedWords(b" ".join(raw), lower=True)
    block = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), found.start, side="right")
    place = block * TEXT + (found.hashes >> np.uint64(8) & np.uint64(TEXT - 1)).astype(np.int64)
    words = np.bincount(place, np.where(found.hashes & np.uint64(1), 1.0, -1.0), len(blocks) * TEXT).reshape(-1, TEXT)
    words = np.sign(words) * np.log1p(np.abs(words))
    x[:, PATH : PATH + TEXT] = words / np.maximum(1e-9, np.sqrt((words * words).sum(1, keepdims=True)))
    count = np.bincount(block, minlength=len(blocks)).tolist()
    for i, (path, text, links) in enumerate(blocks):
        x[i, :PATH] = _path_vector(path)
        n = len(text)
        x[i, PATH + TEXT :] = (np.log1p(n) / 6, np.log1p(count[i]) / 4, links, n < 40, text[-1] in ".!?\"'", len(path) / 8, start + i == 0, start + i == end - 1)
    x[:, :PATH] = np.clip(x[:, :PATH], -1, 1)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Bidirectional LSTM and a logistic layer over both directions."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {f"{k}{d}": r.normal(0, 0.15, (n, 4 * HIDDEN)) for d in "fb" for k, n in (("w", INPUTS), ("u", HIDDEN))}
        for d in "fb":
            self.p[f"c{d}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        self.p |= {"o": r.normal(0, 0.2, 2 * HIDDEN), "z": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None, state: list | None = None) -> np.ndarray:
        """x: (time, page, input). States of padded places stay as they were. state: where the direction begins, and then where it ended."""
        w, u, c0 = self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        gates_x = x.reshape(-1, INPUTS) @ w + c0
        gates_x = gates_x.reshape(x.shape[0], x.shape[1], -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        if state:
            h, c = state
        out = np.zeros((x.shape[0], x.shape[1], HIDDEN), np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            a = gates_x[t] + h @ u
            f, i, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, f, i, o, g, tc, on))
            h, c = np.where(on, o * tc, h), np.where(on, c_new, c)
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def long_scores(self, blocks: list[tuple[tuple, str, float]], step: int = 0) -> np.ndarray:
        """Scores of one page of any length, in slices of time with carried states: of each block only HIDDEN numbers are kept."""
        step = step or STEP
        behind, out = np.zeros((len(blocks), HIDDEN), np.float32), np.zeros(len(blocks))
        cut = range(0, len(blocks), step)
        for d, order in (("b", reversed(cut)), ("f", cut)):
            state: list = []
            for at in order:
                x = vectors(blocks, at, at + step)[:, None]
                h = self._run(x, np.ones(x.shape[:2], bool), d, None, state)[:, 0]
                if d == "b":
                    behind[at : at + step] = h
                else:
                    out[at : at + step] = _sigmoid(np.concatenate([h, behind[at : at + step]], 1) @ self.p["o"] + self.p["z"])
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, None) for d in "fb"], 2)
        return _sigmoid(both @ self.p["o"] + self.p["z"])

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        outs = {d: self._run(x, mask, d, kept[d]) for d in "fb"}
        both = np.concatenate([outs["f"], outs["b"]], 2)
        s = _sigmoid(both @ self.p["o"] + self.p["z"])
        n = mask.sum()
        loss = -(np.where(y > 0, np.log(s + 1e-9), np.log(1 - s + 1e-9)) * mask).sum() / n
        ds = (s - y) * mask / n
        grads = {"o": np.einsum("tp,tph->h", ds, both), "z": np.array([ds.sum()])}
        for k, d in enumerate("fb"):
            dout = ds[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            u = self.p[f"u{d}"]
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            da_all = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
            du = np.zeros_like(u)
            for t, h, c, f, i, o, g, tc, on in reversed(kept[d]):
                dh = dh + dout[t]
                dn = np.where(on, dh, 0)
                dcn = np.where(on, dc, 0) + dn * o * (1 - tc * tc)
                da = np.concatenate([dcn * c * f * (1 - f), dcn * g * i * (1 - i), dn * tc * o * (1 - o), dcn * i * (1 - g * g)], 1)
                da_all[t] = da
                du += h.T @ da
                dh, dc = np.where(on, 0, dh) + da @ u.T, np.where(on, dcn * f, dc)
            grads[f"w{d}"], grads[f"u{d}"], grads[f"c{d}"] = x.reshape(-1, INPUTS).T @ da_all.reshape(-1, 4 * HIDDEN), du, da_all.sum((0, 1))
        return float(loss), grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), INPUTS), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


#: Words of class, id and role attributes of main and other parts, as sites commonly use them.
MAIN_NAMES = "article content post entry story main body text prose page markdown single blog news copy detail description wiki".split()
REST_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb topbar links toc pagination pager tabs skip".split(),
    "header": "header masthead banner logo brand top site".split(),
    "footer": "footer bottom copyright legal colophon imprint".split(),
    "aside": "sidebar aside widget related recommended trending popular rail secondary tags share social author promo".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner adsense dfp outbrain taboola".split(),
    "notice": "cookie notice consent gdpr alert popup modal overlay newsletter subscribe paywall banner message warning".split(),
    "comments": "comments comment discussion replies reply respond disqus thread reviews responses reader feedback".split(),
    "form": "form search login signup contact register newsletter survey poll".split(),
}


#: Words that other parts often hold, as sites commonly use them.
REST_WORDS = {
    "nav": "home about contact news products services login menu blog search sign in start kontakt inicio accueil".split(),
    "header": "welcome official site your daily source menu".split(),
    "footer": "copyright all rights reserved terms of service privacy policy contact imprint powered by sitemap legal impressum".split(),
    "aside": "related articles most popular trending recommended read more also like share follow tags latest posts by the author".split(),
    "ad": "advertisement sponsored ad buy now offer shop discount sale free shipping anzeige publicidad publicité".split(),
    "notice": "we use cookies accept consent privacy settings our newsletter subscribe sign up agree enable javascript browser".split(),
    "comments": "reply comments says likes report ago commented thanks guest posted agree with you comment nice".split(),
    "form": "email password name submit search send message login register your required fields subscribe".split(),
}
OPAQUE = "css sc jsx c x col row inner block unit grid flex el box wrap item cell mod".split()


def made_pages(n: int, seed: int = 17) -> list[tuple[str, list[int]]]:
    """Pages of random words with the label of every block: 1 for main text.

    Other parts stand out by their tags, by names, or only by words that such parts often hold; the article may have names
    that say nothing, or no element of its own.
    """
    r = np.random.default_rng(seed)
    letters = np.array(list("aaaabcdeeeefghiiijklmnooopqrstuuvwxyzäéñ"))
    pick = lambda seq: seq[int(r.integers(len(seq)))]
    pool = ["".join(letters[r.integers(0, len(letters), int(k))]) for k in r.integers(1, 12, 30_000)]
    usual: list[str] = []  # a page's frequent words
    word = lambda: usual[int(len(usual) * r.random() ** 3)] if r.random() < 0.6 else pick(pool)
    opaque = lambda: f"{pick(OPAQUE)}{pick(['-', '_', ''])}{''.join(r.choice(list('abcdef0123456789'), int(r.integers(1, 7))))}"

    def words(a: int, b: int, kind: str | None = None) -> str:
        w = [pick(REST_WORDS[kind]) if kind and r.random() < 0.6 else word() for _ in range(int(r.integers(a, b + 1)))]
        w[0] = w[0].capitalize()
        return " ".join(w) + pick(["", ".", ".", ".", "!", "?"])

    def named(tag: str, names: list[str] | None) -> str:
        if not names or r.random() < 0.12:
            return f"<{tag}>"
        value = pick(names) + pick(["", "", "", f"-{pick(names)}", f" {word()}", "-box", "-wrap", "s", f" {pick(names)}", f" {opaque()}"])
        return f'<{tag} {pick(["class", "class", "id", "class", "role"])}="{value}">'

    def rest(kind: str, labels: list[int]) -> str:
        tag = {"nav": pick(["nav", "nav", "div", "ul", "header"]), "header": pick(["header", "header", "div"]), "footer": pick(["footer", "footer", "div"]), "aside": pick(["aside", "aside", "div", "section"]), "ad": pick(["div", "div", "aside", "section"]), "notice": pick(["div", "div", "section", "aside", "p"]), "comments": pick(["div", "section", "section", "ol", "aside"]), "form": "form"}[kind]
        semantic = tag in ("nav", "footer", "aside", "form") or kind == "header" and tag == "header"
        names = REST_NAMES[kind]
        told = r.random() < 0.5  # by its words
        says = kind if told else None
        opening = named(tag, names if not semantic or r.random() < 0.5 else None)
        if not semantic and "=" not in opening:
            opening = f'<{tag} class="{pick(names)}">'
        if told and not semantic and r.random() < 0.4:
            opening = pick([f"<{tag}>", f'<{tag} class="{opaque()}">'])
        out = [opening]
        if kind == "nav":
            items = [words(1, 2, says) for _ in range(int(r.integers(2, 9)))]
            body = "".join(f'<li><a href="/{word()}">{x}</a>{pick(["</li>", "</li>", ""])}' for x in items) if r.random() < 0.8 else "".join(f'<div><a href="#">{x}</a></div>' for x in items)
            labels += [0] * len(items)
            out.append(body if tag == "ul" else f"<ul>{body}</ul>")
        elif kind == "form":
            for _ in range(int(r.integers(1, 4))):
                out.append(pick([f"<label>{words(1, 3, says)}</label><br><input><div></div>", f"<p>{words(2, 20, says)}</p>", f"<button>{words(1, 2, says)}</button>", f"<select><option>{words(1, 2, says)}</option></select>", f"<div>{words(1, 30, says)}</div>"]))
                labels.append(0)
        elif kind == "comments":
            for _ in range(int(r.integers(1, 6))):
                head = r.random() < 0.5
                labels += [0] * (1 + head)
                inner = (f"<h4>{words(1, 3, says)}</h4>" if head else "") + pick([f"<p>{words(3, 60, says)}</p>", f"<div>{words(3, 60, says)}</div>"])
                out.append(pick([f'<div class="{pick(names)}">{inner}</div>', f"<li>{inner}</li>", inner, f"<article>{inner}</article>", f'<article class="{pick(names)}">{inner}</article>']))
        else:
            bare = r.random() < 0.5
            for _ in range(1 if bare else int(r.integers(1, 4))):
                t = words(3 if says else 2, pick([6, 12, 30, 60]), says)
                t = f'<a href="/{word()}">{t}</a>' if r.random() < 0.25 else t
                out.append(t if bare else f"<{(g := pick(['p', 'p', 'div', 'h3', 'span']))}>{t}</{g}>" + ("<div></div>" if g == "span" else ""))
                labels.append(0)
        return "".join(out) + f"</{tag}>"

    def article(labels: list[int]) -> str:
        tag = pick(["article", "article", "article", "main", "div", "section", "div", ""])
        opening = named(tag, MAIN_NAMES if tag in ("div", "section") or r.random() < 0.4 else None) if tag else ""
        if tag in ("div", "section") and "=" not in opening:
            opening = f'<{tag} class="{pick(MAIN_NAMES)}">'
        if tag and r.random() < 0.25:
            opening = f'<{tag} class="{opaque()}">'
        out = [opening]
        if r.random() < 0.8:
            t = words(2, 14)
            out.append(pick([f"<h1>{t}</h1>", f"<h1>{t}</h1>", f"<header><h1>{t}</h1></header>" if tag else f"<h1>{t}</h1>", f"<h2>{t}</h2>"]))
            labels.append(1)
        inner_rest = 0.25 if r.random() < 0.4 else 0.0
        inner = f'<div class="{opaque()}">' if tag and r.random() < 0.15 else ""
        out.append(inner)
        telling = tag in ("article", "main") or "=" in opening
        bare = r.random()
        if tag and bare < 0.2:  # text right in the element, parted by line breaks only, or by other elements now and then
            for _ in range(pick([1, 1, 1, 2, 4])):
                out.append(pick(["<br><br>", "<br>"]).join(words(6, pick([12, 40, 120])) for _ in range(int(r.integers(1, 9)))))
                labels.append(1)
                out.append(pick([f"<h3>{words(1, 6)}</h3>", f"<blockquote>{words(4, 30)}</blockquote>", f"<p>{words(4, 60)}</p>"]))
                labels.append(1)
            if bare < 0.14:
                out.pop()
                labels.pop()
            return "".join(out) + ("</div>" if inner else "") + f"</{tag}>"
        linked = 0.3 if telling and r.random() < 0.2 else 0.0
        for _ in range(int(r.integers(1 if telling else 3, pick([6, 14, 14, 70, 120])))):
            t, kind = words(1 if telling else 8, pick([2, 12, 40, 120]) if telling else pick([40, 120])), r.random()
            labels.append(1)
            if r.random() < linked:
                out.append(f'<p><a href="/{word()}">{t}</a>{pick(["</p>", "</p>", ""])}')
            elif kind < 0.56:
                out.append(f"<p>{t}{pick(['</p>', '</p>', '</p>', ''])}")
            elif kind < 0.65:
                out.append(f"<p><b>{t}<br>")
            elif kind < 0.71:
                out.append(f'<p>{words(1, 5)} <a href="/{word()}">{words(1, 3)}</a> {t}</p>')
            elif kind < 0.76:
                out.append(f"<{(g := pick(['h2', 'h3', 'h4']))}>{t}</{g}>")
            elif kind < 0.8:
                out.append(f"<blockquote>{pick([t, f'<p>{t}</p>'])}</blockquote>")
            elif kind < 0.85:
                k = int(r.integers(0, 4))
                labels += [1] * k
                g = pick(["ul", "ol"])
                out.append(f"<{g}><li>{t}</li>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(k)) + f"</{g}>")
            elif kind < 0.87:
                out.append(f"<pre>{t}</pre>")
            elif kind < 0.9:
                labels.append(1)
                out.append(f"<table><tr><td>{t}</td><td>{words(1, 4)}</td></tr></table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=a.jpg><figcaption>{t}</figcaption></figure>")
            elif kind < 0.97:
                labels.append(1)
                out.append(f"<details><summary>{words(1, 8)}</summary>{pick([t, f'<p>{t}</p>'])}</details>")
            else:
                labels.append(1)
                out.append(f"<dl><dt>{words(1, 4)}</dt><dd>{t}</dd></dl>")
            if r.random() < inner_rest:
                out.append(rest(pick(["ad", "aside", "notice", "form", "nav", "comments"]), labels))
        return "".join(out) + ("</div>" if inner else "") + (f"</{tag}>" if tag else "")

    pages = []
    for _ in range(n):
        labels: list[int] = []
        out = []
        usual[:] = [pool[k] for k in r.integers(0, len(pool), int(r.integers(5, 80)))] + ["of", "and", "in", "with", "by", "our", "we", "you", "all", "more"][: int(r.integers(0, 11))]
        if r.random() < 0.9:
            labels.append(0)
            out.append(f"<html><head><meta charset=utf-8><title>{words(2, 10)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>")
        wrap = r.random() < 0.3
        out.append(f'<div class="{pick(["wrapper", "container", "layout", "page", "site", "row", "grid"])}">' if wrap else "")
        for kind, chance in (("nav", 0.8), ("header", 0.4), ("notice", 0.3), ("ad", 0.5), ("aside", 0.2), ("form", 0.15)):
            if r.random() < chance:
                out.append(rest(kind, labels))
        out.append(article(labels))
        for kind, chance in (("comments", 0.45), ("aside", 0.4), ("ad", 0.3), ("form", 0.25), ("notice", 0.2), ("nav", 0.15), ("footer", 0.8)):
            if r.random() < chance:
                out.append(rest(kind, labels))
        out.append("</div>" if wrap else "")
        pages.append(("".join(out) + pick(["</body></html>", ""]), labels))
    return pages


@functools.cache
def trained(pages: int = 2400, epochs: int = 10) -> Labeller:
    """The labeller, trained on made-up pages with Adam; deterministic."""
    model, data = Labeller(), []
    for page, labels in made_pages(pages):
        blocks = blocks_of(page)
        if len(blocks) != len(labels):
            raise AssertionError("a made page's blocks and labels differ")
        data.append((vectors(blocks), np.array(labels, np.float32)))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    r, t = np.random.default_rng(5), 0
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i, x=r.random(len(data)): (len(data[i][1]) // 8, x[i]))  # pages of like lengths together
        for at in r.permutation(range(0, len(order), 64)):
            part = [data[i] for i in order[at : at + 64]]
            x, mask = padded([p for p, _ in part])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(part):
                y[: len(labels), k] = labels
            _, g = model.step(x, mask, y)
            t += 1
            norm = np.sqrt(sum((v * v).sum() for v in g.values()))
            for k in model.p:
                gk = g[k] * min(1.0, 1.0 / norm)
                m[k] = 0.9 * m[k] + 0.1 * gk
                s[k] = 0.999 * s[k] + 0.001 * gk**2
                rate = 0.01 * (0.3 if epoch >= epochs * 2 // 3 else 1.0)
                model.p[k] = (model.p[k] - rate * ((m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8) + 1e-4 * model.p[k])).astype(np.float32)
    return model


_WEIGHTS: list[dict[str, np.ndarray]] = []


def labeller(spark: SparkSession) -> Labeller:
    """trained(), by a task of its own the first time; its weights are a fixed few hundred KB."""
    if not _WEIGHTS and trained.cache_info().currsize:
        _WEIGHTS.append(trained().p)
    if not _WEIGHTS:

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                p = trained().p
                yield pa.RecordBatch.from_arrays([pa.array(list(p)), pa.array([x.tobytes() for x in p.values()])], names=["name", "weights"])

        found = {r["name"]: r["weights"] for r in spark.range(0, 1, 1, 1).mapInArrow(run, "name string, weights binary").collect()}
        _WEIGHTS.append({k: np.frombuffer(found[k], np.float32).reshape(x.shape) for k, x in Labeller().p.items()})
    model = Labeller()
    model.p = dict(_WEIGHTS[0])
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page; pages of about the same number of blocks run through the network together."""
    blocks = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    join = lambda i, s: "\n\n".join(text for (_, text, _), v in zip(blocks[i], s, strict=False) if v >= 0.5)
    order = sorted((i for i in range(len(pages)) if blocks[i]), key=lambda i: len(blocks[i]))
    while order and len(blocks[order[-1]]) > STEP:
        i = order.pop()
        out[i] = join(i, model.long_scores(blocks[i]))
    at = 0
    while at < len(order):
        width = max(1, min(128, 20_000 // len(blocks[order[min(at + 127, len(order) - 1)]])))
        part = order[at : at + width]
        x, mask = padded([vectors(blocks[i]) for i in part])
        s = model.scores(x, mask)
        for k, i in enumerate(part):
            out[i] = join(i, s[:, k])
        at += width
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    shared = pages.sparkSession.sparkContext.broadcast(labeller(pages.sparkSession))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, htmls = b.column("page_id"), b.column("url"), [x or "" for x in b.column("html").to_pylist()]
            for i, j in slices(map(len, htmls)):
                found = main_texts(shared.value, htmls[i:j])
                yield batch_of(schema, [ids[i:j], urls[i:j], found, [len(x) for x in found]])

    return need(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
