"""Main text of web pages by a recurrent labeller of blocks.

A page becomes the sequence of its leaf blocks: runs of text between
block-level tags, each with its path of tags and their class and id words.
A bidirectional LSTM in numpy reads a vector of the hashed path, the hashed
words and some measures of each block, and labels every block as main text or
not, in the context of the whole page.  Main blocks are joined by one space.

The network is trained (back-propagation through time, Adam) on pages that
``synthetic`` makes from a seed, with known labels: articles with headings,
lists, tables, quotations and code among menus, headers, footers, sidebars,
notices, adverts, forms and reader comments, in several page styles and with
unclosed tags.  No corpus rows are used.

Scripts, styles, templates, frames, drawings (svg), comments and markup hold no
text; the content of ``object``, ``noscript``, ``canvas`` and ``math`` is labelled
like any other.  A dropped element whose end tag is missing ends with its parent,
and a drawing also before the next HTML tag, as in browsers; an unclosed script or
style takes the rest of the page, as there.  White space is what ``str.split``
takes for it, after character references are decoded.

Features read whole paths (an open element holds the bins of all elements around
it), whole blocks and all of a page.

Edge cases: null or empty pages give an empty text.  Ids (null or repeated)
and URLs are passed through; an empty table gives an empty result.  Other
columns are ignored.  Pages are labelled in groups of like length, and a very long
page in steps, so it costs memory in proportion to its own text only.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import common, textnum

_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li link main menu meta nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset(("script", "style", "template", "svg", "iframe"))
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = _BLOCK - {"br", "button", "label", "link", "meta", "option", "select", "optgroup", "textarea", "html", "body", "head"}
_STOPS = frozenset(("article", "aside", "body", "div", "footer", "form", "header", "main", "nav", "section", "table", "ul", "ol", "dl"))
#: Tags that end an open drawing, as in browsers (besides the blocks).
_BREAKS = (_BLOCK - {"title", "link", "textarea"}) | frozenset("b big code em embed i img nobr s small span strike strong sub sup tt u var".split())

PATH, NAMES, WORDS, PLAIN = 64, 96, 24, 12
INPUT, HIDDEN, CHUNK = PATH + NAMES + WORDS + PLAIN, 20, 2048
_memo: dict[str, int] = {}


def _bin(word: str, of: int) -> int:
    key = f"{of}{word}"
    if (at := _memo.get(key)) is None:
        if len(_memo) > 200_000:
            _memo.clear()
        at = _memo[key] = zlib.crc32(key.encode("utf-8", "replace")) % of
    return at


class Open(NamedTuple):
    """An open element; all but its tag include what the elements around it say."""

    tag: str
    bits: int  # bins of the tags and names of the whole path
    dropped: bool
    linked: bool
    keep: bool | None


_TOP = Open("", 0, False, False, None)


class Blocks(HTMLParser):
    """Collects (text, (bits of the path, last tag), link characters, keep) for every leaf block of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = [_TOP]
        self.open: Counter[str] = Counter()
        self.found: list[tuple[str, tuple[int, str], int, bool]] = []
        self.text: list[str] = []
        self.linked, self.place = 0, None

    def flush(self) -> None:
        words = "".join(self.text).split()
        if words:
            place = self.place or _TOP
            self.found.append((" ".join(words), (place.bits, place.tag), self.linked, bool(place.keep)))
        self.text, self.linked, self.place = [], 0, None

    def _pop(self, names: tuple[str, ...], stops: frozenset) -> None:
        if not any(map(self.open.__getitem__, names)):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in names:
                self.open.subtract(x.tag for x in self.stack[i:])
                del self.stack[i:]
                return
            if self.stack[i].tag in stops:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open["svg"] and tag in _BREAKS:
            self._pop(("svg",), frozenset())
        if tag in _BLOCK and not self.stack[-1].dropped:
            self.flush()
        if tag in _VOID:
            return
        if tag in _CLOSES:
            self._pop(_CLOSES[tag], _STOPS)
        elif tag in _ENDS_P:
            self._pop(("p",), _STOPS)
        around = self.stack[-1]
        bits, keep = around.bits | 1 << _bin(tag, PATH), around.keep
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                for name in re.findall(r"[a-z]+", v.lower()):
                    bits |= 1 << (PATH + _bin(name, NAMES))
            elif k == "data-keep":
                keep = v == "1"
        self.stack.append(Open(tag, bits, around.dropped or tag in _DROP, around.linked or tag == "a", keep))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _DROP:
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK and not self.stack[-1].dropped:
            self.flush()
        self._pop((tag,), frozenset() if tag in _STOPS or tag in _DROP else _STOPS)

    def handle_data(self, data: str) -> None:
        own = self.stack[-1]
        if own.dropped:
            return
        if self.place is None and not data.isspace():
            self.place = own
        if own.linked:
            self.linked += len(data.strip())
        self.text.append(data)


def blocks(page: str) -> list[tuple[str, tuple[int, str], int, bool]]:
    parser = Blocks()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.found


_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,:;!?()", b"abcdefghijklmnopqrstuvwxyz        ")
_BYTES = np.zeros((2, 256), np.int64)  # stops, digits
_BYTES[0, list(b".,;")] = 1
_BYTES[1, 48:58] = 1


def vectors(found: list[tuple[str, tuple[int, str], int, bool]], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row of features for each block: its whole path, all its words and measures of its whole text.

    first, total: the place of these blocks among all of the page.
    """
    n, total = len(found), total or len(found)
    out = np.zeros((n, INPUT), np.float32)
    seen: dict[tuple[int, str], np.ndarray] = {}
    for i, (_, path, _, _) in enumerate(found):
        if (own := seen.get(path)) is None:
            own = np.unpackbits(np.frombuffer(path[0].to_bytes((PATH + NAMES) // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
            if path[1]:
                own[_bin("last " + path[1], PATH)] = 1
            seen[path] = own
        out[i, : PATH + NAMES] = own
    data = "\n".join(f[0] for f in found).encode("utf-8", "replace")
    buf = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero(buf == 10), len(buf))
    starts = np.append(0, ends[:-1] + 1)
    at, _, h = textnum.words(data.translate(_FOLD))
    own = np.searchsorted(starts, at, "right") - 1
    words = np.bincount(own * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[:, PATH + NAMES : -PLAIN] = 0.3 * words / np.sqrt(np.maximum(1, words.sum(1, keepdims=True)))
    size = np.maximum(1, ends - starts)
    stops, digits = ((sums := np.append(0, np.cumsum(kind[buf])))[ends] - sums[starts] for kind in _BYTES)
    chars = np.array([len(f[0]) for f in found])
    linked = np.array([f[2] for f in found])
    out[:, -PLAIN:] = np.minimum(1, np.stack((
        chars / 20, chars / 80, chars / 300, chars / 1500, linked / np.maximum(1, chars), 20 * stops / size, [f[0][-1] in ".!?:;\"" for f in found], (first + np.arange(n)) / total,
        np.full(n, total / 40), ["\u00a9" in f[0] or "@" in f[0] for f in found], 3 * digits / size, chars < 12,
    ), axis=1))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, w: dict, side: str, keep: bool = False, state: tuple | None = None):
    """States of one direction over x (pages, blocks, input), what a gradient needs if asked to keep it, and the last state."""
    n, t, _ = x.shape
    pre = x @ w[side + "x"] + w[side + "b"]
    h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
    states, kept = np.empty((n, t, HIDDEN), np.float32), []
    u = w[side + "h"]
    for k in range(t):
        z = pre[:, k] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        old_h, old_c = h, c
        c = f * c + i * g
        th = np.tanh(c)
        h = o * th
        states[:, k] = h
        if keep:
            kept.append((i, f, o, g, old_h, old_c, th))
    return states, kept, (h, c)


def _backward(x: np.ndarray, kept: list, grad: np.ndarray, w: dict, side: str) -> dict:
    n, t, _ = x.shape
    dz_all = np.empty((n, t, 4 * HIDDEN), np.float32)
    du, dh, dc = np.zeros_like(w[side + "h"]), np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        i, f, o, g, old_h, old_c, th = kept[k]
        dh = dh + grad[:, k]
        dc = dc + dh * o * (1 - th * th)
        dz = np.concatenate((dc * g * i * (1 - i), dc * old_c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        dz_all[:, k] = dz
        du += old_h.T @ dz
        dh, dc = dz @ w[side + "h"].T, dc * f
    return {side + "x": np.tensordot(x, dz_all, ((0, 1), (0, 1))), side + "h": du, side + "b": dz_all.sum((0, 1))}


def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse; padding stays behind."""
    k = np.arange(x.shape[1])[None, :]
    at = np.where(k < sizes[:, None], sizes[:, None] - 1 - k, k)
    return np.take_along_axis(x, at[:, :, None], axis=1)


class Labeller:
    """Weights of both directions and the output."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def logits(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(p) for p in pages])
        x = np.zeros((len(pages), int(sizes.max()), INPUT), np.float32)
        for i, p in enumerate(pages):
            x[i, : len(p)] = p
        w = self.weights
        states = np.concatenate((_forward(x, w, "f")[0], _turned(_forward(_turned(x, sizes), w, "b")[0], sizes)), axis=2)
        z = states @ w["out"] + w["bias"]
        return [z[i, :n] for i, n in enumerate(sizes)]

    def long_logits(self, found: list) -> np.ndarray:
        """The same for one page of any length; features and states are made for CHUNK blocks at a time."""
        w, n = self.weights, len(found)
        z = np.full(n, float(w["bias"]), np.float32)
        cuts = range(0, n, CHUNK)
        for side, order, step, out in (("f", cuts, 1, w["out"][:HIDDEN]), ("b", reversed(cuts), -1, w["out"][HIDDEN:])):
            state = None
            for a in order:
                x = vectors(found[a : a + CHUNK], a, n)[None, ::step]
                states, _, state = _forward(x, w, side, state=state)
                z[a : a + CHUNK] += (states[0] @ out)[::step]
        return z

    def texts(self, pages: list[str]) -> list[str]:
        """Main text of each page."""
        found = [blocks(p) for p in pages]
        out = [""] * len(pages)
        order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
        while order and len(found[order[-1]]) > CHUNK:
            i = order.pop()
            out[i] = " ".join(f[0] for f, keep in zip(found[i], self.long_logits(found[i]) > 0, strict=True) if keep)
        while order:
            first, most = len(found[order[0]]), 0
            while most < len(order) and most < 512 and len(found[order[most]]) <= 1.3 * first + 4 and (most == 0 or len(found[order[most]]) * (most + 1) <= 40_000):
                most += 1
            own, order = order[:most], order[most:]
            for i, z in zip(own, self.logits([vectors(found[i]) for i in own]), strict=True):
                out[i] = " ".join(f[0] for f, keep in zip(found[i], z > 0, strict=True) if keep)
        return out


def fit(pages: list[str], epochs: int = 18, size: int = 32, seed: int = 5) -> Labeller:
    """Trains on pages whose labels stand in ``data-keep`` attributes, which are no features."""
    rng = np.random.default_rng(seed)
    rows = [(vectors(f), np.array([b[3] for b in f], np.float32)) for f in map(blocks, pages) if f]
    rows.sort(key=lambda r: len(r[1]))
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    w = {"out": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "bias": np.zeros((), np.float32)}
    for side in "fb":
        w[side + "x"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN)).astype(np.float32)
        w[side + "h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[side + "b"] = np.zeros(4 * HIDDEN, np.float32)
        w[side + "b"][HIDDEN : 2 * HIDDEN] = 1
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            own = batches[b]
            sizes = np.array([len(y) for _, y in own])
            x, y = np.zeros((len(own), sizes.max(), INPUT), np.float32), np.zeros((len(own), sizes.max()), np.float32)
            for i, (a, t) in enumerate(own):
                x[i, : len(t)], y[i, : len(t)] = a, t
            # words of blocks are mostly noise: hide some features at random
            x *= (rng.random(x.shape) > 0.1).astype(np.float32)
            real = np.arange(x.shape[1])[None] < sizes[:, None]
            turned = _turned(x, sizes)
            hf, kf, _ = _forward(x, w, "f", keep=True)
            hb, kb, _ = _forward(turned, w, "b", keep=True)
            states = np.concatenate((hf, _turned(hb, sizes)), axis=2)
            d = (_sigmoid(states @ w["out"] + w["bias"]) - y) * real / real.sum()
            d = d.astype(np.float32)
            back = d[:, :, None] * w["out"]
            g = {"out": np.tensordot(d, states, ((0, 1), (0, 1))), "bias": d.sum()}
            g |= _backward(x, kf, back[:, :, :HIDDEN], w, "f") | _backward(turned, kb, _turned(back[:, :, HIDDEN:], sizes), w, "b")
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                w[k] = (w[k] - 0.008 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Labeller(w)


#: Class and id words of page furniture and of main text (fixed values).
FURNITURE = {
    "nav": ("nav", "menu", "navbar", "navigation", "topnav", "breadcrumbs", "breadcrumb", "toc", "pagination", "links"), "header": ("header", "masthead", "banner", "site-header", "top", "logo", "tagline"),
    "footer": ("footer", "site-footer", "colophon", "bottom", "copyright", "legal"), "aside": ("sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "rail", "side"),
    "notice": ("cookie", "notice", "consent", "alert", "popup", "modal", "gdpr", "paywall", "message", "newsletter"), "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "sponsor"),
    "form": ("form", "search", "login", "signup", "subscribe", "contact"), "comments": ("comments", "comment", "comment-list", "replies", "discussion", "responses", "disqus", "reader-comments"), "share": ("share", "social", "tags", "meta-bar", "toolbar"),
}
MAIN = ("content", "article", "post", "entry", "main", "story", "body", "text", "article-body", "entry-content", "post-content", "prose", "page")
_SAYINGS = ("© 2024 All rights reserved", "We use cookies to improve your experience. Accept", "Subscribe to our newsletter", "Log in", "Sign up", "Share this", "Read more", "Related posts", "Leave a comment", "Reply", "Advertisement", "Privacy policy", "Terms of use", "Contact us", "About", "Home", "Search", "Posted by", "Previous", "Next", "Skip to content")


def synthetic(n: int = 600, seed: int = 17) -> list[str]:
    """Pages with ``data-keep`` on the elements that begin or end main text."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p
    vocabulary = ["".join(pick("bcdfghklmnprstvwzéöü") + pick("aeiou") for _ in range(int(rng.integers(1, 5)))) for _ in range(900)]

    def words(a: int, b: int) -> str:
        out = [pick(vocabulary) + ("," if chance(0.06) else "." if chance(0.06) else "") for _ in range(int(rng.integers(a, b)))]
        return html_lib.escape(" ".join(out).capitalize())

    def sentence() -> str:
        return words(1, 6) + "." if chance(0.15) else words(6, 90) + "." if chance(0.85) else " | ".join(words(1, 3) for _ in range(12))

    def named(tag: str, names: tuple, inside: str, keep: str = "") -> str:
        how = f' {pick(["class", "id"])}="{pick(names)}{pick(["", "", " " + pick(vocabulary), "-" + pick(vocabulary)])}"' if chance(0.8) else ""
        return f"<{tag}{how}{keep}>{inside}</{tag}>"

    def links() -> str:
        item = lambda: f'<a href="/{pick(vocabulary)}">{words(1, 4) if chance(0.8) else pick(_SAYINGS)}</a>'
        k = int(rng.integers(2, 9))
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(k)) + "</ul>" if chance(0.7) else pick([" ", " | ", "<br>"]).join(item() for _ in range(k))

    def saying() -> str:
        return pick(_SAYINGS) if chance(0.6) else words(3, 25) + "."

    def extra(kind: str) -> str:
        names = FURNITURE[kind]
        bare = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
        tag = bare[kind] if kind in bare and chance(0.6) else pick(["div", "section", "div"])
        if tag in ("div", "section"):
            one = lambda inside: f'<{tag} {pick(["class", "id"])}="{pick(names)}">{inside}</{tag}>'
        else:
            one = lambda inside: named(tag, names, inside)
        para = lambda: pick([f"<p>{saying()}</p>", f"<p>{words(8, 40)}.</p>", saying(), f"<span>{saying()}</span>"])
        if kind == "nav":
            return one(links())
        if kind == "header":
            return one(pick([f"<h1>{words(1, 5)}</h1>", f"<p>{words(2, 8)}</p>", ""]) + (links() if chance(0.5) else f"<div>{words(2, 6)}</div>"))
        if kind == "footer":
            return one(pick([f"&copy; {pick(vocabulary)}.example.com &middot; {words(3, 25)}.", links() + para(), para()]))
        if kind == "aside":
            return one(f"<{pick(['h2', 'h3', 'h4'])}>{words(1, 4)}</h3>" + pick([links(), para() + para(), f"<p>{words(10, 60)}.</p>"]))
        if kind == "form":
            return one(f"<label>{words(1, 3)}</label><input name=q><select><option>{words(1, 2)}<option>{words(1, 2)}</select><textarea>{words(1, 4)}</textarea><button>{pick(_SAYINGS)}</button>")
        if kind == "comments":
            each = lambda: named(pick(["div", "li", "article", "p"]), ("comment", "reply", "comment-body"), f"{pick(['', f'<b>{words(1, 3)}</b> ', f'<cite>{words(1, 3)}</cite>'])}<p>{words(3, 60)}.</p>")
            return one((f"<h3>{pick(['Comments', '3 comments', words(1, 3)])}</h3>" if chance(0.6) else "") + "".join(each() for _ in range(int(rng.integers(1, 6)))))
        return one(para() if chance(0.7) else para() + para())

    def article() -> str:
        parts = [f"<h1>{words(3, 14)}</h1>"] if chance(0.85) else []
        if chance(0.4):
            parts.append(f"<p><b>{words(8, 40)}.<br>")  # unclosed on purpose
        for _ in range(int(rng.integers(0, 14)) + (0 if parts else 1)):
            p = f"<p>{sentence()}" + ("</p>" if chance(0.8) else "")
            kind = int(rng.integers(16))
            parts.append(
                f"<h2>{words(1, 7)}</h2>" if kind == 0 else "<ul>" + "".join(f"<li>{words(2, 20)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>" if kind == 1 else f"<blockquote>{words(5, 40)}</blockquote>" if kind == 2
                else "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>" if kind == 3 else f"<pre>{words(3, 20)}</pre>" if kind == 4 else f'<p>{words(5, 30)} <a href="/x">{words(1, 5)}</a> {words(2, 20)}</p>' if kind == 5
                else f"<div>{sentence()}</div>" if kind == 6 else f"<p><b>{words(5, 40)}.<br>" if kind == 7 else p
            )
            if chance(0.06):
                parts.append(extra(pick(["ad", "share", "aside", "notice"])).replace(">", ' data-keep="0">', 1))
        if chance(0.12):
            parts.append(extra("comments").replace(">", ' data-keep="0">', 1))
        return "".join(parts)

    out = []
    for _ in range(n):
        kind, kinds = int(rng.integers(4)), list(FURNITURE)
        inside = article()
        main = (
            f'<article data-keep="1">{inside}</article>' if kind < 2 else f'<main data-keep="1">{inside}</main>' if kind == 2 and chance(0.5) else f'<div {pick(["class", "id"])}="{pick(MAIN)}" data-keep="1">{inside}</div>'
        )
        if chance(0.3):
            main = f"<main>{main}</main>"
        if chance(0.3):
            main = f'<div class="{pick(["container", "wrapper", "layout", "row", "page"])}">{main}{extra("aside") if chance(0.5) else ""}</div>'
        before = "".join(extra(pick(["nav", "header", "notice", "ad", "nav", "form", "ad"])) for _ in range(int(rng.integers(0, 4))))
        after = "".join(extra(pick(["comments", "aside", "footer", "form", "share", "ad", "nav", "notice"])) for _ in range(int(rng.integers(0, 3)))) + (extra("footer") if chance(0.8) else "")
        top = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{words(3, 12)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>' if chance(0.9) else ""
        out.append(f"{top}{before}{main}{after}{pick(['', '</body></html>'])}")
    return out


_labeller: Labeller | None = None


def labeller() -> Labeller:
    """The network fitted on the default synthetic pages, once a process."""
    global _labeller
    if _labeller is None:
        _labeller = fit(synthetic())
    return _labeller


def extract(pages: DataFrame, network: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars of every page."""
    common.prepare(pages.sparkSession)
    network = network or labeller()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 512):
                own = part.slice(at, 512)
                texts = network.texts(own.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), common.text_of(html_col).alias("html"))
    out = plain.mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
