"""Main text of HTML pages by gradient-boosted trees over the nodes of the document tree.

A page is parsed into block nodes (runs of text beside block children are nodes too). Each node
has features of its subtree (text, words, links, density, punctuation), its place (depth, place
among siblings and in the page), its siblings, its tag, and the tokens of its class, id and role
and of those above it. Boosted trees give the log-odds that a node is, or holds, main text. The
choice is made for the whole tree at once: a node can only stay if its parent stays, and among
all such choices the one with the largest sum of log-odds is taken, from the leaves upwards. So
no descendant of a dropped node stays, and no empty shell of a node does.

The trees are trained here, in a second or two, on pages that `training_pages` makes up: many
layouts, with telling and with meaningless attributes, whose nodes are labelled by construction.
They are then frozen and sent to the executors.

Text: character references are decoded, white space within a block becomes one space, blocks are
joined by one space in page order. Comments, head, scripts, styles and embedded objects are never
text. Markup that is cut off at the end is dropped.

Edge cases. Null or empty html: empty text. No tags at all: all of it is text. Repeated rows: one
result each. Deep nesting: no recursion. Empty input: empty result. A column named text is replaced, others are kept.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sedimark.llm.common import arrow_limits

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S,
)
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-kept)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_TOKENS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")
# Elements whose content is no text of the page, and elements without content.
_SKIPPED = frozenset("head script style noscript template svg iframe object canvas audio video select textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAGS = ["#text", "p", "h1", "h2", "li", "ul", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "blockquote", "body"]
_ALIAS = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "dl": "ul", "dt": "li", "dd": "li", "menu": "nav", "fieldset": "form", "button": "form", "label": "form", "legend": "form", "tr": "table", "td": "table", "th": "table", "thead": "table", "tbody": "table", "tfoot": "table", "caption": "table", "pre": "blockquote", "figure": "div", "figcaption": "p", "center": "div", "address": "p", "details": "div", "summary": "p", "dialog": "aside", "hgroup": "div", "html": "body"}
_BLOCK = {t: i for i, t in enumerate(_TAGS)} | {a: _TAGS.index(t) for a, t in _ALIAS.items()}
_STOPS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in _SKIPPED}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "body", "html"))
#: Tokens of class, id and role by what they say.
GROUPS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs topbar",
    "header": "header head masthead banner logo branding",
    "footer": "footer foot copyright colophon legal imprint bottom contentinfo",
    "side": "sidebar side aside widget widgets rail complementary right left secondary",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer message paywall",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner dfp adsense partner",
    "form": "form search login signin signup register subscribe subscription newsletter contact",
    "comment": "comment comments reply replies discussion disqus respond commentlist reader feedback",
    "social": "share sharing social related recommended recommendations more tags teaser popular trending",
    "content": "content article post entry story main text body page blog news prose",
}
_GROUP_OF: dict[str, int] = {}
for _i, _words in enumerate(GROUPS.values()):
    for _w in _words.split():
        _GROUP_OF[_w] = _GROUP_OF.get(_w, 0) | 1 << _i


@lru_cache(maxsize=50_000)
def _attributes(text: str) -> tuple[int, int]:
    """(groups of tokens as bits, label: 1 kept, 0 not, -1 unknown)."""
    bits, label = 0, -1
    named = 1 << len(GROUPS)  # has a class, an id or a role at all
    for name, value in _ATTRIBUTE.findall(text):
        if name == "data-kept":
            label = int("1" in value)
        else:
            bits |= named
            for t in _TOKENS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                bits |= _GROUP_OF.get(t, 0)
    return bits, label


class Page:
    """Block nodes in page order with what is their own, and the pieces of text."""

    __slots__ = ("parent", "tag", "bits", "label", "depth", "chars", "links", "words", "marks", "tags", "end", "pieces")

    def __init__(self, html: str | None):
        self.parent, self.tag, self.bits, self.label, self.depth = [-1], [len(_TAGS) - 1], [0], [1], [0]
        self.chars, self.links, self.words, self.marks, self.tags = [0], [0], [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self._parse(html or "")
        n = len(self.parent)
        size = [1] * n
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        self.end = [i + s for i, s in enumerate(size)]

    def _node(self, parent: int, tag: int, bits: int, label: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.bits.append(bits)
        self.label.append(self.label[parent] if label < 0 else label)
        self.depth.append(self.depth[parent] + 1)
        for own in (self.chars, self.links, self.words, self.marks, self.tags):
            own.append(0)
        return len(self.parent) - 1

    def _parse(self, html: str) -> None:
        if cut := _CUT_OFF.search(html, max(0, html.rfind("<"))):
            html = html[: cut.start()]
        stack: list[tuple[str, int]] = [("html", 0)]  # open block elements and their nodes
        where: dict[str, list[int]] = {"html": [0]}  # places in the stack by name
        anchors, brk, at, run = 0, True, 0, -1

        def cut_back(k: int) -> None:
            for open_name, _ in stack[k:]:
                where[open_name].pop()
            del stack[k:]

        def last(names) -> int:
            return max((where[n][-1] for n in names if where.get(n)), default=-1)

        while True:
            m = _MARK.search(html, at)
            raw = html[at : m.start()] if m else html[at:]
            if raw:
                text = unescape(raw) if "&" in raw else raw
                if brk:
                    text = " " + text
                n = len(text.split())
                if n:
                    if run < 0:
                        run = self._node(stack[-1][1], 0, 0, -1)
                    brk = False
                    c = len(text)
                    self.chars[run] += c
                    self.words[run] += n
                    self.marks[run] += len(_PUNCTUATION.findall(text))
                    if anchors:
                        self.links[run] += c
                if run >= 0:
                    self.pieces.append((run, text))
            if not m:
                return
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:  # an end tag
                if name == "a":
                    anchors = max(0, anchors - 1)
                elif name in _BLOCK:
                    brk, run = True, -1
                    if (k := last((name,))) > 0:
                        cut_back(k)
                continue
            if name in _SKIPPED:
                stop = _STOPS[name].search(html, at)
                brk = True
                # A head that isn't closed is read on: what it may hold is left out by itself.
                if not (m[3] or m[6] or "").endswith("/") and (stop or name != "head"):
                    at = stop.start() if stop else len(html)
                continue
            self.tags[run if run >= 0 else stack[-1][1]] += 1
            if name == "a":
                anchors += 1
            elif name == "br" or name == "hr":
                brk = True
            elif name in _BLOCK:
                brk, run, anchors = True, -1, 0
                if name in ("html", "body"):
                    self.bits[0] |= _attributes(m[3] or m[6] or "")[0]
                    continue
                closes = _CLOSES.get(name)
                if closes:
                    if (k := last(closes)) > max(0, last(_SCOPE)):
                        cut_back(k)
                elif stack[-1][0] == "p":
                    cut_back(len(stack) - 1)
                bits, label = _attributes(m[3] or m[6] or "")
                where.setdefault(name, []).append(len(stack))
                stack.append((name, self._node(stack[-1][1], _BLOCK[name], bits, label)))


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by node, parents, first node of each page) over all pages' nodes."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    page = np.repeat(np.arange(len(pages)), sizes)
    col = lambda name: np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])
    parent, end = col("parent"), col("end") + base[page]
    root = parent < 0
    parent = np.where(root, np.arange(len(parent)), parent + base[page])
    n = len(parent)
    own = {k: col(k) for k in ("chars", "links", "words", "marks", "tags")}
    upto = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in own.items()}
    here = np.arange(n)
    sub = {k: v[end] - v[here] for k, v in upto.items()}
    tag, bits, depth = col("tag"), col("bits"), col("depth")
    over = np.zeros(n, np.int64)
    kinds = np.zeros(n, np.int64)  # tags above, as bits
    for d in range(1, int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == d)
        over[at] = over[parent[at]] | bits[parent[at]]
        kinds[at] = kinds[parent[at]] | (1 << tag[parent[at]])
    total = {k: v[base[page]] for k, v in sub.items()}
    log = lambda x: np.log1p(np.maximum(x, 0))
    rate = lambda a, b: a / np.maximum(b, 1)
    child = ~root
    by_parent = lambda v: np.bincount(parent[child], v[child], minlength=n)
    children = by_parent(np.ones(n))
    siblings = children[parent]
    order = np.lexsort((here, parent, ~child))
    rank = np.zeros(n)
    srt = parent[order]
    first = np.concatenate([[True], srt[1:] != srt[:-1]]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    # The neighbours on either side, where they have the same parent.
    before, after = np.zeros(n), np.zeros(n)
    same = srt[1:] == srt[:-1]
    before[order[1:][same]] = sub["chars"][order[:-1][same]]
    after[order[:-1][same]] = sub["chars"][order[1:][same]]
    density = rate(sub["links"], sub["chars"])
    mean_density = rate(by_parent(density)[parent], siblings)
    mean_chars = rate(by_parent(sub["chars"].astype(float))[parent], siblings)
    kin = parent * len(_TAGS) + tag
    _, inverse, count = np.unique(kin, return_inverse=True, return_counts=True)
    start_chars = upto["chars"][here] - upto["chars"][base[page]]
    leaves = np.concatenate([[0], np.cumsum(own["chars"] > 0)])
    texts = leaves[end] - leaves[here]
    plain = [
        depth, log(sub["chars"]), log(sub["words"]), density, rate(sub["chars"], sub["tags"] + 1),
        rate(sub["marks"] * 100, sub["chars"]), log(children), log(end - here), log(texts),
        rate(sub["words"], texts), rank, siblings - rank, rate(rank, siblings), siblings,
        rate(start_chars, total["chars"]), rate(start_chars + sub["chars"], total["chars"]),
        rate(sub["chars"], total["chars"]), log(before), log(after), mean_density, log(mean_chars),
        rate(count[inverse], siblings), log(own["chars"]), log(sub["chars"][parent]), density[parent],
        rate(sub["chars"], sub["chars"][parent]), tag[parent], log(total["chars"]),
    ]
    flags = [(v >> i) & 1 for v in (bits, over, bits[parent]) for i in range(len(GROUPS) + 1)]
    tags = [tag == i for i in range(len(_TAGS))] + [(kinds >> i) & 1 for i in range(len(_TAGS))]
    return np.stack([np.asarray(x, np.float32) for x in plain + flags + tags], 1), parent, base


class Boosted:
    """Gradient-boosted trees for log-odds, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 5, rate: float = 0.25, bins: int = 32):
        quantiles = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0)
        self.cuts = [np.unique(quantiles[:, f]).astype(np.float32) for f in range(x.shape[1])]
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        self.depth, self.trees = depth, []
        b = self.binned(x).astype(np.int64)
        n, width = b.shape
        score = np.full(n, self.bias)
        shifted = b + np.arange(width) * bins
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            splits = []
            for level in range(depth):
                k = 1 << level
                cell = (at[:, None] * (width * bins) + shifted).ravel()
                size = k * width * bins
                gs = np.bincount(cell, np.repeat(g, width), minlength=size).reshape(k, width, bins)
                hs = np.bincount(cell, np.repeat(h, width), minlength=size).reshape(k, width, bins)
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)
                gain[(hl < 1) | (ht - hl < 1)] = -1
                best = gain.reshape(k, -1).argmax(1)
                f, cut = best // bins, best % bins
                splits.append((f, cut))
                at = at * 2 + (b[np.arange(n), f[at]] > cut[at])
            gs = np.bincount(at, g, minlength=1 << depth)
            hs = np.bincount(at, h, minlength=1 << depth)
            leaf = rate * gs / (hs + 1)
            score += leaf[at]
            self.trees.append((splits, leaf))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = np.ascontiguousarray(self.binned(x).T)
        score = np.full(len(x), self.bias)
        here = np.arange(len(x))
        for splits, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for f, cut in splits:
                at = at * 2 + (b[f[at], here] > cut[at])
            score += leaf[at]
        return score


def decide(log_odds: np.ndarray, parent: np.ndarray, pages: list[Page]) -> np.ndarray:
    """The set of kept nodes with the largest sum of log-odds in which each node's parent is
    kept. Roots stay."""
    gain = log_odds.tolist()
    up = parent.tolist()
    for i in range(len(gain) - 1, -1, -1):
        if gain[i] > 0 and up[i] != i:
            gain[up[i]] += gain[i]
    kept = [False] * len(gain)
    for i, p in enumerate(up):
        kept[i] = p == i or (kept[p] and gain[i] > 0)
    return np.array(kept)


def extract(htmls: list[str | None], model: Boosted) -> list[str]:
    pages = [Page(h) for h in htmls]
    if not pages:
        return []
    x, parent, base = features(pages)
    kept = decide(model.log_odds(x), parent, pages).tolist()
    out = []
    for page, first in zip(pages, base.tolist()):
        plain = len(page.parent) <= 2  # no block at all: plain text
        text, last = [], -1
        for node, piece in page.pieces:
            if plain or kept[first + node]:
                if node != last:
                    text.append(" ")
                    last = node
                text.append(piece)
        out.append(" ".join("".join(text).split()))
    return out


def _words(rng: random.Random, lo: int, hi: int) -> str:
    n = rng.randint(lo, hi)
    made = []
    for i in range(n):
        w = "".join(rng.choice("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()) for _ in range(rng.randint(1, 4)))
        made.append(w + (rng.choice([".", ".", ",", "!", "?", "***", "%%%"]) if rng.random() < 0.12 else ""))
    return " ".join(made).capitalize()


def training_pages(n: int, seed: int = 7) -> list[str]:
    """Made-up pages; data-kept labels a node and what is below it."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p

    telling = False  # whether attributes have to say what a node is

    def attrs(names: str, kept: int | None) -> str:
        label = "" if kept is None else f' data-kept="{kept}"'
        if telling:
            return f'{label} class="{pick(names.split())}"'
        if chance(0.25):
            return f'{label} class="{pick(["box", "row", "c1", "x-unit", "wrap", "col", "inner"])}"'
        if chance(0.12):
            return label
        name = pick(names.split())
        if chance(0.3):
            name = pick([f"{name}-wrap", f"site-{name}", f"{name}_1", f"box {name}"])
        return f'{label} {pick(["class", "class", "id"])}="{name}"'

    def links(lo, hi):
        return [f'<a href="/{_words(rng, 1, 1)}">{_words(rng, 1, 4)}</a>' for _ in range(rng.randint(lo, hi))]

    def listed(items):
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"

    def boiler(kind: str) -> str:
        if kind == "menu":
            tag = pick(["nav", "nav", "div", "ul"])
            inner = listed(links(3, 12)) if chance(0.7) else " | ".join(links(3, 10))
            if tag == "ul":
                return f"<ul{attrs('menu nav navigation navbar', 0)}>" + "".join(f"<li>{x}</li>" for x in links(3, 9)) + "</ul>"
            return f"<{tag}{attrs('menu nav navigation breadcrumb navbar', 0)}>{inner}</{tag}>"
        if kind == "header":
            tag = pick(["header", "header", "div"])
            extra = boiler("menu") if chance(0.5) else pick([f"<h1>{_words(rng, 1, 3)}</h1>", f"<p>{_words(rng, 2, 8)}</p>", f"<div>{_words(rng, 1, 5)}</div>"])
            return f"<{tag}{attrs('header masthead banner branding logo', 0)}>{_words(rng, 1, 4)}{extra}</{tag}>"
        if kind == "footer":
            tag = pick(["footer", "footer", "div"])
            return f"<{tag}{attrs('footer foot copyright bottom legal', 0)}>" + pick([f"&copy; {_words(rng, 1, 3)} &middot; {_words(rng, 3, 25)}", f"<p>&copy; 2020 {_words(rng, 2, 12)}</p>", listed(links(2, 8)) + f"<p>{_words(rng, 2, 20)}</p>"]) + f"</{tag}>"
        if kind == "advert":
            tag = pick(["div", "div", "aside", "section", "p"])
            inner = pick([_words(rng, 2, 30), f"<a href='#'>{_words(rng, 2, 12)}</a>", _words(rng, 4, 40)])
            if tag != "p" and chance(0.4):
                inner = f"<p>{inner}</p>"
            return f"<{tag}{attrs('ad ads advert advertisement sponsored promo ad-slot ad-box', 0)}>{inner}</{tag}>"
        if kind == "side":
            tag = pick(["aside", "aside", "div"])
            return f"<{tag}{attrs('sidebar side widget rail right', 0)}>" + "".join(pick([f"<h3>{_words(rng, 1, 4)}</h3>", listed(links(2, 8)), f"<p>{_words(rng, 3, 40)}</p>", f"<div>{_words(rng, 3, 25)}</div>"]) for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if kind == "notice":
            tag = pick(["div", "div", "section", "dialog", "aside"])
            return f"<{tag}{attrs('cookie cookie-notice consent notice alert gdpr popup', 0)}>" + pick(["", "<p>"]) + _words(rng, 5, 50) + pick(["", f" <a href='#'>{_words(rng, 1, 2)}</a>", f"<button>{_words(rng, 1, 2)}</button>"]) + f"</{tag}>"
        if kind == "form":
            return f"<form{attrs('search login newsletter subscribe signup contact', 0)}>" + pick([f"<label>{_words(rng, 1, 4)}</label><input type='text'>", f"<p>{_words(rng, 3, 25)}</p><input>", ""]) + f"<button>{_words(rng, 1, 2)}</button></form>"
        if kind == "social":
            tag = pick(["div", "section", "ul", "aside"])
            inner = pick([listed(links(2, 8)), " ".join(links(2, 6)), f"<h3>{_words(rng, 1, 3)}</h3>{listed(links(2, 8))}"]) if tag != "ul" else "".join(f"<li>{x}</li>" for x in links(2, 6))
            return f"<{tag}{attrs('share social related recommended tags more', 0)}>{inner}</{tag}>"
        tag = pick(["section", "div", "div", "ol"])
        one = pick(["article", "div", "li"]) if tag != "ol" else "li"
        said = "".join(
            f"<{one}{attrs('comment reply comment-body', None)}>" + pick(["", f"<b>{_words(rng, 1, 2)}</b> ", f"<h4>{_words(rng, 1, 3)}</h4>"]) + pick([_words(rng, 3, 80), f"<p>{_words(rng, 3, 80)}</p>", f"<p>{_words(rng, 3, 40)}</p><p>{_words(rng, 3, 40)}</p>"]) + f"</{one}>"
            for _ in range(rng.randint(1, 8))
        )
        return f"<{tag} data-kept=\"0\" {pick(['class', 'id'])}=\"{pick('comments comments comment-list discussion respond commentlist reader-comments replies'.split())}\">" + (f"<h3>{_words(rng, 1, 3)}</h3>" if tag != "ol" and chance(0.5) else "") + said + f"</{tag}>"

    def paragraph() -> str:
        lo, hi = pick([(1, 4), (3, 20), (20, 60), (40, 140)])
        text = _words(rng, lo, hi)
        if chance(0.15):
            text = f"{_words(rng, 2, 10)} {pick(links(1, 1))} {text}"
        if chance(0.15):
            text = f"<b>{_words(rng, 2, 12)}</b> {text}"
        if chance(0.1):
            text += f"<br>{_words(rng, 2, 20)}"
        return pick(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}"]).format(text)

    def article() -> str:
        parts = [f"<h1>{_words(rng, 2, 14)}</h1>"] if chance(0.8) else []
        style = pick(["p", "p", "p", "p", "div", "mixed"])
        for _ in range(pick([1, 2, 3, 5, 9, 16, 30])):
            if style == "div":
                parts.append(f"<div>{_words(rng, 3, 90)}</div>")
            else:
                parts.append(paragraph())
            if style == "mixed" and chance(0.5):
                parts.append(pick([f"<h2>{_words(rng, 1, 8)}</h2>", listed([_words(rng, 1, 15) for _ in range(rng.randint(1, 7))]), f"<blockquote>{_words(rng, 5, 50)}</blockquote>", f"<table><tr><td>{_words(rng, 1, 4)}</td><td>{_words(rng, 1, 6)}</td></tr></table>", f"<figure><img src='x'><figcaption>{_words(rng, 2, 15)}</figcaption></figure>", f"<section><h3>{_words(rng, 1, 6)}</h3>{paragraph()}</section>"]))
        # What stands inside an article without being part of it can only be known by its name.
        nonlocal telling
        telling = True
        if chance(0.3):
            parts.insert(rng.randint(0, len(parts)), boiler("advert"))
        if chance(0.2):
            parts.append(boiler(pick(["social", "comment", "form", "notice"])))
        telling = False
        return "".join(parts)

    pages = []
    for _ in range(n):
        tag = pick(["article", "article", "article", "main", "div", "section"])
        main = f"<{tag}{attrs('content article post entry story main-content article-body', 1) if tag == 'div' or chance(0.4) else ' data-kept=' + chr(34) + '1' + chr(34)}>{article()}</{tag}>"
        for _ in range(pick([0, 0, 0, 1, 2])):
            main = f"<{pick(['div', 'main', 'section'])}{attrs('container content page wrapper main layout', 1)}>" + (boiler(pick(["menu", "advert", "notice", "side"])) if chance(0.3) else "") + main + (boiler(pick(["side", "comment", "social", "comment"])) if chance(0.5) else "") + "</div>"
            main = re.sub(r"^<(main|section)(.*)</div>\Z", r"<\1\2</\1>", main, flags=re.S)
        top = [boiler(k) for k in ("notice", "header", "menu", "advert", "form") if chance(0.5)]
        end = [boiler(k) for k in ("social", "comment", "side", "form", "advert", "notice") if chance(0.3)]
        if chance(0.85):
            end.append(boiler("footer"))
        rng.shuffle(top)
        pages.append("<html><head><title>x</title></head><body>" + "".join(top) + main + "".join(end) + "</body></html>")
    return pages


@lru_cache(maxsize=1)
def trained(n: int = 450) -> Boosted:
    pages = [Page(h) for h in training_pages(n)]
    x, _, _ = features(pages)
    y = np.concatenate([np.array(p.label) for p in pages]).astype(float)
    return Boosted(x, y)


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """All columns of pages but html, and text (in place of one that pages has)."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model or trained())
    others = [c for c in pages.columns if c not in ("html", "text")]

    def run(batches):
        trees = shared.value
        for batch in batches:
            texts = []
            for i in range(0, batch.num_rows, 200):
                texts += extract(batch.column("html").slice(i, 200).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, "text"]
            )

    arrow_limits(spark)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others)
    return pages.mapInArrow(run, f"{kinds}, text string")
