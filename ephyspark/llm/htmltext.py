"""Main-text extraction by gradient-boosted trees over DOM nodes (operator 7).

A page is parsed into a tree of elements and texts in document order. Each node gets features of its tag, its attribute
tokens, its ancestors, the density of text and links in its subtree, its depth and its place among its siblings. Boosted
regression trees, trained here on synthetic pages of many layouts whose main text is known, give each node the log odds
of belonging to the main text or holding some of it. Decoding is hierarchical: a node can be chosen only with its
parent, and the choice with the largest sum of log odds wins, so no text is kept inside something that was dropped.

Chosen texts are cut into blocks at block elements and line breaks, character references are decoded, white space inside a
block becomes one space, and blocks are joined by one newline.

Defined results: null, empty and unparsable pages, and pages without main text, give the empty text; unclosed and stray
tags are repaired; pages are judged one by one, so repeated rows give equal texts; a long or broken page takes time in
proportion to its length and is held whole by one task; an empty table gives an empty table; other columns pass through, and a
column with the name of the new one is replaced.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .core import passes, share

# The element names of the HTML standard by their use here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("br body html caption tbody tfoot thead tr legend summary".split())
#: Elements that end an open element of the same kind, and what they don't reach beyond.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
KINDS = ["#text", "inline", "p", "heading", "list", "item", "box", "main", "nav", "header", "footer", "aside", "form", "never", "table", "root", "figure"]
_KIND = {t: k for k, names in {"p": "p pre blockquote", "list": "ul ol dl", "item": "li dt dd", "box": "div section center details", "main": "article main", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset button select option input label textarea dialog", "never": "script style noscript template iframe head title svg canvas object", "table": "table tbody thead tfoot tr td th caption", "root": "html body", "figure": "figure figcaption"}.items() for t in names.split()} | dict.fromkeys(HEADINGS, "heading")
KIND = {t: KINDS.index(k) for t, k in _KIND.items()}
INLINE, TEXT, NEVER, MAIN, P = (KINDS.index(k) for k in ("inline", "#text", "never", "main", "p"))
#: Groups of attribute tokens; a token counts where it begins with one of a group's stems.
STEMS = {
    "main": "article content post entry main story body text prose".split(),
    "nav": "nav menu breadcrumb pagination pager toc tabs skip".split(),
    "ad": "advert sponsor promo banner dfp adsense outbrain taboola".split(),
    "comment": "comment disqus reply respond discussion".split(),
    "notice": "cookie notice consent gdpr popup modal overlay alert paywall toast".split(),
    "side": "sidebar aside widget related recommend rail secondary trending".split(),
    "edge": "footer header masthead topbar colophon copyright logo branding".split(),
    "form": "form search login signup subscri newsletter".split(),
    "share": "share social follow tools meta tags author byline".split(),
}
GROUPS = list(STEMS)
EXACT = {"ad": "ad", "ads": "ad", "adv": "ad", "head": "edge", "foot": "edge", "side": "side"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"[\"'>]")
_RAW_END = {t: re.compile(f"</{t}", re.I) for t in RAW}
#: Attributes of more characters are not remembered.
LONG_ATTRIBUTES = 400
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|data-role|name)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def attribute_groups(attributes: str) -> int:
    """A bit for each group with a token among the naming attributes, and one for hidden elements."""
    return _remembered_groups(attributes) if len(attributes) <= LONG_ATTRIBUTES else _attribute_groups(attributes)


def _attribute_groups(attributes: str) -> int:
    bits = 0
    for _, value in _ATTRIBUTE.findall(attributes):
        for token in _PIECE.findall(value):
            token = token.lower()
            if token in EXACT:
                bits |= 1 << GROUPS.index(EXACT[token])
                continue
            for g, stems in STEMS.items():
                if any(token.startswith(s) for s in stems):
                    bits |= 1 << GROUPS.index(g)
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)|display:\s*none|aria-hidden\s*=\s*[\"']?true", attributes, re.I):
        bits |= 1 << len(GROUPS)
    return bits


_remembered_groups = lru_cache(maxsize=20_000)(_attribute_groups)


class Tags:
    """The tags of a page in order, found by scans that only go forward.

    A tag ends at the first `>` outside quotes, or at the first one at all where its quotes don't close. Where nothing
    more is to be found is remembered, and so are the quotes from which a scan ran into the end of the page: no later scan
    goes beyond them, so a page takes time in proportion to its length however it is broken.
    """

    def __init__(self, source: str):
        self.source, self.size = source, len(source)
        self.known: dict[str, int] = {}
        self.failed: set[int] = set()

    def next_of(self, what: str, at: int) -> int:
        """The next place of a mark, or the page's size; places asked for must not go back."""
        k = self.known.get(what, -1)
        if k < at:
            k = self.source.find(what, at)
            k = self.known[what] = self.size if k < 0 else k
        return k

    def end_of(self, at: int) -> int:
        """The place of the `>` that ends a tag whose name ends at `at`, or the page's size."""
        first = self.next_of(">", at)
        if first == self.size or min(self.next_of('"', at), self.next_of("'", at)) > first:
            return first
        i, opened = min(self.next_of('"', at), self.next_of("'", at)), []
        while True:
            if i in self.failed:
                break
            opened.append(i)
            close = self.source.find(self.source[i], i + 1)
            m = _MARK.search(self.source, close + 1) if close >= 0 else None
            if not m:
                break
            i = m.start()
            if m[0] == ">":
                return i
        self.failed.update(opened)
        return first

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """Start, end, whether it closes, name and attributes; comments and declarations have no name."""
        s, at = self.source, 0
        while (start := s.find("<", at)) >= 0:
            at = start + 1
            if s.startswith("!--", at):
                end = s.find("-->", at + 3)
                at = self.size if end < 0 else end + 3
                yield start, at, False, "", ""
            elif s.startswith(("!", "?"), at):
                if (end := self.next_of(">", at)) < self.size:
                    at = end + 1
                    yield start, at, False, "", ""
            else:
                closes = s.startswith("/", at)
                if self.next_of(">", at) == self.size or not (name := _NAME.match(s, at + closes)):
                    continue
                if (end := self.end_of(name.end())) < self.size:
                    at = end + 1
                    jump = yield start, at, closes, name[0], s[name.end() : end]
                    if jump:
                        at = jump


class Page:
    """A page's nodes in document order; a text node holds its characters and the number of its block."""

    def __init__(self, source: str):
        self.kind, self.parent, self.depth, self.bits, self.chars, self.block, self.text, self.link = [], [], [], [], [], [], [], []
        at, block = 0, 0
        self._add(KIND["html"], -1, 0, 0)
        top = [("", 0, False)]
        #: Where in `top` the open elements of each name stand, and those that are blocks.
        places: dict[str, list[int]] = {}
        blocks: list[int] = []

        def cut(k: int) -> None:
            for name, _, _ in reversed(top[k:]):
                places[name].pop()
            del top[k:]
            while blocks and blocks[-1] >= k:
                blocks.pop()

        last = lambda names: max((places[t][-1] for t in names if places.get(t)), default=0)
        n = len(source)
        tags = iter(Tags(source))
        tag_found = next(tags, None)
        while tag_found:
            jump = None
            start, end, slash, tag, attributes = tag_found
            if start > at:
                self._add_text(source[at:start], top[-1], block)
            at = end
            if tag:
                tag = tag.lower()
                if tag in BLOCKS:
                    block += 1
                if slash:
                    if places.get(tag):
                        cut(places[tag][-1])
                elif tag != "html" or len(top) > 1:
                    if tag in CLOSES_P and blocks and top[blocks[-1]][0] == "p":
                        cut(blocks[-1])
                    if tag in ENDS:
                        same, wall = ENDS[tag]
                        if (k := last(same)) > last(wall):
                            cut(k)
                    if tag not in VOID:
                        parent = top[-1][1]
                        self._add(KIND.get(tag, INLINE), parent, self.depth[parent] + 1, attribute_groups(attributes) if "=" in attributes or "hidden" in attributes else 0)
                        if tag in RAW:
                            close = _RAW_END[tag].search(source, at)
                            at = jump = source.find(">", close.start()) + 1 or n if close else n
                        elif not attributes.endswith("/"):
                            top.append((tag, len(self.kind) - 1, tag == "a" or top[-1][2]))
                            places.setdefault(tag, []).append(len(top) - 1)
                            if tag in BLOCKS:
                                blocks.append(len(top) - 1)
            try:
                tag_found = tags.send(jump)
            except StopIteration:
                break
        if at < n:
            self._add_text(source[at:], top[-1], block)

    def _add(self, kind: int, parent: int, depth: int, bits: int) -> None:
        self.kind.append(kind)
        self.parent.append(parent)
        self.depth.append(depth)
        self.bits.append(bits)
        self.chars.append(0)
        self.block.append(0)
        self.text.append(None)
        self.link.append(False)

    def _add_text(self, raw: str, inside: tuple, block: int) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        size = len(text) if not text.isspace() else 0
        if not size:
            if self.text[-1] is not None and self.block[-1] == block and not self.text[-1][-1].isspace():
                self.text[-1] += " "
            return
        self._add(TEXT, inside[1], self.depth[inside[1]] + 1, 0)
        self.chars[-1], self.block[-1], self.text[-1], self.link[-1] = size, block, text, inside[2]


def features(page: Page) -> np.ndarray:
    """One row of numbers per node."""
    kind, parent, depth, bits = (np.array(v, dtype=np.int64) for v in (page.kind, page.parent, page.depth, page.bits))
    chars, link = np.array(page.chars, dtype=np.float64), np.array(page.link)
    n = len(kind)
    ends = _subtree_ends(page.parent)
    own = (1 << (kind + 16)) | bits
    above = np.zeros(n, dtype=np.int64)
    up, own_list = above.tolist(), own.tolist()
    for i, p in enumerate(page.parent):
        if p >= 0:
            up[i] = up[p] | own_list[p]
    above = np.array(up, dtype=np.int64)
    within = lambda v: (t := np.concatenate([[0.0], np.cumsum(v)]))[ends] - t[np.arange(n)]
    dead = (above >> (16 + NEVER)) & 1
    live = chars * (1 - dead)
    size, linked, nodes = within(live), within(live * link), ends - np.arange(n)
    total = max(1.0, size[0])
    good = (kind == P).astype(np.float64)
    size_of_parent = size[np.maximum(parent, 0)]
    children = np.bincount(np.maximum(parent, 0), minlength=n)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i, p in enumerate(page.parent):
        order[i] = seen.get(p, 0)
        seen[p] = order[i] + 1
    direct = np.bincount(np.maximum(parent, 0), weights=size * good, minlength=n)
    best = int(np.argmax(direct))
    in_best = (np.arange(n) >= best) & (np.arange(n) < ends[best]) & (direct[best] > 0)
    over_best = (np.arange(n) <= best) & (ends > best) & (direct[best] > 0)
    holds_main = within((kind == MAIN) | (bits & 1 > 0)) > 0
    page_main = float((kind == MAIN).any())
    columns = [kind, depth, np.log1p(size), size / total, linked / np.maximum(size, 1), nodes / np.maximum(size, 20) * 20, np.log1p(direct), within(good), size / np.maximum(size_of_parent, 1), order / np.maximum(children[np.maximum(parent, 0)], 1), children[np.maximum(parent, 0)], np.arange(n) / n, in_best, over_best, holds_main, np.full(n, page_main), link]
    columns += [(own >> (16 + k)) & 1 for k in range(len(KINDS))]
    columns += [(above >> (16 + k)) & 1 for k in range(len(KINDS)) if k not in (TEXT,)]
    columns += [(bits >> k) & 1 for k in range(len(GROUPS) + 1)]
    columns += [(above >> k) & 1 for k in range(len(GROUPS) + 1)]
    return np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1)


def _subtree_ends(parent: list[int]) -> np.ndarray:
    """One past the last node of each node's subtree; nodes stand in document order."""
    ends = list(range(1, len(parent) + 1))
    for i in range(len(parent) - 1, 0, -1):
        p = parent[i]
        if ends[i] > ends[p]:
            ends[p] = ends[i]
    return np.array(ends, dtype=np.int64)


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The choice of nodes, each with its parent, that has the largest sum of log odds; the root is always chosen."""
    gain = odds.tolist()
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    chosen = [True] * len(gain)
    for i in range(1, len(gain)):
        chosen[i] = gain[i] > 0 and chosen[page.parent[i]]
    return np.array(chosen)


def render(page: Page, chosen: np.ndarray) -> str:
    blocks: list[list[str]] = []
    last = None
    for i in np.flatnonzero(chosen).tolist():
        if page.kind[i] == TEXT:
            if page.block[i] == last:
                blocks[-1].append(page.text[i])
            else:
                blocks.append([page.text[i]])
                last = page.block[i]
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


class Trees:
    """Gradient-boosted regression trees of fixed depth for log odds, on binned features."""

    DEPTH, ROUNDS, RATE, BINS, RIDGE = 4, 60, 0.25, 32, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        varied = [f for f in range(x.shape[1]) if b[:, f].min() < b[:, f].max()]
        odds = np.zeros(len(y))
        self.trees = []
        for _ in range(self.ROUNDS):
            p = 1 / (1 + np.exp(-odds))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            tree = []
            for level in range(self.DEPTH):
                width = 1 << level
                split_f, split_b = np.zeros(width, dtype=np.int64), np.full(width, self.BINS, dtype=np.int64)
                gain = np.full(width, 1e-6)
                for f in varied:
                    code = node * (self.BINS + 1) + b[:, f]
                    g = np.bincount(code, weights=grad, minlength=width * (self.BINS + 1)).reshape(width, -1).cumsum(axis=1)
                    h = np.bincount(code, weights=hess, minlength=width * (self.BINS + 1)).reshape(width, -1).cumsum(axis=1)
                    g_all, h_all = g[:, -1:], h[:, -1:]
                    s = g**2 / (h + self.RIDGE) + (g_all - g) ** 2 / (h_all - h + self.RIDGE) - g_all**2 / (h_all + self.RIDGE)
                    at = np.argmax(s, axis=1)
                    top = s[np.arange(width), at]
                    better = top > gain
                    gain[better], split_f[better], split_b[better] = top[better], f, at[better]
                tree.append((split_f, split_b))
                node = 2 * node + (b[np.arange(len(y)), split_f[node]] > split_b[node])
            g, h = (np.bincount(node, weights=v, minlength=1 << self.DEPTH) for v in (grad, hess))
            leaf = self.RATE * g / (h + self.RIDGE)
            odds += leaf[node]
            self.trees.append((tree, leaf))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        odds, rows = np.zeros(len(x)), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for split_f, split_b in tree:
                node = 2 * node + (b[rows, split_f[node]] > split_b[node])
            odds += leaf[node]
        return odds


def synthetic_page(r: random.Random) -> str:
    """A page of a random layout; what belongs to the main text carries U+E000 at its start."""
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randrange(a, b)))
    link = lambda: f'<a href="/{word()}">{say(1, 4)}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randrange(a, b))) + "</ul>"
    attr = lambda names: f' {r.choice(["class", "id"])}="{r.choice(names)}"'
    dull = lambda: r.choice(["", "", f' class="{word()}"', ' class="wrap"', ' class="container"', ' class="col-8"'])
    mark = "\ue000"

    def box(tags: list[str], names: list[str], inner: str) -> str:
        plain = r.random() < 0.35 and tags[0] not in ("div", "section")
        tag = tags[0] if plain else r.choice([*tags, "div"])
        return f"<{tag}{'' if plain else attr(names)}>{inner}</{tag}>"

    nav = lambda: box(["nav"], ["nav", "main-menu", "menu", "navbar", "breadcrumbs", "site-nav"], links(2, 9) if r.random() < 0.7 else " ".join(link() for _ in range(r.randrange(2, 8))))
    head = lambda: box(["header"], ["header", "masthead", "site-header", "topbar"], r.choice([f"<h1>{say(1, 4)}</h1>", f"<div>{say(1, 5)}</div>", f"<p>{say(2, 8)}</p>", link()]) + (nav() if r.random() < 0.5 else ""))
    foot = lambda: box(["footer"], ["footer", "site-footer", "colophon", "copyright"], r.choice([f"&copy; {say(2, 12)}", f"<p>&copy; {say(3, 30)}</p>", links(2, 6) + f"<p>{say(2, 10)}</p>"]))
    side = lambda: box(["aside"], ["sidebar", "side", "widget", "related", "right-rail"], r.choice([f"<h3>{say(1, 4)}</h3>{links(2, 7)}", f"<p>{say(5, 60)}</p>", f"<h2>{say(1, 3)}</h2><p>{say(5, 40)} {link()}</p>"]))
    ad = lambda: box(["div"], ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "advertisement"], r.choice([say(3, 30), f"<p>{say(3, 30)}</p>", f"{link()} {say(3, 12)}"]))
    notice = lambda: box(["div"], ["cookie-notice", "cookies", "notice", "consent", "gdpr-banner", "alert", "popup"], r.choice([f"<p>{say(5, 40)}</p><button>{say(1, 3)}</button>", f"{say(5, 30)} {link()}"]))
    form = lambda: f"<form{dull()}><label>{say(1, 5)}</label><input name=q><p>{say(1, 12)}</p><button>{say(1, 3)}</button></form>" if r.random() < 0.6 else box(["div"], ["newsletter", "subscribe", "search-form", "signup"], f"<p>{say(3, 20)}</p><button>{say(1, 2)}</button>")
    share = lambda: box(["div"], ["share", "social", "share-tools"], " ".join(link() for _ in range(3)))

    def comments() -> str:
        one = lambda: r.choice([f'<article class="comment"><p>{say(4, 50)}</p></article>', f'<div class="comment"><b>{word()}</b><p>{say(4, 60)}</p></div>', f"<li><p>{say(4, 50)}</p></li>"])
        return box(["section"], ["comments", "comment-list", "disqus_thread", "reader-comments"], f"<h2>{say(1, 3)}</h2>" + "".join(one() for _ in range(r.randrange(1, 6))))

    def paragraph() -> str:
        x = mark + say(1, 80) + "."
        if r.random() < 0.25:
            x = f"{x} {link().replace('>', '>' + mark, 1)} {mark}{say(2, 20)}."
        if r.random() < 0.2:
            x = f"<b>{x}" + ("</b>" if r.random() < 0.5 else "<br>")
        return f"<p{dull()}>{x}" + ("</p>" if r.random() < 0.85 else "")

    def body() -> str:
        out = []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            u = r.random()
            out.append(
                paragraph() if u < 0.7
                else f"<h2>{mark}{say(1, 6)}</h2>" if u < 0.78
                else "<ul>" + "".join(f"<li>{mark}{say(2, 20)}</li>" for _ in range(3)) + "</ul>" if u < 0.84
                else f"<blockquote><p>{mark}{say(4, 40)}</p></blockquote>" if u < 0.88
                else f"<pre>{mark}{say(4, 30)}</pre>" if u < 0.9
                else f"<table><tr><th>{mark}{word()}</th><td>{mark}{say(1, 6)}</td></tr></table>" if u < 0.93
                else f"<div>{mark}{say(5, 60)}</div>" if u < 0.96
                else f"<figure><img src=x><figcaption>{mark}{say(2, 12)}</figcaption></figure>"
            )
            if r.random() < 0.08:
                out.append(r.choice([ad, share, form, notice, side])())
        return "".join(out)

    title = f"<h1{dull()}>{mark}{say(1, 12)}</h1>"
    title = r.choice([title, title, title, f"<header>{title}</header>", ""])
    kind = r.random()
    inside = title + body() + (r.choice([comments, share, form, ad])() if r.random() < 0.25 else "") + (box(["footer"], ["footer", "post-footer"], f"<p>{say(2, 12)}</p>") if r.random() < 0.08 else "")
    tag, names = r.choice([("article", None), ("article", None), ("main", None), ("div", ["content", "article-body", "post", "entry-content", "story", "main-content"]), ("section", ["content", "post-body"]), ("div", [word(), "col-9"])])
    main = f"<{tag}{attr(names) if names else dull()}>{inside}</{tag}>"
    if kind < 0.25:
        main = f"<main{dull()}>{main}</main>"
    elif kind < 0.5:
        main = f"<div{dull()}>{main}{side() if r.random() < 0.5 else ''}</div>"
    maybe = lambda f, p: f() if r.random() < p else ""
    front = [maybe(head, 0.5), maybe(nav, 0.7), maybe(notice, 0.3), maybe(ad, 0.5), maybe(side, 0.25), maybe(form, 0.15)]
    back = [maybe(comments, 0.35), maybe(side, 0.35), maybe(ad, 0.3), maybe(form, 0.2), maybe(foot, 0.8), maybe(notice, 0.15)]
    r.shuffle(front)
    tail = "</body></html>" if r.random() < 0.9 else ""
    return f'<!DOCTYPE html><html><head><title>{say(1, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body{dull()}>{"".join(front)}<!-- {say(1, 3)} -->{main}{"".join(back)}{tail}'


def labelled(page: Page) -> np.ndarray:
    """1 for marked texts and for every element that holds one."""
    y = np.array([1.0 if t and "\ue000" in t else 0.0 for t in page.text])
    for i in range(len(y) - 1, 0, -1):
        if y[i]:
            y[page.parent[i]] = 1.0
    return y


@lru_cache(maxsize=2)
def model(pages: int = 700, seed: int = 11) -> Trees:
    """Trained on synthetic pages only; about ten seconds on the driver, and small enough to send to every task."""
    r = random.Random(seed)
    made = [Page(synthetic_page(r)) for _ in range(pages)]
    return Trees().fit(np.concatenate([features(p) for p in made]), np.concatenate([labelled(p) for p in made]))


def extract(df: DataFrame, source: str = "html", text: str = "main_text") -> DataFrame:
    """Adds the main text of each page."""
    df = df.drop(text)
    shared = share(df, model())
    schema = StructType([*df.schema.fields, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, source, 1 << 20):
                pages = [Page(x or "") for x in part.column(source).to_pylist()]
                odds = shared.value.log_odds(np.concatenate([features(p) for p in pages]))
                cuts = np.cumsum([len(p.kind) for p in pages])[:-1]
                texts = [render(p, decode(p, o)) for p, o in zip(pages, np.split(odds, cuts), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    """Query op7: all pages."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
