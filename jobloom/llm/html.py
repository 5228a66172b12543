"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are block elements and the runs of inline text in them.  Each has a binary variable, content or not, with a
potential from its tag, names and text, and one with its parent.  Sum-product messages go up to the root and down again,
level by level for all pages of a batch at once, and give every node's content marginal.  The potentials are learned by
maximum likelihood from labelled pages, in which the attribute ``data-content`` marks what is the article.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import cache
from html import unescape
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches

HASHED, PAGES, STEPS, RATE, SEED = 4096, 600, 150, 0.08, 11
#: Levels of a batch of pages from which nodes are worked on one by one.
DEEP = 2000

# Fixed values of the HTML standard: void elements, elements whose content isn't rendered text, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style title textarea iframe xmp noembed noframes".split())
HIDDEN = frozenset("noscript template svg math object canvas audio video select".split())
# Elements that end an svg or math element which is still open where they start.
BREAKS_OUT = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 hr li menu ol p pre table ul article section main aside nav header footer form".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rb rp rt wbr img br input".split())
# An open element that the start of another ends, up to the nearest element that holds both.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "depth", "names", "kept", "text", "linked", "parts", "place")

    def __init__(self, tag: str, parent: int, depth: int, names: tuple[str, ...] = (), kept: bool = False):
        self.tag, self.parent, self.depth, self.names, self.kept = tag, parent, depth, names, kept
        self.text, self.linked, self.parts, self.place = "", 0, [], 0.0


class Marks:
    """A page's marks, one after the other: comments, CDATA, declarations and tags.

    A tag ends at the first ``>`` outside of quotes or, if its quotes don't close, at the first of all.  Where the quotes
    from an opening one on lead is remembered, so that no part of a page is looked through for each of its tags.
    """

    def __init__(self, html: str):
        self.html, self.last_end = html, html.rfind(">")
        self.last = {q: html.rfind(q) for q in "\"'"}
        self.leads: dict[int, int] = {}  # an opening quote's place -> the end of the tag, or -1

    def tag_end(self, at: int) -> int:
        """The place of a tag's ``>``, scanned from ``at``."""
        seen, out = [], -1
        while m := _QUOTE_OR_END.search(self.html, at):
            k = m.start()
            if m[0] == ">":
                out = k
                break
            if k in self.leads:
                out = self.leads[k]
                break
            seen.append(k)
            if k >= self.last[m[0]]:
                break
            at = self.html.index(m[0], k + 1) + 1
        self.leads.update(dict.fromkeys(seen, out))
        return out

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, kind, name, rest) of the first mark from ``at`` on; kinds: comment, data, other, start, end."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(html), "comment", "", ""
            if html.startswith("<![CDATA[", at):
                end = html.find("]]>", at + 9)
                return (at, end + 3, "data", "", html[at + 9 : end]) if end >= 0 else (at, len(html), "data", "", html[at + 9 :])
            if at > self.last_end:  # no mark ends any more but comments and data, which need no end
                left = [k for k in (html.find("<!--", at), html.find("<![CDATA[", at)) if k >= 0]
                if not left:
                    return None
                at = min(left)
                continue
            if html[at + 1 : at + 2] in ("!", "?"):
                return at, html.index(">", at) + 1, "other", "", ""
            if m := _TAG.match(html, at):
                end = self.tag_end(m.end())
                end = html.index(">", m.end()) if end < 0 else end
                return at, end + 1, "end" if m[1] else "start", m[2].lower(), html[m.end() : end]
            at += 1
        return None


class Open:
    """The open elements, with the places of each tag, of blocks and of hidden ones, so that nothing is searched for."""

    def __init__(self):
        self.all: list[tuple[str, int]] = []  # tag and number (-1: inline, -2: hidden, -3: within a hidden one)
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.hidden: list[int] = []
        self.links = 0

    def push(self, tag: str, number: int) -> None:
        k = len(self.all)
        self.all.append((tag, number))
        self.places.setdefault(tag, []).append(k)
        if number >= 0:
            self.blocks.append(k)
        elif number == -2:
            self.hidden.append(k)
        self.links += tag == "a" and number == -1

    def last(self, tag: str) -> int:
        """The place of the innermost one of this tag; the root's, 0, if there is none."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def cut(self, k: int) -> bool:
        """End the elements from the k-th on; whether a block was among them."""
        ends_block = self.blocks[-1] >= k
        while len(self.all) > k:
            tag, number = self.all.pop()
            self.places[tag].pop()
            if number >= 0:
                self.blocks.pop()
            elif number == -2:
                self.hidden.pop()
            self.links -= tag == "a" and number == -1
        return ends_block

    def block(self) -> int:
        return self.all[self.blocks[-1]][1]


def tree(html: str | None) -> list[Node]:
    """A page's nodes, parents before children, texts in page order; always at least the root.

    A head tag is passed over, as authors may leave its end out; what a head holds isn't rendered anyway.  What stands in
    a hidden element is left out up to its own end tag or its parent's, nested ones counted; a hidden or opaque element
    that is nowhere ended hides nothing, but script and style do, as in browsers.  The time is linear in the page, also
    of broken and deeply nested ones.
    """
    html = html or ""
    nodes, open_, marks = [Node("#root", -1, 0)], Open(), Marks(html)
    open_.push("#root", 0)
    run: Node | None = None
    at, skip = 0, ""
    last_end: dict[str, int] = {}

    def ended(tag: str) -> bool:
        """Whether an end tag of this name follows."""
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", html, re.I)), default=-1)
        return last_end[tag] >= at

    def text(raw: str) -> None:
        nonlocal run
        if not raw or open_.hidden:
            return
        if run is None:
            if not raw.strip():
                return
            parent = open_.block()
            run = Node("#text", parent, nodes[parent].depth + 1, (), nodes[parent].kept)
            nodes.append(run)
        run.parts.append(raw)
        if open_.links:
            run.linked += len(raw)

    def cut(k: int) -> None:
        nonlocal run
        if open_.cut(k):
            run = None

    def close(tags: set[str], stop: set[str]) -> None:
        k = max(map(open_.last, tags))
        if k and k > max(map(open_.last, stop)):
            cut(k)

    while at < len(html):
        if skip:  # what isn't rendered, up to its end tag
            end = re.compile(rf"</{re.escape(skip)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at, skip = (end.end() if end else len(html)), ""
            continue
        m = marks.next(at)
        if not m:
            text(unescape(html[at:]))
            break
        start, end, kind, tag, attrs = m
        text(unescape(html[at:start]))
        at = end
        if kind == "data":
            text(attrs)
        if not tag or tag == "head":
            continue
        if tag == "br":
            text(" ")
            continue
        if kind == "end":
            k = open_.last(tag)
            if k and (tag not in INLINE or open_.blocks[-1] < k):  # an inline end tag doesn't end blocks
                cut(k)
            continue
        if tag in OPAQUE:
            if tag in ("script", "style") or ended(tag):
                skip = tag
            continue
        if open_.hidden and tag in BREAKS_OUT:
            k = open_.hidden[-1]
            if open_.all[k][0] in ("svg", "math") and open_.last("foreignobject") < k:
                while open_.all[k - 1][1] < -1:
                    k -= 1
                cut(k)
        if tag in HIDDEN:
            if not attrs.endswith("/") and ended(tag):
                open_.push(tag, -2)
        elif tag in VOID:
            if tag not in INLINE and not open_.hidden:
                run = None
        elif open_.hidden:
            if not attrs.endswith("/"):
                open_.push(tag, -3)
        elif tag in INLINE:
            open_.push(tag, -1)
        else:
            if tag in ENDS:
                close(*ENDS[tag])
            else:
                close({"p"}, {"table", "button"})
            found = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(attrs)} if attrs else {}
            names = tuple(_NAME.findall(" ".join(found.get(k, "") for k in ("class", "id", "role", "aria-label")).lower()))
            parent = open_.block()
            run = None
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, names, nodes[parent].kept or "data-content" in found))
            open_.push(tag, len(nodes) - 1)
    for k, n in enumerate(nodes):
        n.text, n.place, n.parts = " ".join("".join(n.parts).split()), k / len(nodes), []
    return nodes


def _row(*parts) -> int:
    return 1 + zlib.crc32(" ".join(map(str, parts)).encode()) % (HASHED - 1)


def features(nodes: list[Node]) -> list[list[int]]:
    """Rows of the weights for each node of a page."""
    below = [0] * len(nodes)
    linked = [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        n = nodes[k]
        below[k] += len(n.text)
        linked[k] += min(n.linked, len(n.text))
        below[n.parent] += below[k]
        linked[n.parent] += linked[k]
    out = []
    for k, n in enumerate(nodes):
        up = nodes[n.parent] if n.parent >= 0 else n
        size, share = len(bin(below[k])), int(4 * linked[k] / max(1, below[k]))
        rows = [_row("bias", n.tag == "#text"), _row("tag", n.tag), _row("in", up.tag, n.tag), _row("links", share, n.tag == "#text"), _row("size", size, n.tag == "#text"), _row("share", int(4 * below[k] / max(1, below[0])), n.tag == "#text")]
        if n.tag == "#text":
            rows += [_row("stop", n.text[-1:] in ".!?…"), _row("commas", min(3, n.text.count(",")))]
        rows += [_row("name", x) for x in n.names]
        out.append(rows)
    return out


class Forest:
    """Many pages' nodes as arrays."""

    def __init__(self, pages: list[list[Node]]):
        rows = [r for nodes in pages for r in features(nodes)]
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.rows = np.fromiter(chain.from_iterable(rows), np.int64, self.sizes.sum())  # those of all nodes, one after the other
        starts = np.cumsum([0] + [len(p) for p in pages])
        self.parent = np.array([n.parent + s if n.parent >= 0 else -1 for nodes, s in zip(pages, starts) for n in nodes])
        self.kind = np.array([int(n.tag == "#text") for nodes in pages for n in nodes])
        depth = np.array([n.depth for nodes in pages for n in nodes])
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2)) if len(depth) else []
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]  # below the roots, by depth


class Model:
    """Weights of the nodes' potentials (for content) and of the parent-child potentials, by kind of child."""

    def __init__(self, labelled: list[str] | None = None):
        pages = [tree(h) for h in (labelled_pages() if labelled is None else labelled)]
        truth = []
        for nodes in pages:
            kept = [n.kept and n.tag == "#text" for n in nodes]
            for k in range(len(nodes) - 1, 0, -1):
                kept[nodes[k].parent] = kept[nodes[k].parent] or kept[k]
            truth += kept
        f, gold = Forest(pages), np.array(truth, np.int64)
        self.weights, self.pair = np.zeros(HASHED), np.zeros((2, 2, 2))
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.weights, self.pair)]
        child = np.flatnonzero(f.parent >= 0)
        counted = np.zeros((2, 2, 2))
        np.add.at(counted, (f.kind[child], gold[f.parent[child]], gold[child]), 1)
        for step in range(1, STEPS + 1):
            likely, pairs = self.marginals(f, pairs=True)
            g = np.bincount(f.rows, np.repeat(gold - likely, f.sizes), HASHED) / len(pages) - 0.002 * self.weights
            for x, (m, v), slope in zip((self.weights, self.pair), state, (g, (counted - pairs) / len(pages) - 0.002 * self.pair)):
                m += 0.1 * (slope - m)
                v += 0.01 * (slope**2 - v)
                x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def unary(self, f: Forest) -> np.ndarray:
        """Each node's own potential for content."""
        return np.add.reduceat(self.weights[f.rows], np.cumsum(f.sizes) - f.sizes)

    def marginals(self, f: Forest, pairs: bool = False):
        """Each node's probability of being content; ``pairs``: also the expected counts of parent-child states."""
        up = np.zeros((len(f.parent), 2))
        up[:, 1] = self.unary(f)
        sent, down = np.zeros_like(up), np.zeros_like(up)
        if len(f.levels) > DEEP and not pairs:
            return self._deep(f, up)
        for level in reversed(f.levels):
            sent[level] = np.logaddexp.reduce(self.pair[f.kind[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, f.parent[level], sent[level])
        expected = np.zeros((2, 2, 2))
        for level in f.levels:
            parent = f.parent[level]
            rest = up[parent] + down[parent] - sent[level]
            both = self.pair[f.kind[level]] + rest[:, :, None]
            down[level] = np.logaddexp.reduce(both, axis=1)
            if pairs:
                both += up[level][:, None, :]
                p = np.exp(both - both.max(axis=(1, 2), keepdims=True))
                np.add.at(expected, f.kind[level], p / p.sum(axis=(1, 2), keepdims=True))
        odds = (up + down)[:, 1] - (up + down)[:, 0]
        likely = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        return (likely, expected) if pairs else likely

    def _deep(self, f: Forest, up: np.ndarray) -> np.ndarray:
        """The same node by node, for pages so deep that most levels hold a node or two."""
        low, high = up[:, 0].tolist(), up[:, 1].tolist()
        parent, kind, pair = f.parent.tolist(), f.kind.tolist(), self.pair.tolist()
        order = [k for level in f.levels for k in level.tolist()]
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * len(low)
        down: list[tuple[float, float]] = [(0.0, 0.0)] * len(low)

        def joined(a: float, b: float) -> float:
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        for k in reversed(order):
            (a, b), (c, d) = pair[kind[k]]
            sent[k] = joined(a + low[k], b + high[k]), joined(c + low[k], d + high[k])
            low[parent[k]] += sent[k][0]
            high[parent[k]] += sent[k][1]
        for k in order:
            (a, b), (c, d) = pair[kind[k]]
            u = parent[k]
            x, y = low[u] + down[u][0] - sent[k][0], high[u] + down[u][1] - sent[k][1]
            down[k] = joined(a + x, c + y), joined(b + x, d + y)
        odds = np.array(high) - np.array(low) + np.array([y - x for x, y in down])
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def extract(self, htmls: list[str | None]) -> list[str]:
        """The main text of each page."""
        pages = [tree(h) for h in htmls]
        if not pages:
            return []
        likely = iter(self.marginals(Forest(pages)).tolist())
        return ["\n".join(n.text for n, p in [(n, next(likely)) for n in nodes] if p >= 0.5 and n.text) for nodes in pages]


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages of common layouts with invented words; ``data-content`` marks the article."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    parts = ["ka", "lo", "mi", "ter", "ve", "sun", "dor", "pel", "a", "ri", "no"]
    word = lambda: "".join(pick(parts) for _ in range(int(rng.integers(1, 5))))

    def words(low, high):
        return " ".join(word() + ("," if rng.random() < 0.08 else "") for _ in range(int(rng.integers(low, high))))

    def sentence(low=3, high=25):
        return words(low, high).capitalize() + pick([".", ".", ".", "!", "?"])

    def links(k):
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def paragraph():
        body = " ".join(sentence() for _ in range(int(rng.integers(1, 6)))) if rng.random() < 0.8 else sentence(1, 4)
        if rng.random() < 0.15:
            body = f'<b>{body}</b> <a href="/x">{word()}</a> {sentence()}'
        return pick([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br><p>{sentence()}</p>"])

    def article():
        out = f"<h1>{sentence(2, 10)}</h1>" + "".join(paragraph() for _ in range(int(rng.integers(1, 9))))
        for extra in (f"<h2>{words(1, 6)}</h2>{paragraph()}", f"<blockquote>{sentence()}</blockquote>", "<ul>" + "".join(f"<li>{sentence(3, 12)}</li>" for _ in range(3)) + "</ul>", "<ol>" + "".join(f"<li>{sentence(3, 12)}</li>" for _ in range(3)) + "</ol>", f"<table><tr><th>{word()}</th><td>{words(1, 4)}</td></tr></table>", f"<pre>{words(5, 20)}</pre>"):
            if rng.random() < 0.12:
                out += extra
        return out

    def named(names, inner, tags=("div", "section", "aside")):
        return f'<{(t := pick(tags))} {pick(["class", "class", "id"])}="{pick(names)}">{inner}</{t}>'

    def outside():
        prose = " ".join(sentence() for _ in range(int(rng.integers(1, 4))))
        return [
            lambda: f"<nav>{links(int(rng.integers(2, 8)))}</nav>",
            lambda: f'<header>{pick(["", f"<h1>{words(1, 3)}</h1>", f"<a href=/>{words(1, 3)}</a>"])}<p>{words(2, 8)}</p></header>',
            lambda: f"<footer>&copy; {word()}.example &middot; {prose}</footer>",
            lambda: f"<footer><p>{prose}</p>{links(3)}</footer>",
            lambda: f"<aside><h3>{words(1, 3)}</h3>{pick([links(4), f'<p>{prose}</p>'])}</aside>",
            lambda: f"<form><label>{word()}</label><input name=q><p>{words(2, 6)}</p><button>{word()}</button></form>",
            lambda: named(["ad", "ads", "advert", "ad banner", "banner", "promo", "sponsored", "advertisement"], pick([prose, f"<p>{prose}</p>"])),
            lambda: named(["sidebar", "side widget", "widget", "related", "related posts", "recommended", "share", "social", "tags"], pick([links(4), f"<h3>{words(1, 3)}</h3><p>{prose}</p>", prose])),
            lambda: named(["menu", "navigation", "breadcrumb", "breadcrumbs", "nav bar", "topbar", "pagination"], links(int(rng.integers(2, 6)))),
            lambda: named(["header", "site header", "masthead", "page header"], f"<p>{words(1, 8)}</p>", ("div",)),
            lambda: named(["footer", "site footer", "copyright", "legal"], f"<p>{prose}</p>", ("div",)),
            lambda: named(["cookie", "cookie notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe"], pick([prose, f"<p>{prose}</p><button>{word()}</button>"])),
            lambda: named(["comments", "comment list", "comment", "replies", "discussion", "disqus"], "".join(f'<{(t := pick(["div", "li", "article"]))} class="comment"><p>{sentence()}</p></{t}>' for _ in range(int(rng.integers(1, 5))))),
        ]

    def some(k):
        return "".join(pick(outside())() for _ in range(k))

    pages = []
    for _ in range(n):
        body = article()
        inner = pick(
            [
                lambda: f"<article data-content=1>{body}</article>",
                lambda: f"<article data-content=1>{body}</article>",
                lambda: f"<main><article data-content=1>{body}</article>{some(int(rng.integers(0, 2)))}</main>",
                lambda: f"<main data-content=1>{body}</main>",
                lambda: f'<div {pick(["class", "id"])}="{pick(["content", "main", "post", "entry content", "article", "article body", "post content", "story", "text"])}" data-content=1>{body}</div>',
                lambda: f'<div class="{pick(["wrapper", "container", "page", "row"])}">{some(1)}<div class="{pick(["content", "post", "article", "entry"])}" data-content=1>{body}</div>{some(1)}</div>',
                lambda: f'<section class="{pick(["content", "post", "article"])}" data-content=1>{body}</section>',
                lambda: f'<article><div class="body" data-content=1>{body}</div>{some(1)}</article>',
            ]
        )()
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{some(int(rng.integers(1, 4)))}{inner}{some(int(rng.integers(1, 4)))}</body></html>")
    return pages


@cache
def default_model() -> Model:
    """The model of the generated pages, trained once in a process."""
    return Model()


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row, blocks joined by line breaks; empty if there is none.

    A null or empty html has an empty text; a very long one is one tree.  Repeated rows give a row each; an empty table
    gives no rows; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # of a fixed size

    def make():
        def run(ids, links, htmls):
            texts = shared.value.extract(htmls)
            return [ids, links, texts, list(map(len, texts))]

        return run

    return map_batches(pages, ["page_id", "url", "html"], make, "page_id bigint, url string, text string, n_chars bigint")


#: For pages whose article stands in one article element of headings and paragraphs, as those of the given table do.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'g'), '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
