"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every element gets the log odds that its own text belongs to the article, by boosted regression trees over
its subtree, attributes, depth and siblings. A page's nodes are then decoded together: an element is before
the article, in it, or cut out of it, and a child may only stay or step forward, so no descendant of what is
cut out returns. The best labelling of the whole tree is found bottom-up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from html.parser import HTMLParser
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_pages import AD_NAMES, ARTICLE_NAMES, COMMENT_NAMES, FOOTER_NAMES, HEADER_NAMES, KNOWN, NAV_NAMES, NOTICE_NAMES, SIDE_NAMES, Pages

TRAINING_PAGES, TREES, DEPTH, RATE, BINS = 500, 50, 4, 0.25, 24

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"head", "script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "button"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: A start tag of the first kind ends an open element of the second.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
KINDS = [{"article"}, {"main"}, {"section"}, {"div"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"blockquote", "pre", "figure", "figcaption"}, {"table", "tr", "td", "th", "tbody", "thead"}]
NAMES = [ARTICLE_NAMES, NAV_NAMES, HEADER_NAMES, FOOTER_NAMES, SIDE_NAMES, AD_NAMES, NOTICE_NAMES, COMMENT_NAMES]
_TOKENS = [{w for name in names for w in name.split("-")} for names in NAMES]
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "depth", "index")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []
        self.depth, self.index = (parent.depth + 1, len(parent.parts)) if parent else (0, 0)


class Tree(HTMLParser):
    """Elements and texts of a page; inline elements are part of their block's text, with marks where lines break."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.open, self.nodes = [self.root], [self.root]
        self.names: Counter[str] = Counter()  # of open elements
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br" or tag == "hr":
            self.open[-1].parts.append("\n")
        if tag in VOID or tag in INLINE and tag not in SILENT:
            if tag == "a":
                self.open[-1].parts.append("\x00<")
            return
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if closes and self.open[-1].tag in closes:
            self.names[self.open.pop().tag] -= 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].parts.append(node)
        self.open.append(node)
        self.names[tag] += 1
        self.nodes.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.open[-1].parts.append("\x00>")
        while self.names[tag]:  # what is open inside of it ends with it
            closed = self.open.pop()
            self.names[closed.tag] -= 1
            if closed.tag == tag:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


@lru_cache(maxsize=20_000)
def _marks(tag: str, naming: str) -> np.ndarray:
    """Which lists of NAMES the names occur in, and which of KINDS the tag is."""
    words = set(re.split(r"[^a-z]+", naming.lower()))
    return np.array([float(bool(words & t)) for t in _TOKENS] + [float(tag in k) for k in KINDS])


def described(tree: Tree) -> np.ndarray:
    """Features of every element; what it says itself, what its subtree holds, its names, place and neighbours."""
    own, sums = {}, {}
    for node in reversed(tree.nodes):
        text = link = ends = chars = links = ps = items = elements = inputs = kids = 0
        in_link = False
        for part in node.parts:
            if isinstance(part, Node):
                c, k, e, p, i, n, f = sums[part]
                chars, links, ends, ps, items, elements, inputs = chars + c, links + k, ends + e, ps + p, items + i, elements + n, inputs + f
                kids += 1
            elif part == "\x00<":
                in_link = True
            elif part == "\x00>":
                in_link = False
            else:
                n = len(part.strip())
                text += n
                link += n * in_link
                ends += part.count(".") + part.count(",") + part.count(";") + part.count("!") + part.count("?")
        if node.tag in SILENT:
            text = link = ends = chars = links = ps = items = elements = inputs = 0
        own[node] = (text, link, kids)
        sums[node] = (chars + text, links + link, ends, ps + (node.tag == "p"), items + (node.tag == "li"), elements + 1, inputs + (node.tag in ("input", "label", "form")))
    page = max(sums[tree.root][0], 1)
    rows, seen = [], 0
    marks: dict[Node, np.ndarray] = {}
    mine, whole = [], []
    for node in tree.nodes:
        text, link, kids = own[node]
        chars, links, ends, ps, items, elements, inputs = sums[node]
        parent = node.parent
        around = sums[parent] if parent else sums[node]
        m = _marks(node.tag, f"{node.attrs.get('class', '')} {node.attrs.get('id', '')} {node.attrs.get('role', '')}" if node.attrs else "")
        marks[node] = np.maximum(m, marks[parent]) if parent else m
        mine.append(m)
        whole.append(marks[node])
        rows.append((
            log1p(chars), links / max(chars, 1), ends / max(chars, 1) * 100, log1p(ps), log1p(items), chars / max(elements, 1), log1p(inputs), log1p(text), link / max(text, 1), kids,
            chars / page, seen / page, node.depth, chars / max(around[0], 1), log1p(around[3]), around[1] / max(around[0], 1) if links else 0.0, node.index / max(len(parent.parts) if parent else 1, 1)))
        seen += text
    return np.concatenate([np.array(rows, float), np.array(mine), np.array(whole)], 1)


class Boosted:
    """Boosted regression trees on binned features, for log odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1)
        share = np.average(y, weights=weight)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = self._grown(binned, (y - p) * weight, p * (1 - p) * weight, np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            z += self._of(tree, x)

    def _grown(self, binned, g, h, rows, depth):
        leaf = RATE * g[rows].sum() / (h[rows].sum() + 1.0)
        if depth == 0 or len(rows) < 40:
            return leaf
        best = (1e-6, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f, cuts in enumerate(self.cuts):
            if len(cuts):
                gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cuts) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cuts) + 1))[:-1]
                gain = gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - whole
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            return leaf
        f, k = best[1]
        low = binned[rows, f] <= k
        return f, float(self.cuts[f][k]), self._grown(binned, g, h, rows[low], depth - 1), self._grown(binned, g, h, rows[~low], depth - 1)

    def _of(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        goes = x[:, f] <= cut
        out = np.empty(len(x))
        out[goes], out[~goes] = self._of(low, x[goes]), self._of(high, x[~goes])
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._of(t, x) for t in self.trees)


def _true(node: Node) -> bool:
    """Whether a training node is part of the article: below its element, and below nothing that is cut out."""
    while node is not None:
        words = set(re.split(r"[^a-z]+", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()))
        if KNOWN in node.attrs:
            return True
        if node.tag in SILENT or node.tag in ("nav", "aside", "form", "footer", "header") or any(words & _TOKENS[k] for k in range(1, 8)):
            return False
        node = node.parent
    return False


@cache
def classifier() -> Boosted:
    """Trees fitted on TRAINING_PAGES generated pages; the bound doesn't depend on the table."""
    xs, ys, ws = [], [], []
    for seed in range(TRAINING_PAGES):
        tree = Tree(Pages(seed).page())
        x = described(tree)
        xs.append(x)
        ys += [_true(n) for n in tree.nodes]
        ws += (0.3 + x[:, 7]).tolist()
    return Boosted(np.concatenate(xs), np.array(ys, float), np.array(ws))


BEFORE, IN, CUT = range(3)


def decoded(tree: Tree, odds: list[float]) -> dict[Node, int]:
    """The labelling with the largest sum: own odds in the article, their opposite outside, never back from CUT."""
    best: dict[Node, tuple[float, float, float]] = {}
    for node, z in zip(reversed(tree.nodes), odds[::-1]):
        before, inside, cut = (0.0, -1e6, 0.0) if node.tag in SILENT else (-z, z, -z)
        for part in node.parts:
            if isinstance(part, Node):
                b = best[part]
                before, inside, cut = before + max(b[BEFORE], b[IN]), inside + max(b[IN], b[CUT]), cut + b[CUT]
        best[node] = (before, inside, cut)
    state: dict[Node, int] = {}
    for node in tree.nodes:
        b = best[node]
        above = state[node.parent] if node.parent else BEFORE
        options = {BEFORE: (BEFORE, IN), IN: (IN, CUT), CUT: (CUT,)}[above]
        state[node] = max(options, key=lambda s: b[s])
    return state


def blocks(tree: Tree, state: dict[Node, int]) -> list[str]:
    """Texts of the article's blocks in page order, each with single blanks."""
    out, held = [], []

    def flush() -> None:
        text = _BLANK.sub(" ", "".join(held)).strip()
        if text:
            out.append(text)
        held.clear()

    stack: list = [(tree.root, 0)]
    while stack:
        node, at = stack.pop()
        keep = state[node] == IN
        while at < len(node.parts):
            part = node.parts[at]
            at += 1
            if isinstance(part, Node):
                flush()
                stack += [(node, at), (part, 0)]
                break
            if keep and part == "\n":
                flush()
            elif keep and part not in ("\x00<", "\x00>"):
                held.append(part)
        else:
            flush()
    return out


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [Tree(h or "") for h in pages]
    features = [described(t) for t in trees]
    odds = np.clip(model.log_odds(np.concatenate(features)), -8, 8)
    ends = np.cumsum([len(f) for f in features]).tolist()
    return [" ".join(blocks(t, decoded(t, odds[b - len(f) : b].tolist()))) for t, f, b in zip(trees, features, ends)]


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages (page_id, url, html).

    Null and empty pages, and pages without an article, have the empty text. Broken markup is read as far as it
    goes; repeated rows are read each. An empty table gives no rows.
    """
    model = classifier()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            html = pdf["html"].tolist()
            texts = [t for k in range(0, len(html), 64) for t in main_texts(html[k : k + 64], model)]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(rows, "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
