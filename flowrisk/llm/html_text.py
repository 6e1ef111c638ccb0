"""Main text of web pages by a tree-structured graphical model.

The page's block elements form a tree. Each has one of three labels: around the
article, content, boilerplate. A node has a unary potential (what the element and its
text look like), an edge a potential for the pair of parent's and child's label by the
child's kind; sum-product messages go up to the root and down again and give each
node's marginals. Text under a node whose content marginal is the largest is kept.

Potentials are learned from labelled pages: a bounded sample (``SAMPLE_PAGES``) of the
pages that mark their article (``article``, ``main``, ``role=main``), the marks giving
the labels. Each is learned from twice: as it is, for pages with marks, and with its
marks hidden (their elements plain), for pages without. Small pseudo-counts stand for
kinds that the sample does not show.

Defined results: null and empty html give an empty text; broken mark-up is read as far
as it goes; pages without article marks are decided by the potentials of hidden marks; repeated rows
give repeated results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import texts

#: Bound on the pages that the potentials are learned from.
SAMPLE_PAGES = 2_000
AROUND, CONTENT, BOILER = 0, 1, 2
PLAIN, MARKED, SHUNNED = 0, 1, 2

# HTML's elements by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes object audio video canvas select option button".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img input picture meter progress output map area".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("caption",), "tfoot": ("tr", "td", "th", "tbody")}
_SCOPE = frozenset("ul ol dl table article section div body html nav aside main td th".split())
_SHUNNED_TAGS = frozenset("nav aside footer header form menu dialog fieldset head search".split())
# Words in class, id and role that name boilerplate, and the article.
_SHUNNED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer "
    "contentinfo sidebar aside complementary widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist reply replies respond disqus "
    "discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search form pagination pager copyright disclaimer legal skip hidden toolbar tags tagcloud teaser outbrain taboola".split()
)
_MARKED_WORDS = frozenset("article main articlebody".split())

# An attribute, its value quoted or not (a quote inside an unquoted value is part of it; a quote
# that never closes ends with the tag); groups: name and the three forms of value.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_ATTRIBUTES = r"(?>(?:[\s/]++|" + _ATTRIBUTE.pattern.replace("(\"", "(?:\"").replace("([^", "(?:[^") + r")*+)"
# Comments, declarations, tags; a tag that the page ends in says nothing.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(" + _ATTRIBUTES + r")>|</?[a-zA-Z][^>]*\Z", re.S)
_TELLING = frozenset("class id role itemprop hidden aria-hidden".split())
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@lru_cache(maxsize=20_000)
def _kind(tag: str, attributes: str) -> int:
    if tag in _SHUNNED_TAGS:
        return SHUNNED
    marked = tag in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() not in _TELLING:
            continue
        value = m[2] or m[3] or m[4] or ""
        words = {w.lower() for w in _WORD.findall(value)} | set(re.split(r"[\s_-]+", value.lower()))
        if m[1].lower() == "hidden" or m[1].lower() == "aria-hidden" and value.lower() == "true" or words & _SHUNNED_WORDS:
            return SHUNNED
        marked |= m[1].lower() in ("role", "itemprop") and bool(words & _MARKED_WORDS)
    return MARKED if marked else PLAIN


@dataclass
class Page:
    """Block elements in page order (parents first) and the texts between them."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    kind: list[int] = field(default_factory=lambda: [PLAIN])
    own: list[int] = field(default_factory=lambda: [0])  # characters of text right under the node
    linked: list[int] = field(default_factory=lambda: [0])  # of which in links
    pieces: list[tuple[int, str | None]] = field(default_factory=list)  # node and text; None: a block begins or ends


def parse(html: str) -> Page:
    page = Page()
    open_: list[tuple[str, int]] = [("#root", 0)]  # tag, its block node
    places: dict[str, list[int]] = {}  # of the open elements, by tag
    blocks = [0]  # places of those that are no inline elements
    at, links = 0, 0
    pieces = page.pieces

    def push(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(open_))
        if tag not in _INLINE:
            blocks.append(len(open_))
        open_.append((tag, node))

    def close(depth: int) -> None:
        nonlocal links
        for tag, _ in open_[depth:]:
            places[tag].pop()
            links -= tag == "a"
        if blocks[-1] >= depth:
            pieces.append((open_[depth - 1][1], None))
            while blocks[-1] >= depth:
                blocks.pop()
        del open_[depth:]

    def text(raw: str) -> None:
        if raw:
            node = open_[-1][1]
            raw = unescape(raw) if "&" in raw else raw
            pieces.append((node, raw))
            if size := len(raw.strip()):
                page.own[node] += size
                page.linked[node] += size if links else 0

    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = places[tag][-1] if places.get(tag) else 0
            if depth and not (tag in _INLINE and blocks[-1] > depth):
                close(depth)
            elif tag == "br" or tag == "p" and not depth:
                pieces.append((open_[-1][1], " " if tag == "br" else None))
            continue
        if tag in _RAW:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
                at = end.end()
            if tag not in _INLINE:
                pieces.append((open_[-1][1], " "))
            continue
        if tag in _VOID:
            pieces.append((open_[-1][1], None if tag == "hr" else " " if tag == "br" else ""))
            continue
        if tag in _CLOSES_P and open_[blocks[-1]][0] == "p":
            close(blocks[-1])
        if siblings := _SIBLINGS.get(tag):
            while True:
                near = max((places[t][-1] for t in (*siblings, *_SCOPE) if places.get(t)), default=0)
                if not near or open_[near][0] not in siblings:
                    break
                close(near)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
        if tag == "body" and places.get("head"):
            close(places["head"][0])
        if tag in _INLINE:
            node = open_[-1][1]
            kind = _kind(tag, m[3]) if "=" in m[3] and tag != "a" else PLAIN
            if kind != SHUNNED:
                links += tag == "a"
                push(tag, node)
                continue
            # an inline element that is boilerplate is a node, but no block
        else:
            kind = _kind(tag, m[3])
            pieces.append((open_[-1][1], None))
        page.parent.append(open_[-1][1])
        page.tag.append(tag)
        page.kind.append(kind)
        page.own.append(0)
        page.linked.append(0)
        links += tag == "a"
        push(tag, len(page.tag) - 1)
    text(html[at:])
    return page


def features(page: Page) -> np.ndarray:
    """Per node: 1, log of its own text, share of it in links, whether it is a paragraph or a heading."""
    own, linked = np.array(page.own, float), np.array(page.linked, float)
    para = np.array([t in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre") for t in page.tag], float)
    return np.stack([np.ones(len(own)), np.log1p(own) / 5, linked / np.maximum(own, 1), para * (own > 0)], axis=1)


def marked_labels(page: Page) -> list[int] | None:
    """Labels that the page's own marks give; None if it marks no article."""
    labels = [AROUND]
    for parent, kind in zip(page.parent[1:], page.kind[1:], strict=True):
        above = labels[parent]
        labels.append(BOILER if above == BOILER or kind == SHUNNED else CONTENT if above == CONTENT or kind == MARKED else AROUND)
    return labels if CONTENT in labels else None


# Pseudo-counts of (child's kind, parent's label, child's label): what the sample need not show.
_PRIOR = np.array(
    [
        [[9.6, 0.2, 0.2], [0.01, 9.98, 0.01], [1e-5, 1e-5, 10]],
        [[0.1, 9.8, 0.1], [0.1, 9.8, 0.1], [1e-5, 1e-5, 10]],
        [[0.05, 0.05, 9.9], [0.05, 0.05, 9.9], [1e-5, 1e-5, 10]],
    ]
)
# The same for a page without marks: a plain element may be the article.
_BARE_PRIOR = np.array([[[5, 4.8, 0.2], *_PRIOR[0, 1:].tolist()], *_PRIOR[1:].tolist()])
#: Bound on the logarithm of a unary potential: keeps sums finite, decides nothing.
_UNARY = 30


@dataclass
class TreeModel:
    """Edge potentials by the child's kind, and the weights of the unary potential; the
    ``bare`` ones are those of pages without marks."""

    edge: np.ndarray = field(default_factory=lambda: _PRIOR / _PRIOR.sum(axis=2, keepdims=True))
    weights: np.ndarray = field(default_factory=lambda: np.array([-1.0, 1.0, -2.0, 1.0]))
    bare_edge: np.ndarray = field(default_factory=lambda: _BARE_PRIOR / _BARE_PRIOR.sum(axis=2, keepdims=True))
    bare_weights: np.ndarray = field(default_factory=lambda: np.array([-2.0, 2.5, -4.0, 1.0]))

    def marginals(self, page: Page) -> list[tuple[float, float, float]]:
        """Sum-product on the page's tree: the marginals of all nodes."""
        n = len(page.tag)
        bare = marked_labels(page) is None
        unary = np.exp(np.clip(features(page) @ (self.bare_weights if bare else self.weights), -_UNARY, _UNARY)).tolist()
        edge = (self.bare_edge if bare else self.edge).tolist()
        parent, kind = page.parent, page.kind
        up = [(1.0, u, 1.0) if k == PLAIN and page.own[i] else (1.0, 1.0, 1.0) for i, (u, k) in enumerate(zip(unary, kind, strict=True))]  # potential times messages of the children
        sent: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b, c = up[i]
            e = edge[kind[i]]
            x, y, z = (p * a + q * b + r * c for p, q, r in e)
            s = x + y + z
            sent[i] = x, y, z = x / s, y / s, z / s
            p = parent[i]
            a, b, c = up[p]
            a, b, c = a * x, b * y, c * z
            s = a + b + c
            up[p] = (max(a / s, 1e-30), max(b / s, 1e-30), max(c / s, 1e-30))
        out: list[tuple[float, float, float]] = [(1.0, 0.0, 0.0)] * n
        down = [(1.0, 1e-9, 1e-9)] * n
        for i in range(n):
            if i:
                p = parent[i]
                a, b, c = up[p]
                x, y, z = down[p]
                u, v, w = sent[i]
                a, b, c = a * x / u, b * y / v, c * z / w  # what the parent knows without this child
                s = a + b + c
                a, b, c = a / s, b / s, c / s
                e = edge[kind[i]]
                down[i] = tuple(a * e[0][k] + b * e[1][k] + c * e[2][k] for k in range(3))
            a, b, c = (f * g for f, g in zip(up[i], down[i], strict=True))
            s = a + b + c
            out[i] = (a / s, b / s, c / s)
        return out

    def extract(self, html: str) -> str:
        """The main text: blocks joined by an empty line."""
        if not html:
            return ""
        page = parse(html)
        keep = [m[CONTENT] >= m[AROUND] and m[CONTENT] >= m[BOILER] for m in self.marginals(page)]
        blocks: list[str] = []
        held: list[str] = []
        for node, raw in page.pieces:
            if raw is None:
                if held and (block := " ".join("".join(held).split())):
                    blocks.append(block)
                held = []
            elif keep[node]:
                held.append(raw)
        if held and (block := " ".join("".join(held).split())):
            blocks.append(block)
        return "\n\n".join(blocks)


def _weights(x: list[np.ndarray], y: list[bool], mean: np.ndarray) -> np.ndarray:
    """Logistic regression drawn to ``mean``; without both labels ``mean``."""
    if not x or not 0 < sum(y) < len(y):
        return mean
    a, t, c = np.vstack(x), np.array(y, float), mean.copy()
    ridge = np.eye(4)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        c += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (t - p) - ridge @ (c - mean))
    return c


def learn(pages: Iterable[str]) -> TreeModel:
    """Potentials from labelled pages, as they are and with their marks hidden."""
    counts, bare, x, y, bare_x, bare_y = np.zeros((3, 3, 3)), np.zeros((3, 3, 3)), [], [], [], []
    for html in pages:
        page = parse(html)
        labels = marked_labels(page)
        if labels is None:
            continue
        hidden = [PLAIN if k == MARKED else k for k in page.kind]
        for i in range(1, len(labels)):
            counts[page.kind[i], labels[page.parent[i]], labels[i]] += 1
            bare[hidden[i], labels[page.parent[i]], labels[i]] += 1
        known = features(page)
        pick = [i for i in range(len(labels)) if page.own[i]]
        x.append(known[pick])
        y += [labels[i] == CONTENT for i in pick]
        pick = [i for i in pick if hidden[i] == PLAIN]  # the others have no unary potential
        bare_x.append(known[pick])
        bare_y += [labels[i] == CONTENT for i in pick]
    model = TreeModel()
    model.edge, model.bare_edge = ((p + n) / (p + n).sum(axis=2, keepdims=True) for p, n in ((_PRIOR, counts), (_BARE_PRIOR, bare)))
    model.weights, model.bare_weights = _weights(x, y, model.weights), _weights(bare_x, bare_y, model.bare_weights)
    return model


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> TreeModel:
    """Model from at most ``sample_pages`` pages, taken by the hash of their ids."""
    ids = pages.where("html is not null").select(F.col("page_id").cast("long").alias("sample_id")).orderBy(F.xxhash64("sample_id"), "sample_id").limit(sample_pages)
    sample = pages.join(F.broadcast(ids), pages.page_id == ids.sample_id, "left_semi").select("html").limit(sample_pages)
    return learn(r["html"] for r in sample.toLocalIterator())


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shared.value.extract(h) for h in texts(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")
