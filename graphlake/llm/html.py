"""Main text of web pages by tag-path ratios.

A page is read as a run of text nodes, each with its root-to-leaf tag path (element names with
their first class or id). Text length and punctuation are summed over all nodes of a path, so a short
paragraph profits from its longer siblings. The two ratios (characters and marks for each node of
the path) are smoothed over the page order and fused to one score. Names are a prior only: they
scale the score of what lies in navigation, forms, comments and the like, and of what lies outside
the page's article or main element. Nodes whose score reaches a share of the scores' spread and
of the best score are content. Shorter nodes inside the element that holds the content (titles,
list items, captions) join it unless their prior is low.

Time and memory are linear in the page: paths are numbers, elements point to their parents, and
open elements are found by name without walking the stack.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm._common import released, slim

#: Shares of the scores' standard deviation and of the best score that a content node must reach, and the least score.
SPREAD, SHARE, LEAST = 0.5, 0.25, 0.9
#: Share of the content's characters that the container of the content must hold.
COVER = 0.8
#: Priors: names of page furniture, names that may also name a part of an article, text outside the article element.
FURNITURE, DOUBTFUL, OUTSIDE = 1 / 32, 0.5, 0.3
#: Share of a page's characters that its article or main elements must hold to set the prior.
MARKED = 0.25

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noframes", "object", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "caption", "dd", "dt", "li", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "figcaption", "summary"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = {"html", "body", "table", "ul", "ol", "dl", "article", "section", "div", "main", "td", "th", "blockquote", "aside", "nav", "footer", "header", "form", "select"}
_NO_CONTAINER = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre"}
#: Elements, roles and parts of class names of page furniture.
_ELEMENTS = set("nav footer aside form head button select dialog menu canvas audio video".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar widget ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent popup modal newsletter subscribe login signup pagination pager toolbar disqus comment comments replies overlay gdpr copyright".split()
)
#: Parts of class names that stand for furniture or for a part of an article.
_DOUBTS = set("header aside banner notice notification alert share sharing social related recommend recommended recommendations reply respond form search discussion feedback teaser".split())

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"(?:^|(?<=[\s\"'/]))(class|id|role|hidden|aria-hidden)(?![-\w])\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PARTS = re.compile(r"[-_\s\d]+")
_MARKS = re.compile(r"[.,;:!?。，、！？…]")


class Page:
    """Elements of one page in the order of their start tags, as lists: parent, name, prior, path."""

    def __init__(self) -> None:
        self.parent, self.name, self.prior, self.path, self.article = [-1], [""], [1.0], [0], [-1]
        self._paths: dict[tuple[int, str], int] = {}

    def add(self, parent: int, name: str, attributes: str) -> int:
        own, label = self._own_prior(parent, name, attributes)
        self.parent.append(parent)
        self.name.append(name)
        self.prior.append(min(self.prior[parent], own))
        self.path.append(self._paths.setdefault((self.path[parent], label), len(self._paths) + 1))
        self.article.append(len(self.name) - 1 if name in ("article", "main") and own == 1.0 else self.article[parent])
        return len(self.name) - 1

    def _own_prior(self, parent: int, name: str, attributes: str) -> tuple[float, str]:
        prior, label, inside = 1.0, name, self.article[parent] >= 0
        if name in _ELEMENTS or name == "header" and not inside:
            prior = FURNITURE
        if attributes and name not in ("body", "html"):
            for key, *values in _ATTRIBUTE.findall(attributes):
                value, key = next((v for v in values if v), ""), key.lower()
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in _ROLES:
                    prior = FURNITURE
                elif key in ("class", "id"):
                    parts = {x for x in _PARTS.split(_CAMEL.sub("-", value).lower()) if x}
                    parts |= {x for x in _PARTS.split(value.lower()) if x}
                    if label == name and value:
                        label = f"{name}.{value.split()[0] if value.split() else ''}"
                    if parts & _WORDS:
                        prior = FURNITURE
                    # The head of an article holds its title.
                    elif parts & _DOUBTS and not (inside and parts & _DOUBTS == {"header"}):
                        prior = min(prior, DOUBTFUL if inside else FURNITURE)
        return prior, label


def text_nodes(source: str, page: Page) -> Iterator[tuple[int, str | None]]:
    """Text nodes in page order with their elements, which are added to ``page``; None stands for the border of a block."""
    stack = [0]
    at: dict[str, list[int]] = defaultdict(list)
    blocks, scopes = [0], [0]
    place, size, text, quotes = 0, len(source), 0, True

    def cut(k: int) -> None:
        while len(stack) > k:
            at[page.name[stack.pop()]].pop()
        for open_ in (blocks, scopes):
            while open_[-1] >= k:
                open_.pop()

    while True:
        m = _START.search(source, place)
        if m is None:
            break
        begin, place = m.start(), m.end()
        if m.group(1):
            end = source.find("-->", place)
            end = size if end < 0 else end + 3
        else:
            tail = _END.match(source, place) if quotes else None
            if tail is None:
                # Quotes that never end: from here on a tag ends at the next bracket.
                quotes = False
                end = source.find(">", place) + 1
                if not end:
                    break
            else:
                end = tail.end()
        if begin > text:
            yield stack[-1], source[text:begin]
        attributes, place, text = source[place : end - 1], end, end
        name = (m.group(4) or "").lower()
        if not name:
            continue
        if m.group(3):
            if name in _BLOCK:
                yield stack[-1], None
            if at[name] and (name in _BLOCK or at[name][-1] > blocks[-1]):
                cut(at[name][-1])
            continue
        if name in _RAW:
            if not attributes.rstrip().endswith("/") or name in ("script", "style", "textarea", "title"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, place)
                gt = source.find(">", close.end()) if close else -1
                place = text = size if gt < 0 else gt + 1
            continue
        if name in _BLOCK:
            yield stack[-1], None
        if name in _VOID:
            continue
        ends = _SAME.get(name, set()) | ({"p"} if name in _CLOSES_P else set())
        k = max((at[x][-1] for x in ends if at[x]), default=0)
        if k and k >= scopes[-1]:
            cut(k)
        stack.append(page.add(stack[-1], name, attributes))
        at[name].append(len(stack) - 1)
        if name in _BLOCK:
            blocks.append(len(stack) - 1)
        if name in _SCOPE:
            scopes.append(len(stack) - 1)
    if text < size:
        yield stack[-1], source[text:]


def _smooth(x: np.ndarray) -> np.ndarray:
    """Each value, or what its neighbours on both sides lend it if that is more: nothing leaks over the edge of the content."""
    if len(x) < 3:
        return x
    wide = np.concatenate([[0, 0], x, [0, 0]])
    return np.maximum(x, np.minimum((wide[:-4] + 2 * wide[1:-3]) / 3, (2 * wide[3:-1] + wide[4:]) / 3))


def path_scores(path: np.ndarray, size: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The fused score of each node from the characters and marks for each node of its path."""
    path = np.unique(path, return_inverse=True)[1].reshape(-1)
    count = np.bincount(path)
    ratio = (np.bincount(path, size) / count)[path]
    dots = (np.bincount(path, marks) / count)[path]
    return np.sqrt(_smooth(ratio) * (1 + _smooth(dots)))


def _content(score: np.ndarray) -> np.ndarray:
    """Which text nodes the thresholded scores take for content."""
    return score >= max(SPREAD * float(score.std()), SHARE * float(score.max(initial=0)), LEAST)


def _held(page: Page, element: np.ndarray, size: np.ndarray) -> list[float]:
    """Characters of the given nodes inside each element."""
    held = np.bincount(element, size, len(page.name)).tolist()
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    return held


def _container(page: Page, element: np.ndarray, size: np.ndarray) -> int:
    """The innermost element that holds COVER of the content's characters."""
    held = _held(page, element, size)
    best = 0
    for e in range(1, len(held)):
        # A child that holds enough comes after its parent, so the last is the innermost.
        if held[e] >= COVER * held[0] and page.name[e] in _BLOCK and page.name[e] not in _NO_CONTAINER:
            best = e
    return best


def main_text(source: str | None) -> str:
    """The article of one page: blocks in page order, white space runs as one space."""
    if not source:
        return ""
    page = Page()
    nodes: list[tuple[int, str]] = []
    places: list[int | None] = []
    for e, text in text_nodes(source, page):
        text = None if text is None else entities.unescape(text)
        if text is None or not text.strip():
            # White space and borders part words wherever they stand.
            places.append(None)
            continue
        places.append(len(nodes))
        nodes.append((e, text))
    if not nodes:
        return ""
    element = np.array([e for e, _ in nodes])
    size = np.array([len(t.strip()) for _, t in nodes], float)
    marks = np.array([len(_MARKS.findall(t)) for _, t in nodes], float)
    path, prior, article = (np.array(x)[element] for x in (page.path, page.prior, page.article))
    if size[article >= 0].sum() >= MARKED * size.sum():
        prior = np.where(article >= 0, prior, prior * OUTSIDE)
    keep = _content(path_scores(path, size, marks) * prior)
    if keep.any():
        top = _container(page, element[keep], size[keep])
        inside = [False] * len(page.name)
        for e in range(len(inside)):
            inside[e] = e == top or e > 0 and inside[page.parent[e]]
        keep |= np.array(inside)[element] & (prior > DOUBTFUL)
    return " ".join("".join(nodes[k][1] if k is not None and keep[k] else " " for k in places).split())


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Append ``text_col`` and ``n_chars`` (code points) to every row in place of the page source.

    Columns of those names are replaced. A null or empty page gives the empty text, as does one without
    content nodes (only short menus, say). Broken markup is read as browsers do where that matters here;
    a tag that never ends is text. Pages are read whole, each on its own.
    """
    drop = {html_col, text_col, "n_chars"}
    kept = [c for c in pages.columns if c not in drop]
    rows = slim(pages).select(*kept, F.col(html_col).cast("string").alias("__page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [main_text(x.as_py()) for x in part.column("__page")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, text_col, "n_chars"])
        released()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), f"`{text_col}` string", "n_chars long"])
    return rows.mapInArrow(run, schema)
