"""Main text of a web page by tag-path ratios.

Every text node lies on a root-to-leaf tag path, menus and adverts like any other. Per path the length of its text and
its punctuation are summed and divided by its nodes, the two ratios are fused, and each node takes its path's value,
smoothed over its neighbours in page order. The nodes of paths that are above a threshold then are content. With a path's content stay all blocks
on paths that begin like it, short ones too (a paragraph's headings, lists and captions), and what an article or main
element around it holds; what lies elsewhere goes, whatever it is called. Of what stays, that goes whose element or
class names it a menu, a notice, a form, reader comments and so on.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import table

#: Elements without an end tag, whose text is not markup, that start a block, and whose text is none.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("script style head title noscript template iframe object embed svg math canvas audio video map button input select option optgroup datalist textarea label noembed noframes xmp".split())
#: Elements that are no part of an article.
APART = frozenset("form nav footer aside menu dialog".split())
#: Words of class, id and role that mark boilerplate.
MARKS = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola tags teaser toc toolbar topbar widget widgets".split())
#: Blocks that hold a run of text, not an article.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote caption figcaption figure td th tr ul ol dl table tbody".split())
#: Elements that close an open p, and which siblings end an element left open.
ENDS_P = BLOCK - {"br", "body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
PUNCTUATION = re.compile(r"[.,;:!?…，。；：！？、]")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARKED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HEADER = re.compile(r"(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(?:header|banner)\b", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', data, ''), ('start', tag, attributes) and ('end', tag, '') of markup as it is found, in linear time."""
    at, n, last, tag = 0, len(page), page.rfind(">"), _TAG
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = end + 3 if end >= 0 else n
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1 or n
        elif m := tag.match(page, lt):
            name, at = m[2].lower(), m.end()
            yield ("end" if m[1] else "start"), name, m[3]
            if not m[1] and name in RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                end = close.start() if close else n
                at = end
        elif tag is _TAG and _LOOSE.match(page, lt):
            tag = _LOOSE  # quotes that don't close: from here a tag ends at the next >
            at = lt
        else:
            yield "text", "<", ""
            at = lt + 1


def _marked(name: str, attributes: str) -> bool:
    """Whether an element says itself that it is no part of an article."""
    if name in APART:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in _MARKED.finditer(attributes):
        if not MARKS.isdisjoint(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower())):
            return True
    return bool(_HIDDEN.search(attributes))


class Block(NamedTuple):
    """path: number of its tag path; element: number of the innermost element that holds it; marked: in boilerplate."""

    text: str
    path: int
    element: int
    marked: bool


class _Open(NamedTuple):
    """An open element. silent: its text is none; marked: it or one around it is boilerplate; block: the place of the
    innermost block among the open elements, itself included; apart: whether that block is marked; article: in one."""

    name: str
    element: int
    path: int
    silent: bool
    marked: bool
    block: int
    apart: bool
    article: bool


_ROOT = _Open("", 0, 0, False, False, -1, False, False)


class _Page:
    """Blocks of text, with the tree of elements as numbers in page order: ``parent`` and ``names``."""

    def __init__(self, page: str) -> None:
        self.blocks: list[Block] = []
        self.names, self.parent = [""], [0]
        self.paths: dict[tuple[int, str], int] = {}  # (path above, element) -> path, which has a higher number
        self._open: list[_Open] = []
        self._where: dict[str, list[int]] = defaultdict(list)  # places of open elements by name
        held: list[str] = []
        at = _ROOT

        def flush() -> None:
            nonlocal held
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip() if held else ""
            if text:
                self.blocks.append(Block(text, at.path, at.element, at.marked))
            held = []

        for kind, data, more in _events(page):
            top = self._open[-1] if self._open else _ROOT
            if kind == "text":
                if not top.silent and top.marked == top.apart:  # an inline element may be boilerplate inside a block
                    if not held or at is _ROOT or not "".join(held).strip():
                        at = top
                    held.append(data)
                continue
            if data in BLOCK:
                flush()
            if kind == "start":
                if data not in VOID:
                    self._start(data, more)
            elif self._where.get(data):
                self._shut(self._where[data][-1])
        flush()
        self._shut(0)

    def _start(self, name: str, attributes: str) -> None:
        if name in ENDS_P and self._open and (b := self._open[-1].block) >= 0 and self._open[b].name == "p":
            self._shut(b)
        if name in ENDS:
            nearest = lambda some: max((self._where[x][-1] for x in some if self._where.get(x)), default=-1)
            shut, stop = map(nearest, ENDS[name])
            if shut > stop:
                self._shut(shut)
        up = self._open[-1] if self._open else _ROOT
        block = name in BLOCK
        header = (name == "header" or bool(_HEADER.search(attributes))) and not up.article
        marked = up.marked or header or _marked(name, attributes)
        path = self.paths.setdefault((up.path, name), len(self.paths) + 1) if block else up.path
        place = len(self._open)
        self._open.append(_Open(name, len(self.names), path, up.silent or name in NEVER, marked, place if block else up.block, marked if block else up.apart, up.article or name in ("article", "main")))
        self._where[name].append(place)
        self.names.append(name)
        self.parent.append(up.element)

    def _shut(self, place: int) -> None:
        while len(self._open) > place:
            self._where[self._open.pop().name].pop()


def _smoothed(values: list[float], spread: float = 1.0) -> list[float]:
    reach = 2
    weights = [math.exp(-(i**2) / (2 * spread**2)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        some = [(values[i + j], w) for j, w in zip(range(-reach, reach + 1), weights) if 0 <= i + j < len(values)]
        out.append(sum(v * w for v, w in some) / sum(w for _, w in some))
    return out


def path_ratios(blocks: list[Block]) -> dict[int, float]:
    """Of each tag path: characters a node, times one more than punctuation marks a node."""
    length, marks, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for text, path, _, _ in blocks:
        length[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        nodes[path] += 1
    return {p: length[p] / nodes[p] * (1 + marks[p] / nodes[p]) for p in nodes}


def extract(page: str, share: float = 0.5, ratios=path_ratios, named: bool = True) -> str:
    """The article's blocks, one a line; empty if a page has no text but boilerplate.

    Nodes are content on paths whose smoothed ratio is, on average, at least ``share`` of that of all nodes. For tests, other ``ratios``, and with
    ``named`` off, no element or class counts as boilerplate by its name, and none as the article.
    """
    parsed = _Page(page)
    blocks = parsed.blocks if named else [b._replace(marked=False) for b in parsed.blocks]
    if not blocks:
        return ""
    of_path = ratios(blocks)
    scores = _smoothed([of_path[b.path] for b in blocks])
    threshold = share * sum(scores) / len(scores)
    total, nodes = defaultdict(float), defaultdict(int)
    for b, s in zip(blocks, scores):
        total[b.path] += s
        nodes[b.path] += 1
    content = [total[b.path] >= threshold * nodes[b.path] and not b.marked for b in blocks]
    if not any(content):  # all that the ratios choose is boilerplate by name
        content = [not b.marked for b in blocks]
    return "\n".join(b.text for b, k in zip(blocks, _kept(parsed, blocks, content, named)) if k)


def _kept(parsed: _Page, blocks: list[Block], content: list[bool], named: bool) -> list[bool]:
    """Which blocks stay: those that go with the content and aren't marked."""
    held = [False] * (len(parsed.paths) + 1)  # by path: whether it holds content, or one above it does
    up = [(0, "")] + list(parsed.paths)
    for b, c in zip(blocks, content):
        if c:
            held[up[b.path][0] if up[b.path][1] in LEAF else b.path] = True
    for x in range(1, len(held)):
        held[x] = held[x] or held[up[x][0]]
    inside = [0] * len(parsed.names)  # by element: content in it
    for b, c in zip(blocks, content):
        inside[b.element] += c
    for x in range(len(inside) - 1, 0, -1):
        inside[parsed.parent[x]] += inside[x]
    article = [False] * len(inside)
    for x in range(1, len(article)):
        article[x] = article[parsed.parent[x]] or named and parsed.names[x] in ("article", "main") and inside[x] > 0
    return [not b.marked and (held[b.path] or article[b.element]) for b in blocks]


OUT = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page's whole html; n_chars counts code points.

    Null or empty html gives an empty text. Rows are independent: ties and repeated rows come out as often as they
    are, other columns are left out, an empty table gives an empty table. A very long or deep page takes time and
    memory in proportion to its length. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, OUT)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
