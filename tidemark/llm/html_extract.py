"""HTML extraction by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier gives each block a cost for being content and one for being boilerplate;
these are the capacities to the two terminals. Blocks that follow each other, and blocks with a near common ancestor, are joined
by edges that make different labels cost something. The maximum flow separates content from boilerplate.

The costs have two parts. What markup says (elements and class names of menus, footers, adverts and so on, an element for the main
content) weighs by `MARKUP`, which is fixed. What the text looks like (links, length, sentence marks) weighs by a logistic
regression, whose labels are the blocks that semantic markup names and whose features are those of the text alone; it is fitted
on a bounded sample of pages (`SAMPLE_PAGES`, picked by a hash of the id, of at most SAMPLE_PAGE_CHARS characters; longer ones are
extracted like others), and a normal prior around `PRIOR` keeps it sensible where a sample shows a feature too rarely.

Null and empty pages, and those without text, give an empty text and 0 characters. Very long and deeply nested pages take time in
proportion. Repeated rows are extracted each; a cut of equal cost keeps what the source reaches. An empty table gives no rows.
Columns named text and n_chars are replaced; others may stay under any name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, byte_texts, extend

SAMPLE_PAGES = 300
SAMPLE_PAGE_CHARS = 100_000
#: Edge capacities, in the unit of the classifier's log-odds.
ADJACENT = 0.6
NEAR = 1.2

_TAG_BEGIN, _NAME_END, _SPECIAL = re.compile("</?[a-zA-Z]"), re.compile(r"[\s/>]"), re.compile("[\"'>]")
#: Elements whose inside isn't markup, or no text of the page; without an end tag only the first two reach to the end of the page.
_RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title")
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "object", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "img", "wbr", "input", "br"}
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
_FENCE = {"ul": {"li", "dt", "dd"}, "ol": {"li", "dt", "dd"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th"}}
_BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "select"}
#: Inside the main content, names on these elements style text and don't make it boilerplate.
_TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "figcaption"}
_CONTENT_TAGS = {"article", "main"}
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|banner|footer|foot|sidebar|side|aside|widget|related|recommend\w*|promo\w*|sponsor\w*|ads?|advert\w*|advertisement|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|search|share|sharing|social|comments?|commentlist|disqus|replies|respond|pagination|pager|toolbar|complementary|contentinfo|dialog|form|copyright|legal|tags?|skip)(?:$|[\s_-])",
    re.I,
)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|content|story|main|body|text)(?:$|[\s_-])", re.I)

#: What the markup of a block says, and what it weighs in log-odds.
MARKUP_FEATURES = ("boiler", "content", "content_class", "outside_main")
MARKUP = np.array([-9.0, 7.0, 2.0, -2.0])
FEATURES = ("one", "link_share", "log_words", "sentence_marks", "heading", "list_item", "few_words")
#: Means of the prior of the text's weights, in the order of FEATURES.
PRIOR = np.array([0.0, -4.0, 0.8, 1.0, 0.6, -0.6, -0.8])


class Block:
    __slots__ = ("parent", "parts", "linked", "text", "marks")

    def __init__(self, parent: int, marks: tuple):
        self.parent, self.marks, self.parts, self.linked, self.text = parent, marks, [], 0, ""


class Tags:
    """Ends of tags and of elements without markup in a page, each found in time that adds up to the page's length: what a search found,
    or didn't find, is remembered for those that begin later."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self._next: dict[re.Pattern, tuple[int, int]] = {}  # a search's begin and what it found
        self._hopeless: set[int] = set()  # quotes from which on no tag ends
        self._unclosed: set[str] = set()

    def find(self, what: re.Pattern, at: int) -> int:
        """The first place from `at` on; behind the page if there is none."""
        begin, found = self._next.get(what, (0, -1))
        if not begin <= at <= found:
            m = what.search(self.html, at)
            found = m.start() if m else len(self.html)
            self._next[what] = at, found
        return found

    def tag(self, at: int) -> tuple[int, int, int] | None:
        """(begin of the name, its end, place of the tag's >) of the tag that begins at `at`; quoted values may hold anything."""
        m = _TAG_BEGIN.match(self.html, at) if at <= self.last else None
        if m is None:
            return None
        name = self.find(_NAME_END, m.end())
        end, seen = self.find(_SPECIAL, name), []
        while True:
            if end < len(self.html) and self.html[end] == ">":
                return m.end() - 1, name, end
            if end == len(self.html) or end in self._hopeless:
                break
            seen.append(end)
            close = self.html.find(self.html[end], end + 1)
            if close < 0:
                break
            further = _SPECIAL.search(self.html, close + 1)  # a quote is passed once in vain
            end = further.start() if further else len(self.html)
        self._hopeless.update(seen)
        return None

    def after_element(self, tag: str, at: int) -> int | None:
        """Behind the end tag of an element that began before `at`; None if there is none."""
        if tag not in self._unclosed and at <= self.last:
            m = re.compile(f"</{tag}\\b", re.I).search(self.html, at)
            if m and m.end() <= self.last:
                return self.html.find(">", m.end()) + 1
        self._unclosed.add(tag)
        return None


class Page:
    """Blocks with text in page order, the parent and depth of each block-level element, and whether one is for the main content."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.parents, self.depths, self.has_main = [0], [0], False  # element 0 is the page
        self._stack: list[tuple[str, int, tuple]] = []  # tag, block-level element, (boilerplate, content, content class, last block tag)
        self._open: dict[str, list[int]] = {}  # places in the stack by tag
        self._read(html)
        kept = []
        for b in self.blocks:
            b.text = " ".join(unescape("".join(b.parts)).split())
            if b.text:
                kept.append(b)
        self.blocks = kept

    def _close(self, k: int) -> None:
        while len(self._stack) > k:
            tag, _, _ = self._stack.pop()
            self._open[tag].pop()

    def _top(self) -> tuple[int, tuple]:
        return self._stack[-1][1:] if self._stack else (0, (False, False, False, ""))

    def _shut(self, tag: str) -> None:
        """End tags that a start tag implies, but for elements outside of the list or table that holds it."""
        shut = _CLOSES.get(tag, {"p"})
        fence = max((at[-1] for name, held in _FENCE.items() if shut & held and (at := self._open.get(name))), default=-1)
        first = [at[i] for name in shut if (at := self._open.get(name)) and (i := bisect_right(at, fence)) < len(at)]
        if first:
            self._close(min(first))

    def _read(self, html: str) -> None:
        block, at, end, tags = None, 0, len(html), Tags(html)
        while at < end:
            if html[at] == "<":
                if html.startswith("<!--", at):
                    close = html.find("-->", at + 4)
                    at = close + 3 if close >= 0 else end
                    continue
                if html[at + 1 : at + 2] in ("!", "?") and at < tags.last:
                    at = html.find(">", at) + 1
                    continue
                found = tags.tag(at)
                stop = at + 1 if found is None else found[2] + 1
            else:
                found, stop = None, html.find("<", at)
                stop = end if stop < 0 else stop
            text, begin, at = html[at:stop], at, stop
            if found is None:
                if block is None:
                    block = Block(*self._top())
                    self.blocks.append(block)
                block.parts.append(text)
                if self._open.get("a"):
                    block.linked += len(text)
                continue
            tag, attributes = html[found[0] : found[1]].lower(), html[found[1] : found[2]]
            if html[begin + 1] == "/":
                if tag not in _INLINE:
                    block = None
                if self._open.get(tag):
                    self._close(self._open[tag][-1])
                continue
            if tag in _RAW and not attributes.endswith("/"):
                close = tags.after_element(tag, at)
                if close or tag in ("script", "style"):
                    at = close or end
                    if tag not in ("script", "style", "textarea"):
                        block = None
                    continue
            if tag not in _INLINE:
                block = None
            elif tag == "br" and block is not None:
                block.parts.append(" ")
            if tag in _VOID or tag in _RAW:
                continue
            if tag not in _INLINE:
                self._shut(tag)
            self._push(tag, attributes)

    def _push(self, tag: str, attributes: str) -> None:
        element, (boiler, content, of_class, last) = self._top()
        names = ""
        for a in _ATTR.finditer(attributes):
            name, value = a[1].lower(), (a[2] or "").strip("\"'")
            if name in ("class", "id", "role"):
                names += " " + value
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                boiler = True
        styled = tag in ("html", "body", "article", "main") or content and (tag in _TEXT_TAGS or tag in _INLINE or tag == "header")
        if tag in _BOILER_TAGS or tag == "header" and not content or names and not styled and _BOILER.search(names):
            boiler = True
        if tag in _CONTENT_TAGS or "role" in attributes and " main" in names:
            content = self.has_main = True
        if names and _CONTENT.search(names):
            of_class = True
        if tag not in _INLINE:
            self.parents.append(element)
            self.depths.append(self.depths[element] + 1)
            element = len(self.parents) - 1
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, element, (boiler, content, of_class, last if tag in _INLINE else tag)))

    def distance(self, a: int, b: int) -> int:
        """Steps between two elements over their nearest common ancestor."""
        steps = 0
        while a != b:
            if self.depths[a] >= self.depths[b]:
                a = self.parents[a]
            else:
                b = self.parents[b]
            steps += 1
        return steps


def markup_of(page: Page) -> np.ndarray:
    rows = [(boiler, content and not boiler, of_class and not boiler, page.has_main and not content) for boiler, content, of_class, _ in (b.marks for b in page.blocks)]
    return np.array(rows, float).reshape(-1, len(MARKUP_FEATURES))


def features_of(page: Page) -> np.ndarray:
    x = np.zeros((len(page.blocks), len(FEATURES)))
    for i, b in enumerate(page.blocks):
        tag = b.marks[3]
        words = b.text.count(" ") + 1
        raw = sum(map(len, b.parts)) or 1
        marks = sum(map(b.text.count, ".!?,;:"))
        x[i] = (1, b.linked / raw, np.log(words) / 2, min(1.0, 5 * marks / words), tag in ("h1", "h2", "h3"), tag == "li", words < 4)
    return x


def fit_weights(x: np.ndarray, content: np.ndarray, prior: np.ndarray = PRIOR, spread: float = 1.0) -> np.ndarray:
    """Logistic regression with a normal prior, by Newton's steps."""
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (content - p) - (w - prior) / spread**2
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def edges_of(page: Page) -> list[tuple[int, int, float]]:
    """Adjacent blocks, and blocks and the last one before under the same parent; nearer ancestors bind more."""
    edges, last = [], {}
    for i, b in enumerate(page.blocks):
        if i:
            edges.append((i - 1, i, ADJACENT + NEAR / (1 + page.distance(b.parent, page.blocks[i - 1].parent))))
        parent = page.parents[b.parent]
        if (k := last.get(parent, i)) < i - 1:
            edges.append((k, i, NEAR / 3))
        last[parent] = i
    return edges


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node against its score's sign costs its absolute value, an edge between labels its weight.

    Dinic's algorithm; nodes with a positive score hang on the source, those with a negative one on the sink. True: content.
    """
    n = len(score)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, there: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(there)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(score):
        if s > 0:
            link(source, i, s, 0.0)
        elif s < 0:
            link(i, sink, -s, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        depth = [-1] * (n + 2)
        depth[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > 1e-9 and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[sink] < 0:
            return [d >= 0 for d in depth[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[a] < len(heads[a]):
                e = heads[a][tried[a]]
                if room[e] > 1e-9 and depth[to[e]] == depth[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                tried[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1


def extract(html: str, weights: np.ndarray) -> str:
    page = Page(html)
    if not page.blocks:
        return ""
    score = (markup_of(page) @ MARKUP + features_of(page) @ weights).tolist()
    if all(s > 0 for s in score):
        keep = [True] * len(page.blocks)
    else:
        keep = min_cut(score, edges_of(page))
    return "\n".join(b.text for b, k in zip(page.blocks, keep, strict=True) if k)


def fit(pages: DataFrame, key: str = "page_id", html: str = "html") -> np.ndarray:
    """The text's weights, from the blocks of a bounded sample of pages that semantic markup labels."""
    short = pages.where(F.col(html).isNotNull() & (F.length(html) <= SAMPLE_PAGE_CHARS))
    sample = bounded_sample(short, key, SAMPLE_PAGES).select(F.col(html).alias("html")).limit(2 * SAMPLE_PAGES).collect()
    xs, ys = [], []
    for row in sample:
        page = Page(row["html"])
        for b, x in zip(page.blocks, features_of(page), strict=True):
            if b.marks[0] or b.marks[1]:
                xs.append(x)
                ys.append(not b.marks[0])
    return fit_weights(np.array(xs), np.array(ys, float)) if xs else PRIOR


def html_text(pages: DataFrame, weights: np.ndarray, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages with text and n_chars (code points); columns of these names are replaced."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [extract(raw.decode("utf-8", "replace"), weights) for raw in byte_texts(batch.column(html))]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return extend(pages, html, {"text": "string", "n_chars": "bigint"}, run, keep)
