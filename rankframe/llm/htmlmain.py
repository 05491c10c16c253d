"""Main-text extraction: sum-product message passing on the tree of a page's block elements.

Every block element is a binary node (content or not).  A node's own evidence is a weighted sum of
features, a parent and a child share a 2 x 2 potential.  Messages go up from the leaves and down from
the root, level by level over all pages of a batch, and yield each node's content marginal; the
weights are fitted by maximum likelihood on labelled pages.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankframe.llm.common import add_by_text

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_BEGUN = re.compile(r"</?[a-zA-Z]")
_AFTER_NAME = re.compile(r"[\s/>]")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# HTML's element names by their role in a page.
RAW = {"script", "style", "template", "noscript", "svg", "iframe", "object", "textarea", "select", "title", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder",
          "munderover", "mfenced", "menclose", "mpadded", "mphantom", "mstyle", "merror", "mtable", "mtr", "mtd", "mmultiscripts", "mprescripts"}
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
GROUPS = [{"article", "main"}, {"section"}, {"div"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"nav", "menu"},
          {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "input", "dialog"}, {"table", "tbody", "thead", "tr", "td", "th"},
          {"blockquote", "pre"}, {"figure", "figcaption"}, {"html", "body", "#page"}]
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "body", "text", "main", "prose"}
OTHER_WORDS = [{"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promotion", "sponsor", "sponsored"},
               {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "toolbar", "topbar"},
               {"footer", "foot", "copyright", "legal", "contentinfo", "header", "masthead", "top", "logo"},
               {"sidebar", "side", "aside", "widget", "related", "recommended", "trending", "popular", "complementary", "teaser", "more"},
               {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "dialog", "warning", "message"},
               {"comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "thread"},
               {"share", "social", "newsletter", "subscribe", "signup", "login", "search", "form", "register", "follow"}]
MAIN, ASIDE = GROUPS[0], set().union(*GROUPS[7:12])
N_FEATURES = len(GROUPS) + 2 + len(OTHER_WORDS) + 11


@dataclass
class Page:
    """Block elements in page order (node 0 is the page) and the runs of text in them."""
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[set] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


class Scanner:
    """Finds the tags, comments and declarations of a page without reading any part of it again and again.

    A tag that is begun but never ended makes one match run to the end of the page; from then on the
    ends are looked up in a table of the page's quotes and angle brackets, made once.
    """

    def __init__(self, source: str):
        self.source, self.last, self.marks, self.after_name, self.missing = source, source.rfind(">") + 1, None, -1, set()

    def _tabulate(self) -> None:
        """Where an unquoted ``>`` follows from each quote or bracket on, outside (0) and inside of either quotes."""
        source = self.source
        self.marks = [m.start() for m in re.finditer("[>\"']", source)]
        n = len(self.marks)
        self.ends = [[-1] * (n + 1) for _ in range(3)]
        plain, single, double = self.ends
        for k in range(n - 1, -1, -1):
            c = source[self.marks[k]]
            plain[k] = self.marks[k] if c == ">" else single[k + 1] if c == "'" else double[k + 1]
            single[k] = plain[k + 1] if c == "'" else single[k + 1]
            double[k] = plain[k + 1] if c == '"' else double[k + 1]

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(begin, end, "/" of an end tag, name, attributes) of the next tag from ``at`` on; comments have no name."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if self.marks is None or source.startswith(("<!", "<?"), at):
                if m := _TAG.match(source, at):
                    return at, m.end(), m.group(1) or "", m.group(2) or "", m.group(3) or ""
                if _BEGUN.match(source, at):
                    self._tabulate()
            elif m := _BEGUN.match(source, at):
                if self.after_name < m.end():
                    after = _AFTER_NAME.search(source, m.end())
                    self.after_name = after.start() if after else len(source)
                end = self.ends[0][bisect_left(self.marks, self.after_name)]
                if end >= 0:
                    return at, end + 1, "/" if m.end() - at == 3 else "", source[m.end() - 1:self.after_name], source[self.after_name:end]
            at += 1
        return None

    def search(self, pattern: str, at: int) -> re.Match | None:
        """The next match of a pattern that ends with ``>``; a pattern that once had none is not searched again."""
        if pattern in self.missing:
            return None
        found = re.compile(pattern, re.I).search(self.source, at, max(at, self.last))
        if not found:
            self.missing.add(pattern)
        return found


def parse(source: str) -> Page:
    """Elements and text of a page; malformed markup closes as browsers do for paragraphs, list items and cells."""
    page, stack, open_, links, buffer = Page(), [], {}, 0, []

    def push(tag: str, attributes: str) -> None:
        words = set()
        if attributes:
            for _, v in _ATTR.findall(attributes):
                words.update(_WORDS.findall(_CAMEL.sub(" ", v).lower()))
        page.parent.append(stack[-1] if stack else -1)
        page.depth.append(len(stack))
        page.tag.append(tag)
        page.words.append(words)
        page.linked.append(0)
        stack.append(len(page.tag) - 1)
        open_[tag] = open_.get(tag, 0) + 1

    def pop() -> None:
        open_[page.tag[stack.pop()]] -= 1

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                page.runs.append((stack[-1], text))

    def text(raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            buffer.append(raw)
            if links:
                page.linked[stack[-1]] += len(raw)

    push("#page", "")
    at, scanner = 0, Scanner(source)
    while found := scanner.next(at):
        begin, end, closes, name, attributes = found
        text(source[at:begin])
        at, tag = end, name.lower()
        if not tag:
            continue
        if closes:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and tag not in VOID:
                flush()
                if open_.get(tag):
                    while page.tag[stack[-1]] != tag:
                        pop()
                    pop()
            continue
        if tag in RAW:
            flush()
            if tag == "head":
                inside = scanner.search(r"</head\s*>|<body(?:\s[^>]*)?>", at)
                at = at if not inside else inside.start()
                if inside is None:
                    continue
            else:
                ends = scanner.search(f"</{re.escape(tag)}[^>]*>", at)
                at = ends.end() if ends else len(source) if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        flush()
        while len(stack) > 1 and (top := page.tag[stack[-1]]) in CLOSED_BY and (CLOSED_BY[top] is None or tag in CLOSED_BY[top]):
            pop()
        push(tag, attributes)
        links = 0
    begun = _BEGUN.search(source, at)  # a tag without end
    text(source[at:begun.start() if begun else len(source)])
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """Of each node: element group, words of class, id and role, its own text, and where it stands:
    inside or outside of the page's article elements, inside what is named like an aside, and the
    share of the page's text that its parent's children hold."""
    n = len(page.tag)
    x, chars, runs, stops = np.zeros((n, N_FEATURES)), np.zeros(n), np.zeros(n), np.zeros(n)
    for node, t in page.runs:
        chars[node] += len(t)
        runs[node] += 1
        stops[node] += t.count(". ") + t.count(", ") + t.endswith((".", "!", "?"))
    for i, (tag, words) in enumerate(zip(page.tag, page.words)):
        group = next((g for g, names in enumerate(GROUPS) if tag in names), len(GROUPS))
        x[i, group] = 1
        if words:
            x[i, len(GROUPS) + 1] = bool(words & CONTENT_WORDS)
            for g, names in enumerate(OTHER_WORDS):
                x[i, len(GROUPS) + 2 + g] = bool(words & names)
    at = len(GROUPS) + 2 + len(OTHER_WORDS)
    x[:, at] = 1
    x[:, at + 1] = np.log1p(chars) / 5
    x[:, at + 2] = chars > 120
    x[:, at + 3] = np.minimum(1, np.array(page.linked) / np.maximum(chars, 1))
    x[:, at + 4] = stops > 0
    x[:, at + 5] = np.log1p(stops) / 2
    x[:, at + 6] = chars == 0
    other = x[:, len(GROUPS) + 2:at].any(1) | np.array([t in ASIDE for t in page.tag])
    main, aside, held = np.array([t in MAIN for t in page.tag]) & ~other, other.copy(), np.zeros(n)
    for i in range(1, n):
        up = page.parent[i]
        main[i] |= main[up]
        aside[i] |= aside[up]
        held[up] += chars[i]
    x[:, at + 7] = main
    x[:, at + 8] = ~main & main.any()
    x[:, at + 9] = aside
    x[1:, at + 10] = (held / max(chars.sum(), 1))[np.array(page.parent[1:], np.int64)]
    return x


@dataclass
class TreeModel:
    weights: np.ndarray  # N_FEATURES: evidence for content
    edge: np.ndarray  # 2 x 2: parent's state, child's state

    def passes(self, x: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Content marginal of each node, and each node's joint marginal with its parent (zero for roots)."""
        belief = np.zeros((len(x), 2))
        belief[:, 1] = x @ self.weights
        up, order = np.zeros((len(x), 2)), np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        layers = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for layer in reversed(layers[1:]):
            up[layer] = np.logaddexp(belief[layer, None, 0] + self.edge[:, 0], belief[layer, None, 1] + self.edge[:, 1])
            np.add.at(belief, parent[layer], up[layer])
        joint = np.zeros((len(x), 2, 2))
        for layer in layers[1:]:
            above = belief[parent[layer]] - up[layer]
            both = above[:, :, None] + self.edge[None] + belief[layer][:, None, :]
            belief[layer] += np.logaddexp(above[:, 0, None] + self.edge[0], above[:, 1, None] + self.edge[1])
            both = np.exp(both - both.max((1, 2), keepdims=True))
            joint[layer] = both / both.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def forest(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents, depths of all nodes of pages, and where each page's nodes begin."""
    starts = np.cumsum([0, *[len(p.tag) for p in pages]])
    parent = np.concatenate([np.array(p.parent) + s * (np.array(p.parent) >= 0) for p, s in zip(pages, starts)])
    return np.concatenate([features(p) for p in pages]), parent, np.concatenate([p.depth for p in pages]), starts


def fit(pages: list[Page], labels: list[list[int]], steps: int = 300, decay: float = 1e-3) -> TreeModel:
    """Maximum likelihood: observed minus expected features and parent-child pairs, by Adam."""
    x, parent, depth, _ = forest(pages)
    y = np.concatenate(labels).astype(float)
    inner = parent >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[inner]].astype(int), y[inner].astype(int)), 1)
    model, observed = TreeModel(np.zeros(N_FEATURES), np.zeros((2, 2))), x.T @ y
    first, second = [np.zeros(N_FEATURES), np.zeros((2, 2))], [np.zeros(N_FEATURES), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        p, joint = model.passes(x, parent, depth)
        grads = [(observed - x.T @ p) / len(pages) - decay * model.weights, (seen - joint[inner].sum(0)) / len(pages) - decay * model.edge]
        for value, g, m, v in zip((model.weights, model.edge), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return model


def texts(model: TreeModel, sources: list[str]) -> list[str]:
    """Content of each page: the runs of text in nodes that are content with even odds or better, joined by one space."""
    pages = [parse(s) for s in sources]
    x, parent, depth, starts = forest(pages)
    p, _ = model.passes(x, parent, depth)
    return [" ".join([t for node, t in page.runs if p[s + node] >= 0.5]) for page, s in zip(pages, starts)]


def extract(pages: DataFrame, model: TreeModel, html_col: str = "html", out: str = "text", keep_html: bool = True) -> DataFrame:
    """``pages`` with their main text (and without the markup, unless ``keep_html``).

    A null or empty page, or one without content, gives an empty text; repeated rows get equal
    texts; a column named like the new one is replaced; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def start():
        return lambda sources: [pa.array(texts(shared.value, [s or "" for s in sources.to_pylist()]), pa.string())]

    return add_by_text(pages, html_col, {out: "string"}, start, keep_text=keep_html)
