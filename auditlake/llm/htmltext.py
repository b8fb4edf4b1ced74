"""HTML main text by sum-product inference on the DOM tree.

A page becomes a tree of elements. Each element has a hidden state: furniture (menus, adverts, comments, ...), content, or
wrapper (what surrounds both). Features of the element (tag, each name of class, id and role and its parts, length of its
own text, share of link text) give it a likelihood under each state; a potential connects each parent's state with the
child's, one table for containers and one for elements of text. Messages passed up and down the tree give exact
marginals. All tables are counts over labelled pages: those that say with <article> or <main> where their text is.
Tags that are never text (nav, aside, form, ...) are observed as furniture; names that say so are evidence.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, SAMPLE_CHARS = 2000, 200_000
#: Possessive, so that no piece of a page is read more than a few times, whatever is left open in it. An unfinished tag
#: ends at the next "<" or with the page; quotes count only after "=".
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?=[^A-Za-z]))[^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(?:>|(?=<)|\Z)",
    re.S,
)
NAMES = re.compile(r"(?:^|[\s/\"'])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
MAX_DEPTH = 512  # as in browsers: what is nested deeper becomes a child of the element at that depth; no text is lost
# Element names of the HTML standard by how they take part in text.
RAW = {"script", "style", "head", "title", "iframe", "template", "textarea", "select", "noscript"}
HEAD_TAGS = {"head", "title", "meta", "link", "style", "script", "base", "noscript", "template"}  # any other ends the head, whose end tag may be left out
TEXT_ONLY = {"script", "style", "textarea", "title", "iframe"}
VOID = {"area", "base", "col", "embed", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "mrow", "msub", "msup", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | dict.fromkeys(ENDS_P, ("p",))
CONTAINERS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "html", "body", "aside", "nav", "footer", "header", "blockquote"}
# Tags and names that say that an element is no part of a page's text, and names that say it is.
FURNITURE_TAGS = {"nav", "aside", "footer", "form", "button", "dialog", "menu"}
FURNITURE_NAMES = {
    "ad", "ads", "advert", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "form",
    "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
HEADER_NAMES = {"header", "banner", "masthead"}  # furniture of the page, but not within its text
NEUTRAL_PARTS = {"area", "articles", "bar", "block", "bottom", "box", "container", "global", "inner", "item", "items", "left", "links", "list", "page", "panel", "posts", "right", "section", "site", "slot", "stories", "thread", "top", "unit", "wrap", "wrapper"}
TEXT_NAMES = {"article", "main"}
TOLD_ABOUT = {"section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "figure", "table", "pre", "dl", "li", "a", "b", "i", "em", "strong", "code", "dfn", "cite"}
NAME_ODDS = 1e9  # how much likelier a name like furniture's is on furniture: more than a dozen paragraphs outweigh
FURNITURE, CONTENT, WRAPPER = range(3)
#: What the transition tables believe before any page is counted, with the weight of PRIOR_ROWS elements of each state.
PRIOR_ROWS = 20.0
TO_CONTAINER = np.array([[0.995, 0.001, 0.004], [0.03, 0.97, 0.0], [0.5, 0.3, 0.2]])
TO_TEXT = np.array([[0.998, 0.002, 0.0], [0.03, 0.97, 0.0], [0.6, 0.35, 0.05]])


class Node:
    __slots__ = ("tag", "names", "parent", "items", "own", "whole", "linked", "index", "block")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None, index: int):
        self.tag, self.names, self.parent, self.index = tag, names, parent, index
        self.items: list[str | Node] = []
        self.own = self.whole = self.linked = 0  # characters of text: of the block, of all that is inside, of all links inside
        self.block: Node = parent.block if parent is not None and tag in INLINE else self  # the element that decides for its text


def parse(page: str) -> list[Node]:
    """Elements in page order, the root first. Unclosed and stray tags are mended the way browsers mend the common ones.

    The time grows in proportion to the page.
    """
    root = Node("#root", (), None, 0)
    nodes, stack, scopes, at, size = [root], [root], [0], 0, len(page)
    opened: dict[str, list[int]] = defaultdict(list)
    too_deep: Counter = Counter()

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            opened[tag].pop()
            if tag in CONTAINERS:
                scopes.pop()

    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            if stack[-1].tag == "head" and not page[at:end].isspace():
                close(opened["head"][-1])
            stack[-1].items.append(page[at:end])
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        tag = name.lower()
        if m.group(1):
            if too_deep[tag]:
                too_deep[tag] -= 1
            elif opened[tag] and (tag not in INLINE or opened[tag][-1] > scopes[-1]):
                close(opened[tag][-1])
            continue
        if tag not in HEAD_TAGS and opened["head"]:
            close(opened["head"][-1])
        if tag == "br" or tag == "hr":
            if tag == "hr" and opened["p"] and opened["p"][-1] > scopes[-1]:
                close(opened["p"][-1])
            stack[-1].items.append(Node(tag, (), stack[-1], -1))
            continue
        if tag in VOID:
            continue
        ends = max((opened[c][-1] for c in CLOSES.get(tag, ()) if opened[c]), default=0)
        if ends > scopes[-1]:
            close(ends)
        attributes, names = m.group(3), ()
        if attributes and not attributes.isspace():
            names = tuple(sorted({w for groups in NAMES.findall(attributes) for w in (groups[0] or groups[1] or groups[2]).lower().split()}))
        now = stack[-1]
        node = Node(tag, names, now, len(nodes))
        nodes.append(node)
        now.items.append(node)
        if tag in TEXT_ONLY:
            closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(page, at)
            at = closing.end() if closing else size
        elif attributes.endswith("/") and tag in ("svg", "math", "path", "circle", "rect", "use"):
            pass
        elif len(stack) > MAX_DEPTH:
            too_deep[tag] += 1
        else:
            opened[tag].append(len(stack))
            if tag in CONTAINERS:
                scopes.append(len(stack))
            stack.append(node)
    for node in reversed(nodes):
        here = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        node.own += here
        node.whole += here
        if node.tag == "a":
            node.linked = node.whole
        up = node.parent
        if up is not None:
            up.whole += node.whole
            up.linked += node.linked
            if node.tag in INLINE:
                up.own += node.own
    return nodes


def _says(names: tuple[str, ...], words: set[str]) -> bool:
    """Whether a whole name is one of the words, alone or together with parts that say nothing (comment-list)."""
    for name in names:
        if name in words:
            return True
        parts = set(PARTS.findall(name))
        if parts & words and parts <= words | NEUTRAL_PARTS:
            return True
    return False


def observed(nodes: list[Node]) -> tuple[list[bool], list[bool], list[int]]:
    """(furniture, named, marked) of each element: whether its tag says that it is furniture, whether its name does, and
    whether it is in (1) or holds (2) the part that the page itself marks as its text.

    Within that part, the name of a section, a heading or a paragraph says nothing: it is named for what it tells about.
    """
    furniture, named, marked = [False] * len(nodes), [False] * len(nodes), [0] * len(nodes)
    for node in nodes[1:]:
        i, up = node.index, node.parent.index
        inside = marked[up] == 1
        furniture[i] = node.tag in FURNITURE_TAGS or not inside and node.tag == "header"
        telling = node.names and not (inside and node.tag in TOLD_ABOUT)
        named[i] = bool(telling and (_says(node.names, FURNITURE_NAMES) or not inside and _says(node.names, HEADER_NAMES)))
        marked[i] = int(inside or not furniture[i] and not named[i] and (node.tag in TEXT_NAMES or not TEXT_NAMES.isdisjoint(node.names)))
    for node in reversed(nodes[1:]):
        if marked[node.index] and not furniture[node.index] and not named[node.index] and marked[node.parent.index] != 1:
            marked[node.parent.index] = 2
    for i, m in enumerate(marked):
        if m == 2:  # what surrounds the marked text is no furniture, whatever its name
            furniture[i] = named[i] = False
    return furniture, named, marked


def self_labels(nodes: list[Node]) -> list[int] | None:
    """The state of each element of a page that marks its text, else None."""
    furniture, named, marked = observed(nodes)
    if 1 not in marked:
        return None
    labels = [WRAPPER] * len(nodes)
    for node in nodes[1:]:
        i = node.index
        gone = furniture[i] or named[i] or labels[node.parent.index] == FURNITURE and marked[i] != 2
        labels[i] = FURNITURE if gone else (FURNITURE, CONTENT, WRAPPER)[marked[i]]
    return labels


def _features(node: Node) -> tuple:
    """What tells about an element: tag, length of own text, share of link text, names."""
    return node.tag, min(8, node.own.bit_length()), 4 * node.linked // node.whole if node.whole else 9, node.names


def _split(features: tuple) -> list[str]:
    tag, length, linked, names = features
    # tag and length are taken with the share of links: a list of links says nothing about a list of text
    return [f"t:{tag} {linked}", f"n:{length} {linked}", *[f"c:{n}" for n in names], *{f"p:{p}" for n in names for p in PARTS.findall(n) if p != n}]


@dataclass
class DomModel:
    seen: dict[str, np.ndarray]  # how often a feature was seen in each state
    states: np.ndarray  # elements of each state
    container: np.ndarray  # P(child's state | parent's state)
    text: np.ndarray
    known: dict = field(default_factory=dict, repr=False)

    def likelihood(self, features: tuple) -> tuple[float, float, float]:
        """In proportion to P(features | state), the largest is 1. Kept for each combination met, up to a bound."""
        got = self.known.get(features)
        if got is None:
            logs = np.zeros(3)
            for f in _split(features):
                if f in self.seen:
                    logs += np.log((self.seen[f] + 0.5) / (self.states + 1))
            got = tuple(np.exp(np.maximum(logs - logs.max(), -60.0)).tolist())
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[features] = got
        return got

    def marginals(self, nodes: list[Node], furniture: list[bool], named: list[bool]) -> list[float]:
        """P(content) of each element by messages up and down the tree, given whose tag is furniture's; names like furniture's are evidence."""
        n, tables = len(nodes), {k: tuple(map(tuple, t.tolist())) for k, t in ((True, self.container), (False, self.text))}
        up = [(1.0, 0.0, 0.0) if furniture[node.index] else self.likelihood(_features(node)) for node in nodes]
        up = [(f, c / NAME_ODDS, w / NAME_ODDS) if named[i] else (f, c, w) for i, (f, c, w) in enumerate(up)]
        up[0] = (0.0, 0.0, 1.0)
        pair = [tables[node.tag in CONTAINERS] for node in nodes]
        message = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b, c = up[i]
            (p, q, r), (s, t, u), (v, w, x) = pair[i]
            m0, m1, m2 = p * a + q * b + r * c, s * a + t * b + u * c, v * a + w * b + x * c
            top = max(m0, m1, m2) or 1.0
            m0, m1, m2 = max(m0 / top, 1e-9), max(m1 / top, 1e-9), max(m2 / top, 1e-9)
            message[i] = (m0, m1, m2)
            j = nodes[i].parent.index
            d, e, f = up[j]
            d, e, f = d * m0, e * m1, f * m2
            top = max(d, e, f) or 1.0
            up[j] = (d / top, e / top, f / top)
        down, out = [(1.0, 1.0, 1.0)] * n, [0.0] * n
        for i in range(n):
            if i:
                j = nodes[i].parent.index
                (a, b, c), (d, e, f), (g, h, k) = up[j], down[j], message[i]
                a, b, c = a * d / g, b * e / h, c * f / k
                (p, q, r), (s, t, u), (v, w, x) = pair[i]
                d, e, f = a * p + b * s + c * v, a * q + b * t + c * w, a * r + b * u + c * x
                top = max(d, e, f) or 1.0
                down[i] = (d / top, e / top, f / top)
            (a, b, c), (d, e, f) = up[i], down[i]
            whole = a * d + b * e + c * f
            out[i] = b * e / whole if whole else 0.0
        return out


def train(pages: list[str]) -> DomModel:
    """Counts over the pages that mark their text. Without any, common text and link tags stand for content and furniture."""
    seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
    states, pairs = np.zeros(3), {True: PRIOR_ROWS * TO_CONTAINER, False: PRIOR_ROWS * TO_TEXT}
    for page in pages:
        nodes = parse(page)
        labels = self_labels(nodes)
        for node in nodes[1:] if labels else ():
            y = labels[node.index]
            states[y] += 1
            for f in _split(_features(node)):
                seen[f][y] += 1
            pairs[node.tag in CONTAINERS][labels[node.parent.index], y] += 1
    if not states.any():
        states += 20
        for kinds, state in ((("p 0", "p 1", "h1 0", "h2 0", "pre 0", "article 0"), CONTENT), (("a 4", "li 4"), FURNITURE), (("body 0", "html 0"), WRAPPER)):
            for kind in kinds:
                seen[f"t:{kind}"][state] += 20
    container, text = (pairs[k] / pairs[k].sum(axis=1, keepdims=True) for k in (True, False))
    return DomModel(dict(seen), states, container, text)


def main_text(page: str | None, model: DomModel) -> str:
    """The blocks of text whose elements are content, in page order, joined by newlines."""
    if not page:
        return ""
    nodes = parse(page)
    furniture, named, _ = observed(nodes)
    content = [m > 0.5 for m in model.marginals(nodes, furniture, named)]
    blocks: list[list[str]] = [[]]
    stack: list = [(nodes[0], iter(nodes[0].items))]
    while stack:
        node, items = stack[-1]
        for item in items:
            if isinstance(item, str):
                if content[node.block.index]:
                    blocks[-1].append(item)
                continue
            if item.tag == "br" or item.tag == "hr":
                blocks.append([]) if item.tag == "hr" else blocks[-1].append("\n")
                continue
            if item.tag in RAW or furniture[item.index] or named[item.index] and not content[item.index]:
                continue  # with all that is inside
            if item.tag not in INLINE:
                blocks.append([])
            stack.append((item, iter(item.items)))
            break
        else:
            stack.pop()
            if node.tag not in INLINE:
                blocks.append([])
    texts = (SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks if b)
    return "\n".join(t for t in texts if t)


def fit(pages: DataFrame, page: str = "html", rows: int = SAMPLE_PAGES, max_chars: int = SAMPLE_CHARS) -> DomModel:
    """Trains on at most `rows` pages of at most max_chars characters, those whose texts have the smallest hashes."""
    short = pages.select(F.col(page).alias("html"), F.xxhash64(page).alias("h")).where(F.length("html") <= max_chars)
    picked = short.select("h").distinct().orderBy("h").limit(rows)
    texts = short.join(F.broadcast(picked), "h").groupBy("h").agg(F.min("html").alias("html"))
    return train([r["html"] for r in texts.orderBy("h").collect()])


def extracted(pages: DataFrame, into: str = "_text", page: str = "html") -> DataFrame:
    """pages with the main text of the column `page` in the column `into`; a column of that name is replaced, others stay.

    Null and empty pages, and pages without content, give ''. Repeated pages give equal texts; an empty table
    gives no rows. Pages are never cut, and the time for one grows in proportion to its length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, page))

    @F.pandas_udf("string")
    def extract(texts: pd.Series) -> pd.Series:
        return pd.Series([main_text(t, shared.value) for t in texts], dtype=object)

    return pages.withColumn(into, extract(F.col(page)))
