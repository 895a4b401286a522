"""Main text of web pages by composite text density.

A page is parsed to a tree. Every node has its characters C, tags T, link characters
LC and link tags LT; with NLC = C - LC its density is

    C / T * log(C * T / (LC * LT)) / log(log(C / NLC * LC + LCb / Cb * C + e))

(zero T, LC, LT and NLC taken as one under a fraction, and an inner logarithm of one as
e, where a page has no links), so many links pull a node down. A node's density sum
is the sum of its children's densities. The node with the largest density sum is
found, and the least density on its path up to the body becomes the threshold. Of
every node at least that dense the subtree of largest density sum is main content,
with the article or main element, or else the block, that holds it. The text is what
these subtrees show in page order, without scripts, styles, hidden parts and markup.

Tags and names (navigation, header, footer, form, notice, advert, sidebar, reader
comments) are hints, not verdicts: elements they speak against are left out of the
measurement only where an article or main element stands beside them, or else where
they hold less than most of the page's text outside links.

White space in a block becomes one space, blocks are joined in page order by one
space, and character references are decoded. A null, empty or textless page has the
empty text. Malformed markup does not fail: unclosed elements close with their
parent, stray end tags are passed over, and cut-off tags are dropped. Long pages are
read whole, in time linear in their length; the tree is walked without recursion, so
depth is no limit.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilgrid.llm.common import map_texts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?|["']""")
#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br td th tr tbody thead tfoot legend option optgroup body html head".split())
#: Elements that never show page text, and those that mostly hold something else.
NEVER = frozenset("script style noscript template head title meta link iframe object embed svg math canvas input button select option textarea label audio video map".split())
BESIDE = frozenset("nav header footer aside menu dialog form fieldset".split())
CONTAINERS, TITLES = frozenset(["article", "main"]), frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that hint at what is not content.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead sidebar aside widget notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments disqus replies reply respond discussion related recommended recommendations pagination pager toolbar toc copyright "
    "disclaimer legal skip alert complementary contentinfo search searchbox dialog form".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Doubts about an element, by part of a name or by a whole name, and the parts of the page's text that settle them in its favour.
WEAK, STRONG = 1, 2
SHARES = {WEAK: 0.5, STRONG: 0.9}
_SPACES = re.compile(r"\s+")
_CLOSED = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_SCOPE = {"p": frozenset(["article", "section", "div", "body", "td", "th", "li", "blockquote", "main", "aside", "nav", "footer", "header", "form", "html", "button"]), "li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table", "tbody", "thead", "tfoot"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}


class Node:
    __slots__ = ("tag", "parent", "children", "wanted", "doubt", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, wanted: bool = True, doubt: int = 0):
        self.tag, self.parent, self.wanted, self.doubt = tag, parent, wanted, doubt
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _attributes(text: str) -> Iterator[tuple[str, str]]:
    """Names in lower case with their values; what stands inside a value is no name."""
    for name, value in _ATTRIBUTE.findall(text):
        if name:
            quote = value[:1] if value[:1] in ("'", '"') else ""
            yield name.lower(), value[1:].removesuffix(quote) if quote else value


def _judged(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element can be shown at all, and the doubt that it is content."""
    if tag in NEVER:
        return False, 0
    doubt = STRONG if tag in BESIDE else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return True, doubt
    for name, value in _attributes(attributes):
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return False, 0
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return False, 0
        elif name == "itemprop":
            if value.lower() in ("comment", "comments"):
                doubt = STRONG
        elif name in ("class", "id", "role") and tag not in ("html", "body", "main", "h1"):
            if any(w.lower() in UNWANTED for w in value.split()):
                doubt = STRONG
            elif any(w.lower() in UNWANTED for w in _WORDS.findall(value)):
                doubt = max(doubt, WEAK)
    return True, doubt


def _settle(root: Node) -> None:
    """Decide about elements that names or tags speak against.

    Where an article or main element with text stands free of doubt, doubtful elements
    go, unless they hold such an element. Elsewhere they stay if they hold most of the
    page's text outside links. A header with a title inside an article or main element
    is its own.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if type(c) is not str and c.wanted)
    if not any(n.doubt for n in order):
        return
    size: dict[int, int] = {}
    titled, free, inside, linked, holds = set(), {id(root): True}, set(), set(), set()
    for node in order[1:]:  # parents come first
        up = id(node.parent)
        if up in linked or node.tag == "a":
            linked.add(id(node))
        if up in inside or node.tag in CONTAINERS and not node.doubt:
            inside.add(id(node))
    for node in reversed(order):
        n = size.get(id(node), 0) + (0 if id(node) in linked else sum(len(c.strip()) for c in node.children if type(c) is str))
        size[id(node)] = n
        if node.parent is not None:
            up = id(node.parent)
            size[up] = size.get(up, 0) + n
            if node.tag in TITLES or id(node) in titled:
                titled.add(up)
    for node in order[1:]:
        if node.tag == "header" and node.doubt and id(node) in titled and id(node.parent) in inside:
            node.doubt = 0
        free[id(node)] = free[id(node.parent)] and not node.doubt
    real = [n for n in order if n.tag in CONTAINERS and not n.doubt and size[id(n)]]
    for node in real:
        while node is not None and id(node) not in holds:
            holds.add(id(node))
            node = node.parent
    sure = any(free[id(n)] for n in real)
    for node in order:
        if node.doubt:
            share = size[id(node)] > SHARES[node.doubt] * size[id(root)]
            node.wanted = id(node) in holds or not sure and share


class _Open:
    """The open elements, and for every tag the places where it is open."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def nearest(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags: frozenset, scope: frozenset) -> None:
        """Close the nearest element of ``tags``, unless one of ``scope`` is nearer."""
        at = self.nearest(tags)
        if at and at >= self.nearest(scope - tags):
            self.cut(at)

    def end(self, tag: str) -> bool:
        """An end tag; an inline one closes no block that opened inside its element."""
        at = self.nearest((tag,))
        if at and (tag in BLOCK or not self.blocks or self.blocks[-1] < at):
            self.cut(at)
            return True
        return False


def parse(page: str) -> Node:
    """The page's tree; text is held as strings with references decoded. Time is linear in the page."""
    root = Node("#root", None)
    open_ = _Open(root)
    at, size, last, endless = 0, len(page), max(page.rfind("<"), page.rfind(">")), set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            open_.nodes[-1].children.append(entities.unescape(page[at:lt]))
        if lt == size:
            break
        found = _TOKEN.match(page, lt)
        if not found:
            # a sign that opens no tag is text, unless the page is cut off in a tag
            if lt == last and (lt + 1 == size or page[lt + 1] in "/" or page[lt + 1].isalpha()):
                break
            open_.nodes[-1].children.append("<")
            at = lt + 1
            continue
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            if not open_.end(tag) and tag == "br":
                open_.nodes[-1].children.append(Node("br", open_.nodes[-1]))
            continue
        if found[4] != ">":
            break  # cut off inside a tag
        if tag in CLOSES_P and tag != "p":
            open_.close(_CLOSED["p"], _SCOPE["p"])
        if tag in _CLOSED:
            open_.close(_CLOSED[tag], _SCOPE[tag])
        node = open_.nodes[-1]
        made = Node(tag, node, *_judged(tag, found[3]))
        node.children.append(made)
        if tag in VOID or found[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style", "title", "textarea"):
                break
            else:
                endless.add(tag)
            made.wanted = False
            continue
        open_.push(made)
    _settle(root)
    return root


def _measure(root: Node) -> tuple[Node, list[Node]]:
    """Count characters and tags of wanted parts, then densities; returns the body and all nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if type(c) is not str and c.wanted)
    for node in reversed(order):
        own = sum(len("".join(c.split())) for c in node.children if type(c) is str)
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + (node.tag not in ("br", "wbr"))
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            continue
        plain = max(1, c - node.link_chars)
        base = math.log(c / plain * node.link_chars + share * c + math.e)
        node.density = c / t * (math.log(max(c * t / (lc * lt), 1.0000001)) / math.log(max(base, 1.0000001) + 1e-9) if base > 1 + 1e-9 else math.log(max(c * t / (lc * lt), 1.0000001)))
    for node in order:
        if node.parent is not None:
            node.parent.total += node.density
    return body, order


def _shown(top: Node) -> str:
    """The text of a subtree: blocks joined by one space, white space inside a block made one space."""
    blocks, now, stack = [], [], [top]
    while stack:
        node = stack.pop()
        if type(node) is str:
            now.append(node)
            continue
        if node is None or not node.wanted:
            if node is None:
                blocks.append("".join(now))
                now = []
            continue
        if node.tag in BLOCK:
            blocks.append("".join(now))
            now = []
            stack.append(None)
        stack.extend(reversed(node.children))
    blocks.append("".join(now))
    return " ".join(x for x in (_SPACES.sub(" ", b).strip() for b in blocks) if x)


def main_nodes(page: str) -> list[Node]:
    """The subtrees of the page's main content in page order, none inside another; empty without any text."""
    body, order = _measure(parse(page))
    if not body.chars:
        return []
    held = {id(body)}
    inside = [body]
    for node in order:
        if node.parent is not None and id(node.parent) in held and node.chars:
            held.add(id(node))
            inside.append(node)
    # the subtree of largest density sum at or below each node, the outer one of equals
    fullest = {id(n): n for n in inside}
    for node in reversed(inside):
        if fullest[id(node)].total <= node.total:
            fullest[id(node)] = node
        if node is not body and fullest[id(node)].total >= fullest[id(node.parent)].total:
            fullest[id(node.parent)] = fullest[id(node)]
    threshold, up = body.density, fullest[id(body)]
    while up is not body:
        threshold = min(threshold, up.density)
        up = up.parent
    # the outermost article or main element around a node, or else the nearest block
    whole: dict[int, Node] = {}
    for node in inside:
        up = whole.get(id(node.parent))
        whole[id(node)] = up if up and (up.tag in CONTAINERS or node.tag not in BLOCK) else node
    chosen = {id(whole[id(fullest[id(n)])]) for n in inside if n.density >= threshold}
    out, stack = [], [body]
    while stack:
        node = stack.pop()
        if id(node) in chosen:
            out.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if type(c) is not str and id(c) in held)
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    return " ".join(filter(None, map(_shown, main_nodes(page))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points, a row per page; repeated rows stay, other columns are not read."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [extract(x) for x in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(x) for x in texts]}).astype({"n_chars": "int64"})

    return map_texts(pages.select("page_id", "url", "html"), each, schema)
