"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks in a tree of elements. Labelling both, content or boilerplate, has a cost: a linear
classifier over a block's own features (length, closing punctuation, link density, tag) gives its two terminal capacities,
those of calling it boilerplate and of calling it content. Elements have none, but for those that say what they are by tag,
role, class, id or style: menus, footers, adverts, forms, hidden ones and the like are boilerplate, ``article`` and ``main``
are content, and names such as "content" speak for it. Smoothness edges join neighbours in page order (adjacency), and what
an element holds with the element (proximity): content lies in content, at an infinite price, and boilerplate within content
has a price that is higher where the page says that its article is. The minimum cut is the cheapest labelling; so a short
line belongs to the article for its place, and a stretch of short lines and links falls with its element.

Edge cases: null or empty html gives an empty text; html without any markup is one block and is kept; unclosed tags, stray
closing tags and truncated pages are read as far as they go; a page of any length is read whole. Repeated rows give equal
rows, an empty table an empty result, and columns other than ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import by_batch, bytes_of

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)|([^<>]*))>|<[!?][^>]*>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]+)))?""")
_HINTS = frozenset("class id role aria-label itemprop".split())
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select option button audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
_BAD_TAGS = frozenset("nav aside footer form menu fieldset dialog search head".split())
_GOOD_TAGS = frozenset("article main".split())
_BAD_HINT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|menu\w*|nav|navbar|navigation|navi|breadcrumb\w*|sidebar|side|aside|footer|foot|masthead|"
    r"topbar|comment\w*|respond|replies|reply|disqus|discussion|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share\w*|sharing|social|"
    r"related|recommend\w*|widget|pagination|pager|copyright|legal|disclaimer|toolbar|search\w*|form|complementary|contentinfo|skip|tags?|meta|teaser|outbrain|taboola|paywall|toc|table-of-contents|cta|utility)(?=$|[\s_-])",
    re.I,
)
_BAD_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|comment\w*|reply|replies|related|teaser)(?=$|[\s_-])", re.I)
_LAYOUT = re.compile(r"\b(?:has|with|no|without)[_-][\w-]+", re.I)
_HEADER_HINT = re.compile(r"(?:^|[\s_-])(?:header|head|banner|site-title|logo)(?=$|[\s_-])", re.I)
_GOOD_HINT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|main|post|entry|story|text|prose|maincontent)(?=$|[\s_-])", re.I)
_IMPRINT = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
#: An opening tag of the left closes an open one of the right.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}


class Block(NamedTuple):
    text: str
    tag: str
    element: int
    link_chars: int


class Element(NamedTuple):
    """An element that holds blocks: the one around it, and what it says it is."""

    parent: int
    says: str  # "bad", "good" (it is the article), "hint" (its name is that of an article) or ""


class Page(NamedTuple):
    blocks: list[Block]
    elements: list[Element]  # the first is the page


def attributes_of(inside: str) -> list[tuple[str, str]]:
    """Names in lower case and values of the attributes in a tag."""
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(inside)]


def is_hidden(name: str, value: str) -> bool:
    """Whether an attribute hides its element."""
    return name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and bool(_NOT_SHOWN.search(value))


def parse(html: str) -> Page:
    """The text blocks of a page in page order, white space collapsed and character references decoded, and the elements around them."""
    out: list[Block] = []
    elements = [Element(-1, "")]
    #: name, number, and whether it lies in what says that it is the article, or is named so
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    parts: list[str] = []
    link, linked, at, n = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                name, own, _ = stack[-1]
                out.append(Block(text, name, own, min(linked, len(text))))
        linked = 0

    while at < n:
        m = _TOKEN.search(html, at)
        start = m.start() if m else n
        if start > at:
            parts.append(html[at:start])
            if link:
                linked += start - at
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in _RAW:
            if not m[1] and not (m[3] or m[4] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at) if name not in _ENDS else _ENDS[name].search(html, at)
                at = end.end() if end else (n if name in ("script", "style", "textarea", "title") else at)
            continue
        if name == "a":
            link = 0 if m[1] else 1
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK:
            flush()
            link = 0
            if m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                continue
            if stack[-1][0] == "p":
                stack.pop()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _CLOSES.get(name, ()):
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table"):
                    break
            if name in _VOID:
                continue
            _, around, inside = stack[-1]
            attributes = m[3] or m[4]
            says = "good" if name in _GOOD_TAGS else "bad" if name in _BAD_TAGS else ""
            header = name == "header"
            if attributes and name not in ("html", "body"):
                for key, hint in attributes_of(attributes):
                    if is_hidden(key, hint):
                        says = "bad"
                    if key not in _HINTS or says == "bad":
                        continue
                    if (_BAD_ARTICLE if name in _GOOD_TAGS else _BAD_HINT).search(_LAYOUT.sub("", hint)):
                        says = "bad"
                    elif _HEADER_HINT.search(hint):
                        header = True
                    elif not says and _GOOD_HINT.search(hint):
                        says = "good" if key == "role" or key == "itemprop" else "hint"
            if header and not inside and says != "good":
                says = "bad"
            # an element that says nothing and holds text alone is told by the one around it
            if says or name not in _LEAVES:
                elements.append(Element(around, says))
                around = len(elements) - 1
            stack.append((name, around, inside or says in ("good", "hint")))
    flush()
    return Page(out, elements)


_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre caption figcaption summary legend address".split())
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in _RAW}


_TAG = {"p": 0.3, "pre": 0.3, "blockquote": 0.3, "h1": 0.8, "h2": 0.4, "h3": 0.3, "li": -0.1, "td": -0.1}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def score(b: Block) -> float:
    """What a block says for itself: above 0 for content."""
    words = b.text.count(" ") + 1
    out = min(words, 40) / 20.0 - 0.9  # long runs of prose are content
    if b.text[-1] in ".!?:;\"')»”":
        out += 0.4
    out += _TAG.get(b.tag, 0.0) - (1.0 if b.tag in _HEADINGS else 3.0) * b.link_chars / len(b.text)
    if words < 25 and _IMPRINT.match(b.text):
        out -= 2.5
    return out


#: Price of content within boilerplate: no labelling that pays it is ever the cheapest.
NEVER = 1e6


class Weights(NamedTuple):
    """Capacities of the smoothness edges, and how much speaks against what lies outside of a page's article."""

    adjacency: float = 0.3  # neighbours in page order; as much again within one element
    proximity: float = 0.35  # boilerplate within an element that is content
    named: float = 1.2  # the same where the element, or one around it, is named as an article is
    article: float = 2.4  # the same within the article
    outside_named: float = 2.5
    outside_article: float = 5.0
    hint: float = 1.5  # terminal capacity of an element named as an article is


WEIGHTS = Weights()
NO_EDGES = Weights(0.0, 0.0, 0.0, 0.0)


def min_cut(n: int, net: list[float], edges: list[tuple[int, int, float, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut. ``net`` is a node's capacity from the source less that to the sink; an edge (a, b, x, y) costs x if a alone is on the source's side, y if b alone is.

    A node whose terminal capacity exceeds what its edges can cost has its side already, and its edges become terminal
    capacities of its neighbours; what this leaves is solved by maximum flow along shortest augmenting paths, level by level.
    """
    net = list(net)
    to: list[dict[int, float]] = [{} for _ in range(n)]  # capacity from a node to another
    for a, b, x, y in edges:
        if a != b:
            to[a][b] = to[a].get(b, 0.0) + x
            to[b][a] = to[b].get(a, 0.0) + y
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if side[v] is not None:
            continue
        if net[v] >= sum(to[v].values()):
            side[v] = True
        elif -net[v] >= sum(to[u][v] for u in to[v]):
            side[v] = False
        else:
            continue
        for u in to[v]:
            net[u] += to[v][u] if side[v] else -to[u][v]
            del to[u][v]
            todo.append(u)
        to[v] = {}
    rest = [v for v in range(n) if side[v] is None]
    if rest:
        _max_flow(rest, net, to, side)
    return [bool(x) for x in side]


def _max_flow(rest: list[int], net: list[float], to: list[dict[int, float]], side: list[bool | None]) -> None:
    eps, S, T = 1e-9, -1, -2
    cap: dict[int, dict[int, float]] = {v: dict(to[v]) for v in rest}
    cap[S], cap[T] = {}, {}
    for v in rest:
        if net[v] > 0:
            cap[S][v], cap[v][S] = net[v], 0.0
        elif net[v] < 0:
            cap[v][T], cap[T][v] = -net[v], 0.0
    while True:
        level, queue = {S: 0}, deque([S])
        while queue:
            v = queue.popleft()
            for u, c in cap[v].items():
                if c > eps and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if T not in level:
            break
        left = {v: iter(list(cap[v])) for v in level}
        path = [S]
        while path:  # blocking flow
            v = path[-1]
            if v == T:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                cut = 0
                for i, (a, b) in reversed(list(enumerate(zip(path, path[1:])))):
                    cap[a][b] -= flow
                    cap[b][a] += flow
                    if cap[a][b] <= eps:
                        cut = i
                del path[cut + 1 :]
                left[path[-1]] = iter(list(cap[path[-1]]))
                continue
            for u in left[v]:
                if cap[v][u] > eps and level.get(u) == level[v] + 1:
                    path.append(u)
                    break
            else:
                level[v] = -9
                path.pop()
    for v in rest:
        side[v] = v in level


def graph(page: Page, w: Weights = WEIGHTS) -> tuple[list[int], list[float], list[tuple[int, int, float, float]]]:
    """The cut's nodes, their net capacities and edges. Nodes are blocks (numbers from 0) and elements (-1 - number), without those whose label an infinite edge gives away: what lies in boilerplate is boilerplate, what holds the article is content."""
    elements = page.elements
    bad, good, named = ([False] * len(elements) for _ in range(3))
    for i, e in enumerate(elements):
        up = e.parent
        bad[i] = e.says == "bad" or up >= 0 and bad[up]
        good[i] = not bad[i] and (e.says == "good" or up >= 0 and good[up])
        named[i] = not bad[i] and (e.says == "hint" or up >= 0 and named[up])
    held = [i for i, b in enumerate(page.blocks) if not bad[b.element]]
    any_good, any_named = any(good[page.blocks[i].element] for i in held), any(named[page.blocks[i].element] for i in held)
    content = {0}  # the page, the article and what is around it
    for i, e in enumerate(elements):
        if e.says == "good" and not bad[i]:
            while i not in content:
                content.add(i)
                i = elements[i].parent
    inner: list[int] = []
    seen = set(content)
    for i in held:
        e = page.blocks[i].element
        while e not in seen:
            seen.add(e)
            inner.append(e)
            e = elements[e].parent
    nodes = [-1 - e for e in sorted(inner)] + held
    at = {x: i for i, x in enumerate(nodes)}
    net, edges = [0.0] * len(nodes), []
    pull = lambda e: w.article if good[e] else w.named if named[e] else w.proximity
    for i, x in enumerate(nodes):
        e = page.blocks[x].element if x >= 0 else -1 - x
        if x >= 0:
            net[i] = score(page.blocks[x])
            if any_good and not good[e]:
                net[i] -= w.outside_article
            elif not any_good and any_named and not named[e]:
                net[i] -= w.outside_named
            around = e
        else:
            net[i] = w.hint if elements[e].says == "hint" else 0.0
            around = elements[e].parent
        if around in content:
            net[i] += pull(around)
        else:
            edges.append((i, at[-1 - around], NEVER, pull(around)))
    for a, b in zip(held, held[1:]):
        c = w.adjacency * (2 if page.blocks[a].element == page.blocks[b].element else 1)
        if c:
            edges.append((at[a], at[b], c, c))
    return nodes, net, edges


def content_blocks(html: str, weights: Weights = WEIGHTS) -> list[str]:
    """The page's blocks that the cut labels content."""
    page = parse(html)
    if len(page.blocks) == 1 and len(page.elements) == 1 and page.blocks[0].tag == "":
        return [page.blocks[0].text]
    nodes, net, edges = graph(page, weights)
    return [page.blocks[x].text for x, s in zip(nodes, min_cut(len(nodes), net, edges)) if s and x >= 0]


def main_text(html: str, weights: Weights = WEIGHTS) -> str:
    """The content blocks, joined by blank lines."""
    return "\n\n".join(content_blocks(html, weights))


def extract_pages(pages: DataFrame, weights: Weights = WEIGHTS) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``. No shuffle."""

    def each(b):
        texts = [main_text(x.decode("utf-8", "replace"), weights) for x in b.column(2).to_pylist()]
        return {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    kind = pages.schema["page_id"].dataType.simpleString()
    return by_batch(pages.select("page_id", "url", bytes_of("html").alias("html")), each, f"page_id {kind}, url string, text string, n_chars long")
