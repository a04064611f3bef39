"""Main text of web pages by tree scoring.

A page becomes a tree. Menus, page headers, footers, asides, forms, scripts, styles, comments
and elements that name themselves an advert, sidebar, notice or the like are left out. Every
paragraph passes points (one, one for each comma, up to three for its length) to its parent,
half of them to the grandparent and a third to the one above; an element that says it holds
the article starts with some points. A container's points are discounted by the share of its
text that stands in links. The best container, or the article it stands in, is kept, with
those siblings that score near it or read like prose.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object canvas audio video select noframes".split())
#: Of these the ones that may close themselves.
FOREIGN = {"svg", "math"}
DROP = RAW | set("nav footer aside form button fieldset dialog menu head input datalist".split())
BLOCK = set(
    "address article blockquote body caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre search section summary table tbody td tfoot th thead tr ul aside".split()
)
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, and where the search for it stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What an opening block closes if open, and where the search for it stops.
PARAGRAPH_STOPS = set("article section div td th li blockquote body main table".split())
#: Elements within text, which class names never remove.
INLINE = set("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp small strike strong sub sup tt u var h1 h2 h3 h4 h5 h6 body html main article".split())
#: Words of class, id and role that mark what is no part of an article.
UNLIKELY = set(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices alert popup modal overlay newsletter subscribe signup social share sharing related recommended recommendations sidebar sidenav widget widgets
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments disqus reply replies respond
    discussion login search complementary contentinfo alertdialog dialog hidden sr-only paywall teaser teasers""".split()
)
COMMENTS = set("comment comments disqus reply replies respond discussion".split())
LIKELY = set("article body content entry main post story text".split())
#: Words that say nothing where they stand beside others in one name.
NEUTRAL = set("area bar block box button buttons card column container form group icons inner item items left link links list outer panel right section slot top bottom unit wrap wrapper posts stories articles".split())


class Node:
    __slots__ = ("children", "likely", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, likely: bool = False):
        self.tag, self.parent, self.likely = tag, parent, likely
        self.children: list[Node | str] = []
        self.score = 0.0


def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """(unlikely, about comments, likely), by class, id, role and hiding.

    A name of several words, as in cookie-notice, is unlikely if each of them is, or says nothing.
    """
    unlikely = comments = likely = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            unlikely = True
        elif name in ("class", "id", "role"):
            for item in value.split():
                words = set(re.split(r"[^a-z0-9]+", item)) - {""}
                if words & {"has", "no", "with", "without", "is"}:
                    continue
                comments |= bool(COMMENTS & words)
                likely |= bool(LIKELY & words) and not words & UNLIKELY
                unlikely |= item in UNLIKELY or (bool(UNLIKELY & words) and words <= UNLIKELY | NEUTRAL)
    return unlikely, comments, likely


class _Open:
    """The open elements, with the places of each name, so that what a tag closes is found without a walk."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node]] = [("", root)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> Node:
        return self.stack[-1][1]

    def push(self, tag: str, node: Node) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def cut(self, place: int) -> None:
        """Closes the element at this place and all within it."""
        while len(self.stack) > place:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end(self, tag: str) -> None:
        """An end tag; one of an element within text does not reach out of its block."""
        place = self.last({tag})
        if place and (tag in BLOCK or tag in DROP or not self.blocks or self.blocks[-1] < place):
            self.cut(place)

    def start(self, tag: str) -> None:
        """What an opening tag closes."""
        if tag in BLOCK:
            place = self.last({"p"})
            if place > self.last(PARAGRAPH_STOPS):
                self.cut(place)
        if tag in CLOSES:
            what, stops = CLOSES[tag]
            stop = self.last(stops)
            found = [at[k] for t in what if (at := self.places.get(t)) and (k := bisect.bisect_right(at, stop)) < len(at)]
            if found:
                self.cut(min(found))


def tree(page: str) -> Node:
    root = Node("html", None)
    open_ = _Open(root)
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            open_.top().children.append(page[at:])
            break
        if m.start() > at:
            open_.top().children.append(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            open_.top().children.append(m[1])
        if not m[3]:
            continue
        tag, closing, attributes = m[3].lower(), bool(m[2]), m[4]
        if closing:
            open_.end(tag)
            continue
        if tag in RAW:
            if tag in FOREIGN and attributes.rstrip().endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            open_.top().children.append(" " if tag == "br" else Node(tag, open_.top()))
            continue
        open_.start(tag)
        unlikely, comments, likely = _marks(attributes) if attributes else (False, False, False)
        code = bool(open_.places.get("pre"))
        aside = unlikely and tag == "article" and bool(open_.places.get("article"))
        drop = tag in DROP or (not code and ((comments and (tag == "article" or tag not in INLINE)) or (unlikely and tag not in INLINE) or aside))
        node = Node("#drop" if drop else tag, open_.top(), likely)
        open_.top().children.append(node)
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            open_.push(tag, node)
    return root


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in reversed(x.children) if isinstance(c, Node) and c.tag != "#drop"]


def _measure(root: Node) -> dict[int, tuple[int, int, int]]:
    """(text length, length in links, commas) of every kept element, from the leaves up."""
    out: dict[int, tuple[int, int, int]] = {}
    for x in reversed(list(_walk(root))):
        size = linked = commas = 0
        for c in x.children:
            if isinstance(c, str):
                size += len(c.strip())
                commas += c.count(",") + c.count("、") + c.count("，")
            elif c.tag != "#drop":
                a, b, k = out[id(c)]
                size, linked, commas = size + a, linked + b, commas + k
        out[id(x)] = (size, size if x.tag == "a" else linked, commas)
    return out


def _drop_page_headers(root: Node) -> None:
    """Headers outside an article go; inside one only their headings stay."""
    todo = [(root, False)]
    while todo:
        x, inside = todo.pop()
        inside = inside or x.tag in ("article", "main")
        if x.tag == "header":
            if inside:
                x.children = [c for c in _walk(x) if c.tag in HEADING]
            else:
                x.tag, x.children = "#drop", []
            continue
        todo += [(c, inside) for c in x.children if isinstance(c, Node) and c.tag != "#drop"]


#: Tags whose elements are paragraphs, and those that are if enough text stands directly in them.
PARAGRAPHS, CONTAINERS = ("p", "pre", "td", "blockquote", "li", "dd"), ("div", "section", "article", "main")
OWN_CHARS = 25
#: Points that elements start with.
START = {"article": 10, "main": 8, "section": 3, "div": 3, "ul": -3, "ol": -3, "form": -5}
LIKELY_POINTS = 10


def scored(root: Node, measure: dict[int, tuple[int, int, int]]) -> list[Node]:
    """The candidates, in page order; their score holds the points that paragraphs passed to them."""
    order = list(_walk(root))
    candidates: set[int] = set()
    for x in order:
        size, linked, commas = measure[id(x)]
        if x.tag in ("article", "main") and size:
            candidates.add(id(x))
        own = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        if size and (x.tag in PARAGRAPHS or (x.tag in CONTAINERS and own >= OWN_CHARS)):
            points = (1 + commas + min(size / 100, 3)) * (1 - linked / size)
            up = x if x.tag in CONTAINERS else x.parent
            for level in (1, 2, 3):
                if up is None:
                    break
                candidates.add(id(up))
                up.score += points / level
                up = up.parent
    return [x for x in order if id(x) in candidates]


def best_parts(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    _drop_page_headers(root)
    measure = _measure(root)
    candidates = scored(root, measure)
    if not candidates:
        return [root]
    density = lambda x: measure[id(x)][1] / measure[id(x)][0] if measure[id(x)][0] else 1.0
    final = {id(x): (x.score + START.get(x.tag, 0) + LIKELY_POINTS * x.likely) * (1 - density(x)) for x in candidates}
    best = max(candidates, key=lambda x: final[id(x)])
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    best = up or best
    if best.parent is None:
        return [best]
    near = max(10, 0.2 * best.score)
    kept, heading = [], None
    for x in best.parent.children:
        if x is best:
            kept += [heading, x] if heading is not None else [x]
            heading = None
        elif isinstance(x, Node) and x.tag != "#drop" and measure[id(x)][0]:
            # a title right before the container, unless it is the page's own
            heading = x if x.tag in ("h1", "h2") and best not in kept and best.tag != "article" and best.parent.tag not in ("body", "html") else None
            size, d = measure[id(x)][0], density(x)
            prose = best.tag != "article" and x.tag in ("p", "pre", "blockquote") and d < 0.25 and (size > 80 or d == 0)
            if prose or (best.score > 0 and id(x) in final and d < 0.3 and x.score >= near):
                kept.append(x)
    return kept


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "#drop":
            run.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(b for part in best_parts(tree(page)) for b in blocks(part))


def extract(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the column ``to``: each row's main text, blocks joined by line feeds.

    A null or empty page has an empty text; a page without an article the text of its best
    container, or all that isn't left out if there is none. Rows and other columns stay (a column
    named as ``to`` is replaced).
    """

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(main_text)

    return pages.withColumn(to, text_of(F.col(f"`{html}`").cast("string")))
