"""Main text of html pages by composite text density.

The page is read into a tree of block elements with the usual implied ends (p, li, td and so on), whatever is left
unclosed. Elements that are menus, footers, sidebars, forms, scripts, styles or media by their name take no part, nor
does a header outside an article. Of every block the characters, tags, link characters and link tags of its subtree
give its composite density: characters per tag, scaled down by the share of links, relative to the page's.

The block whose children's densities have the greatest sum is the content. All else is judged against the body path,
the blocks from the content up to the body: a block beside it is held against the least density on the path from the
content up to their common ancestor. There must be evidence against a block: outside every article or main element
where the page has them (1/16), a word of its class, id or role that names an advert, menu, sidebar, notice, footer or
reader comments (1/16), or, on pages without article or main, several links and little else (1/4). The block goes if
its density times its evidence is below that threshold; a block without evidence stays, however short. The same
factors weigh the sums that choose the content. Headings and parts of tables carry no such words, and words for headers
count only beside the content.

Text: references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.

Cases: null or empty html gives the empty text; html without tags is one block; an empty table gives none; of equal
sums the first block in page order is the content, and a density equal to its threshold keeps a block; pages of any
length and depth are read whole, in about linear time; repeated ids give a row each. Only the named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import map_columns, table

NAME = "op8_html_text"
ORACLE_SQL = None
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

NAME_START = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
RAW = frozenset("script style noscript template iframe textarea title svg object noembed noframes xmp".split())
DROPPED = RAW | frozenset("nav footer aside form button select dialog menu head canvas audio video fieldset datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input math mi mn mo ms mrow mfrac msup msub msubsup msqrt mroot mtext mspace mstyle mover munder munderover mtable mtr mtd mpadded mphantom menclose semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar complementary footer contentinfo comment comments disqus cookie cookies consent notice notices popup modal".split())
HEADER_HINTS = frozenset("header masthead banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNHINTED = HEADINGS | frozenset("body html main table thead tbody tfoot tr td th caption colgroup figcaption".split())
OUTSIDE, NAMED, LINKS = 1 / 16, 1 / 16, 1 / 4
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


class Node:
    """A block; `parts` holds text and child blocks in page order, None for blocks that take no part."""

    __slots__ = ("tag", "parent", "parts", "depth", "hint", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total", "dropped")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, hint: str = "", inside: bool = False):
        self.tag, self.parent, self.dropped, self.hint, self.inside = tag, parent, dropped, hint, inside
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def hint_of(tag: str, attributes: str) -> str:
    """"named" or "header" where a word of the attributes names something beside the content, else ""."""
    if not attributes or tag in UNHINTED:
        return ""
    words: set[str] = set()
    for match in ATTRIBUTE.finditer(attributes):
        words.update(re.split(r"[\s_-]+", (match[1] or match[2] or match[3] or "").lower()))
    return "named" if not HINTS.isdisjoint(words) else "header" if not HEADER_HINTS.isdisjoint(words) else ""


class Reader:
    """Finds tags in one pass; what has once not been found ahead is not searched for again, so that any input takes linear time."""

    def __init__(self, page: str):
        self.page, self.gone, self.low = page, set(), None

    def find(self, what: str, at: int, low: bool = False) -> int:
        if what in self.gone:
            return -1
        if low and self.low is None:
            self.low = page if len(page := self.page.lower()) == len(self.page) else self.page
        found = (self.low if low else self.page).find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_of_tag(self, at: int) -> int:
        """Place of the > that ends a tag whose name ends at `at`, beyond quoted ones; -1 if there is none."""
        first = end = self.find(">", at)
        while end >= 0:
            part = self.page[at:end]
            quote = min((q for q in (part.find("=\""), part.find("='")) if q >= 0), default=-1)
            if quote < 0:
                return end
            close = self.find(part[quote + 1], at + quote + 2)
            if close < 0:
                return first
            at = close + 1
            if at > end:
                end = self.find(">", at)
        return first


def tree(page: str) -> Node:
    """Parses a page; dropped subtrees leave no nodes."""
    root = node = Node("#page", None, False)
    reader, at, size, links, articles = Reader(page), 0, len(page), 0, 0
    opened: dict[str, list[Node]] = {}

    def up(node: Node) -> Node:
        nonlocal articles
        articles -= node.tag in ("article", "main")
        opened[node.tag].pop()
        return node.parent

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            _text(node, page[at:], links)
            break
        if lt > at:
            _text(node, page[at:lt], links)
        if page.startswith("<!--", lt):
            end = reader.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        match = NAME_START.match(page, lt + 1)
        if match is None and page[lt + 1 : lt + 2] not in ("!", "?"):
            _text(node, "<", links)
            at = lt + 1
            continue
        end = reader.end_of_tag(match.end()) if match else reader.find(">", lt)
        if end < 0:  # a tag cut off by the end of the page
            break
        at = end + 1
        if match is None:
            continue
        tag, attributes = match[2].lower(), page[match.end() : end]
        if match[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and opened.get(tag):
                while node.tag != tag:
                    node = up(node)
                node, links = up(node), 0
            continue
        closed = attributes.endswith("/")
        if tag in RAW and not closed:
            stop = reader.find("</" + tag, at, True)
            close = reader.find(">", stop) if stop >= 0 else -1
            at = close + 1 if close >= 0 else (at if tag in ("svg", "object", "title", "textarea") else size)
            continue
        if tag in INLINE:
            if not node.dropped:
                node.tags += 1
                node.link_tags += tag == "a"
            links += tag == "a"
            if tag == "br":
                _text(node, " ", 0)
            continue
        if tag == "body":
            while node.tag == "head":
                node = up(node)
        if top := _ended(node, tag, opened):
            while node is not top:
                node = up(node)
            node = up(node)
        links = 0
        inside = articles > 0 or tag in ("article", "main")
        child = Node(tag, node, node.dropped or tag in DROPPED or (tag == "header" and not inside), hint_of(tag, attributes), inside)
        if not child.dropped:
            node.parts.append(child)
        elif tag not in ("button", "select", "canvas", "audio", "video"):
            node.parts.append(None)  # where a block was
        if tag not in VOID and not (closed and tag not in ("p", "div", "article", "section", "main", "body")):
            node = child
            opened.setdefault(tag, []).append(child)
            articles += tag in ("article", "main")
    return root


def _ended(node: Node, tag: str, opened: dict[str, list[Node]]) -> Node | None:
    """The open block that an opening tag ends, if any: the innermost that it ends within its list or table; a row ends
    the outermost."""
    if node.tag == "p" or tag in HEADINGS and node.tag in HEADINGS:
        return node
    if tag not in CLOSES:
        return None
    ends, bounds = CLOSES[tag]
    floor = max((opened[x][-1].depth for x in bounds if opened.get(x)), default=-1)
    if tag == "tr":
        found = [stack[k] for x in ends if (stack := opened.get(x)) and (k := bisect_right(stack, floor, key=lambda n: n.depth)) < len(stack)]
        return min(found, key=lambda n: n.depth, default=None)
    found = [opened[x][-1] for x in ends if opened.get(x) and opened[x][-1].depth > floor]
    return max(found, key=lambda n: n.depth, default=None)


def _text(node: Node, text: str, links: int) -> None:
    if not node.dropped:
        node.parts.append(text)
        n = len(text) - text.count(" ")
        node.chars += n
        if links:
            node.link_chars += n


def measured(root: Node) -> list[Node]:
    """Sums up subtrees and sets densities; returns all nodes, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in reversed(node.parts) if type(x) is Node]
    for node in reversed(order):
        for child in node.parts:
            if type(child) is Node:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
    page = root.chars or 1
    share = root.link_chars / page
    for node in order:
        c, t = node.chars, node.tags or 1
        if c:
            lc, lt, rest = node.link_chars, node.link_tags or 1, max(1, c - node.link_chars)
            base = math.log(c / rest * lc + share * c + math.e)
            node.density = c / t * max(0.0, math.log(max(1.0, c / (lc or 1) * t / lt) + 1e-9) / base) if lc else c / t * math.log(max(math.e, c * t)) / base
    for node in order:
        node.total = sum(x.density for x in node.parts if type(x) is Node)
    return order


def menu(chars: int, link_chars: int, link_tags: int) -> bool:
    """Whether text is several links and little else."""
    return link_tags > 1 and 2 * link_chars > chars


def chosen(order: list[Node], marked: bool) -> tuple[Node, dict[int, float]]:
    """The content, and by node id the least density on the path from it up to each block of the body path."""
    weight: dict[int, float] = {}
    for node in order:
        above = weight[id(node.parent)] if node.parent else 1.0
        weight[id(node)] = above * (NAMED if node.hint else 1.0)

    def weighed(value: float, node: Node) -> float:
        return value * weight[id(node)] * (OUTSIDE if marked and not node.inside else 1.0)

    best = max(order, key=lambda x: weighed(x.total, x))
    if not best.total:
        best = max(order, key=lambda x: weighed(x.density, x))
    path, least, node = {}, math.inf, best
    while node is not None:
        least = min(least, node.density)
        path[id(node)] = least
        node = node.parent
    return best, path


def content(root: Node) -> list[str | None]:
    """The texts that belong to the main text, in page order; None where a block begins or ends."""
    order = measured(root)
    marked = any(x.inside for x in order)
    best, path = chosen(order, marked)
    out: list[str | None] = []
    todo: list = [(root, math.inf, False)]
    while todo:
        item = todo.pop()
        if item is None or type(item) is str:
            out.append(item)
            continue
        node, limit, within = item
        on_path = id(node) in path
        if on_path:
            limit = path[id(node)]
        elif not within or node.hint == "named":
            factor = (NAMED if node.hint and not (within and node.hint == "header") else 1.0) * (OUTSIDE if marked and not within and not node.inside else 1.0)
            if not marked and not within and menu(node.chars, node.link_chars, node.link_tags):
                factor *= LINKS
            if factor < 1 and node.density * factor < limit:
                out.append(None)
                continue
        own = True  # text of no block beside the content
        if on_path and node is not best:
            inner = [x for x in node.parts if type(x) is Node]
            own = node.inside if marked else not menu(*(getattr(node, k) - sum(getattr(x, k) for x in inner) for k in ("chars", "link_chars", "link_tags")))
        within = within or node is best or (marked and node.inside)
        todo.append(None)
        for part in reversed(node.parts):
            if type(part) is Node:
                todo.append((part, limit, within))
            elif own or part is None:
                todo.append(part)
        todo.append(None)
    return out


def main_text(page: str) -> str:
    """The main text of a page."""
    blocks: list[str] = []
    run: list[str] = []
    for part in content(tree(page)) if page else ():
        if part is None:
            _block(run, blocks)
        else:
            run.append(part)
    _block(run, blocks)
    return "\n".join(blocks)


def _block(run: list[str], blocks: list[str]) -> None:
    if run:
        text = "".join(run)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            blocks.append(text)
        run.clear()


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length."""

    def run(ids, urls, bodies):
        texts = [main_text(x or "") for x in bodies]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(x) for x in texts]}

    return map_columns(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: main text of every page."""
    return html_text(table(spark, sf_dir, "pages"))
