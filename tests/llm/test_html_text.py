"""Hand-made pages with known main texts."""

import html
import math
import random
import re

import pytest

from helixframe.llm import html_text
from helixframe.llm.common import table
from tests.llm.common import SF, sf_folder, with_clash

P1, P2, P3 = ("A first paragraph of the article that is long enough to count as running text, with commas." , "The second one follows it and tells more, also at some length, so that density is high.", "Third and last, it ends the article in a calm and orderly way after many words.")
MENU = "<ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(8)) + "</ul>"

CASES = {
    "article": (f"<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav>{MENU}</nav><article><h1>Head</h1><p>{P1}<p>{P2}</article><footer>&copy; site</footer></body></html>", ["Head", P1, P2]),
    "divs": (f"<body><div class='nav'>{MENU}</div><div id=x><h1>Head</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div class='sidebar'><p>{P2}</p></div></body>", ["Head", P1, P2, P3]),
    "references": (f"<article><p>{P1} &lt;b&gt; &amp;amp; &#233; &nbsp; x</p></article>", [P1 + " <b> &amp; é x"]),
    "comments": (f"<main><article><p>{P1}</p><p>{P2}</p></article><section class='comments'><p>{P3}</p></section></main>", [P1, P2]),
    "unclosed": (f"<body><article><p><b>{P1}<br><p>{P2}<ul><li>one<li>two</ul><!-- no --></article>", [P1, P2, "one", "two"]),
    "table": (f"<article><table><tr><td>{P1}<td>{P2}<tr><td>c</table></article>", [P1, P2, "c"]),
    "advert": (f"<article><p>{P1}</p><div class='ad'>buy now</div><p>{P2}</p><form><input value=q><button>Go</button></form></article>", [P1, P2]),
    "white space": (f"<article><p>\n  {P1.replace(' ', '  ')}\t</p></article>", [P1]),
    "attribute with >": (f"<article data-x='a > b'><p title=\"x > y\">{P1}</p></article>", [P1]),
    "plain": ("just text", ["just text"]),
    "heading of a section": (f"<article><h2 class='section-header'>Part</h2><p>{P1}</p><div class='section-header'><h3>More</h3></div><p>{P2}</p></article>", ["Part", P1, "More", P2]),
    "heading row of a table": (f"<article><p>{P1}</p><table><tr class='table-header'><th>Year<th>Sum<tr><td>1<td>2</table></article>", [P1, "Year", "Sum", "1", "2"]),
    "found things": (f"<main><h1>Found</h1><div class='search-results'><p>{P1}</p><p>{P2}</p></div></main>", ["Found", P1, P2]),
    "formula": (f"<article><p>{P1} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", [P1 + " x=2 holds."]),
    "hidden": (f"<article><p>{P1}</p><p style='display:none'>{P2}</p><p hidden>{P3}</p></article>", [P1, P2, P3]),
    "no article": (f"<div id=page><div class='header'>Site name</div><div class='col'><h1>Head</h1><div class='section-header'><h2>Part</h2></div><p>{P1}</p><p>{P2}</p><div class='ad'>buy</div><p>{P3}</p></div><div class='comments'><p>{P2}</p><p>{P1}</p></div><div class='cookie-notice'>We use cookies.</div></div>", ["Head", "Part", P1, P2, P3]),
    "article beside other texts": (f"<body>Site<header><p>{P3}</p></header><div><p>{P2}</p></div><article><header><h1>Head</h1></header><p>{P1}</p><p>{P1}</p><p>{P3}</p><section id='comments'><p>{P2}</p></section></article><aside>{P2}</aside></body>", ["Head", P1, P1, P3]),
    "several articles": (f"<main><article><p>{P1}</p></article><article><p>{P2}</p></article><article class='comment'><p>{P3}</p></article></main>", [P1, P2]),
    "menu amid text": (f"<article>{P1}<nav><a href=x>y</a></nav>{P2} <script>no</script>and more</article>", [P1, P2 + " and more"]),
    "lists": (f"<article><p>{P1}</p><ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>{P2}</p></article>", [P1, "a", "b", "c", "d", P2]),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    page, blocks = CASES[name]
    assert html_text.main_text(page) == "\n".join(blocks)


def counts(node):
    """Characters, tags, link characters and link tags of a subtree, counted anew from the tree's own texts."""
    total = [node.own[0], node.own[1], node.own[2], node.own[3]]
    for child in node.kids:
        for k, v in enumerate(counts(child)):
            total[k] += v
        total[1] += 1
    return total


class Plain:
    def __init__(self, node):
        self.tag, self.hint, self.inside, self.parts = node.tag, node.hint, node.inside, node.parts
        self.own = (node.chars, node.tags, node.link_chars, node.link_tags)
        self.kids = [Plain(x) for x in node.parts if isinstance(x, html_text.Node)]


def plain_text(page):
    """The density choice by definition: every number counted again where it is asked for."""
    root = Plain(html_text.tree(page))
    chars, _, link_chars, _ = counts(root)

    def density(node):
        c, t, lc, lt = counts(node)
        if not c:
            return 0.0
        t, lt = t or 1, lt or 1
        base = math.log(c / max(1, c - lc) * lc + link_chars / (chars or 1) * c + math.e)
        return c / t * (max(0.0, math.log(max(1.0, c / lc * t / lt) + 1e-9)) if lc else math.log(max(math.e, c * t))) / base

    paths = []

    def walk(node, above):
        paths.append([*above, node])
        for kid in node.kids:
            walk(kid, [*above, node])

    walk(root, [])
    marked = any(p[-1].inside for p in paths)

    def score(path, value):
        return value * 0.0625 ** sum(bool(x.hint) for x in path) / (16 if marked and not path[-1].inside else 1)

    sums = [sum(density(k) for k in p[-1].kids) for p in paths]
    values = sums if max(score(p, v) for p, v in zip(paths, sums, strict=True)) > 0 else [density(p[-1]) for p in paths]
    scores = [score(p, v) for p, v in zip(paths, values, strict=True)]
    spine = paths[scores.index(max(scores))]
    best, out = spine[-1], []

    def emit(node, above):
        out.append(None)
        common = max(k for k, x in enumerate(spine) if x in [*above, node])
        if node not in spine:
            within = best in above or (marked and any(x.inside for x in above))
            factor = 1.0
            if node.hint == "named" or node.hint and not within:
                factor /= 16
            if marked and not within and not node.inside:
                factor /= 16
            c, _, lc, lt = counts(node)
            if not marked and not within and lt > 1 and 2 * lc > c:
                factor /= 4
            if factor < 1 and density(node) * factor < min(density(x) for x in spine[common:]):
                return
        for part in node.parts:
            if part is None:
                out.append(None)
            elif isinstance(part, str):
                loose = node in spine and node is not best and (not node.inside if marked else node.own[3] > 1 and 2 * node.own[2] > node.own[0])
                if not loose:
                    out.append(part)
            else:
                emit(node.kids[[x for x in node.parts if isinstance(x, html_text.Node)].index(part)], [*above, node])
        out.append(None)

    emit(root, [])
    blocks, run = [], []
    for part in [*out, None]:
        if part is not None:
            run.append(part)
        else:
            blocks.append(" ".join(html.unescape("".join(run)).split()))
            run = []
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("name", CASES)
def test_choice_against_the_plain_one(name):
    assert html_text.main_text(CASES[name][0]) == plain_text(CASES[name][0])


def test_pages_against_the_plain_choice(spark):
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    found = html_text.query(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.n_chars == len(r.text)
        assert r.text == plain_text(pages[r.page_id])
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        lines = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?p>|</?h1>", article.replace("<br>", " "))]
        assert r.text == "\n".join(x for x in lines if x)


def test_random_pages_against_the_plain_choice():
    dice = random.Random(7)

    def block(depth):
        tag = dice.choice(["div", "section", "p", "ul", "div", "article" if dice.random() < 0.2 else "div", "h2"])
        name = dice.choice(["", "", "", " class='ad'", " class='top-header'", " id=comments", " class='x'"])
        inner = "".join(block(depth + 1) if depth < 5 and dice.random() < 0.5 else dice.choice([P1, P2, "x", "<a href=y>link</a> ", "<b>bold</b> "]) for _ in range(dice.randrange(1, 5)))
        return f"<{tag}{name}>{inner}</{tag}>"

    for _ in range(300):
        page = f"<body>{''.join(block(0) for _ in range(4))}</body>"
        assert html_text.main_text(page) == plain_text(page)


def test_edges(spark, tmp_path):
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    given = [(1, "u", None), (2, None, ""), (3, "u", deep), (4, "u", "<" * 50_000), (5, "u", "<p" * 20_000), (6, "u", "<a href='" * 20_000), (7, "u", "<!--" * 20_000), (8, "u", "</p>" * 20_000), (None, "u", "<p>t"), (9, "u", "<script>" * 20_000), (9, "u", "<script>" * 20_000), (10, "u", "<ul>" + "<li>x" * 20_000), (11, "u", "text " * 200_000), (12, "u", "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000), (13, "u", "<table><tr>" + "<div>" * 20_000 + "<td></td>" * 20_000)]
    pages = spark.createDataFrame(given, "page_id bigint, url string, html string")
    sf = sf_folder(spark, tmp_path, pages=with_clash(pages))
    found = html_text.query(spark, sf).collect()
    assert len(found) == len(given)
    assert all(r.text == "" for r in found if r.page_id in (1, 2))
    assert html_text.html_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("lead", [P1, P1 * 3])
def test_without_an_article_the_texts_beside_the_chosen_block_stay(lead):
    long = [" ".join([p] * 4) for p in (P1, P2, P3)]
    block = "".join(f"<p>{p}</p>" for p in long)
    page = f"<body>{MENU}<h1>Head</h1><p>{lead}</p>some <b>loose</b> text<div>{block}</div><blockquote>{P2}</blockquote><p>End, <a href=x>with a link</a>.</p>{MENU}</body>"
    assert html_text.main_text(page) == "\n".join(["Head", lead, "some loose text", *long, P2, "End, with a link."])
