"""Host, path and rule against a plain parser; template, purity and verdict of every page against a plain tree."""

import math
import random
import re
import sys
from collections import defaultdict

from helixframe.llm import urls
from helixframe.llm.common import table
from tests.llm.common import SF, sf_folder, with_clash


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


VARIABLE = re.compile(urls.VARIABLE)
sys.setrecursionlimit(20000)


def names(counts, prefix, rare, many, z, out):
    """Names the branches below a node; counts: rest of a path -> [pages, labelled, bad, shapes]."""
    children = defaultdict(lambda: [0, 0, 0, []])
    for rest, (pages, labelled, bad, shapes) in counts.items():
        if not rest:
            for shape in shapes:
                out[shape] = prefix
            continue
        c = children[rest[0]]
        c[0], c[1], c[2] = c[0] + pages, c[1] + labelled, c[2] + bad
        c[3].append((rest[1:], (pages, labelled, bad, shapes)))
    total = [sum(c[k] for c in children.values()) for k in range(3)]
    below = defaultdict(lambda: defaultdict(lambda: [0, 0, 0, []]))
    for child, (pages, labelled, bad, rows) in children.items():
        share = (total[2] + 0.5) / (total[1] + 1)
        apart = abs(bad - share * labelled) > z * math.sqrt(max(labelled * share * (1 - share), 0.25))
        # a node whose paths all go on alike is no fork
        fork = len(children) > 1 or any(not r for r in counts)
        name = child
        if fork and child != "*" and not apart:
            if len(children) > many and pages < rare * total[0]:
                name = "*"
            elif len(children) > 1:
                name = "?"
        for rest, (p, lab, b, shapes) in rows:
            into = below[name][rest]
            into[0], into[1], into[2] = into[0] + p, into[1] + lab, into[2] + b
            into[3].extend(shapes)
    for name, rows in below.items():
        names(rows, (*prefix, name), rare, many, z, out)


def brute(pages, labels, rare=0.01, many=20, z=3.0, weight=5.0, least=0.5):
    """pages: (id, url, label id); labels: {label id: bad}. (id, host, path, rule, verdict, template, purity) of each."""
    parsed, shapes = [], defaultdict(lambda: defaultdict(lambda: [0, 0, 0, []]))
    for i, url, label in pages:
        host, path = split(url)
        r, v = rule(host, path)
        shape = tuple("*" if VARIABLE.search(s) else s for s in path.split("/") if s)
        known = int(v == "block") if v else labels.get(label)
        c = shapes[host][shape]
        c[0] += 1
        c[1] += known is not None
        c[2] += known or 0
        c[3] = [shape]
        parsed.append((i, host, path, r, v, shape))
    template, by_template, by_host = {}, defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for host, counts in shapes.items():
        out = {}
        names(counts, (), rare, many, z, out)
        for shape, name in out.items():
            template[host, shape] = name
            for at in (by_template[host, name], by_host[host]):
                at[0] += counts[shape][1]
                at[1] += counts[shape][2]
    prior = (sum(c[1] for c in by_host.values()) + 0.5) / (sum(c[0] for c in by_host.values()) + 1)
    for i, host, path, r, v, shape in parsed:
        name = template[host, shape]
        share = (by_host[host][1] + weight * prior) / (by_host[host][0] + weight)
        purity = 1 - (by_template[host, name][1] + weight * share) / (by_template[host, name][0] + weight)
        yield i, host, path, r, v or ("block" if purity < least else "allow"), "/" + "/".join(name), purity


def agrees(found, given, labels):
    want = sorted(brute(given, labels), key=str)
    have = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, r.purity) for r in found), key=str)
    assert len(have) == len(want)
    for h, w in zip(have, want, strict=True):
        assert h[:6] == w[:6] and abs(h[6] - w[6]) < 1e-8, (h, w)


def labelled(given):
    """Pages with the document number in their path."""
    for i, url in given:
        m = re.search(r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", split(url)[1])
        yield i, url, int(m[1]) if m else None


ODD = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://"), (5, "HTTP://WWW.Example.COM/en/1"), (6, "http://example.com/en"), (7, "http://notexample.com/en/x"), (8, "a://b://c.net/es/"), (9, "http://x.net?q=/es/"), (10, "http://x.net/fr/#a"), (10, "http://x.net/fr/#a"), (None, "http://É.org/Ä/1"), (11, "http://h.org/" + "a/" * 3000), (12, "http://a.com#f/../"), (13, "http://h.org//a///b//"), (14, "http://h.org/line\nbreak?x")]


def test_pages(spark):
    given = [(r.page_id, r.url) for r in table(spark, SF, "pages").collect()]
    labels = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in table(spark, SF, "labels").collect()}
    agrees(urls.query(spark, SF).collect(), list(labelled(given)), labels)


def test_edges(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, "x") for i, u in ODD], "page_id bigint, url string, html string")
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    sf = sf_folder(spark, tmp_path, pages=with_clash(pages), labels=labels)
    agrees(urls.query(spark, sf).collect(), list(labelled(ODD)), {1: 1})
    assert urls.url_filter(pages.limit(0)).count() == 0


def test_random_trees_against_the_plain_one(spark):
    dice = random.Random(5)
    words = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(60)]
    pages, labels = [], {}
    for k in range(6000):
        depth = dice.choice((0, 1, 2, 3, 5, 8, 13))
        path = "/".join(dice.choice(words[: (3, 60, 2, 4)[d % 4]]) if dice.random() < 0.9 else str(dice.randrange(99)) for d in range(depth))
        pages.append((k, f"http://{dice.choice(('a', 'b', 'b', 'b'))}.org/{path}", k))
        if dice.random() < 0.6:
            labels[k] = int(dice.random() < (0.9 if path.startswith(("ab/", "aa/ac")) or "/ab/ab/" in path else 0.1))
    df = spark.createDataFrame(pages, "page_id bigint, url string, label_id bigint")
    found = urls.url_filter(df, spark.createDataFrame(list(labels.items()), "label_id bigint, bad int")).collect()
    agrees(found, pages, labels)
    assert len({r.template for r in found}) > 20 and {r.verdict for r in found} == {"allow", "block"}


def test_a_hosts_bad_branch_is_told_apart_and_alike_ones_merge(spark):
    rows = [(k, f"http://h.org/{'spam' if k % 4 == 0 else ('news', 'blog', 'wiki')[k % 3]}/{k}", k, k % 4 == 0 and 1 or 0) for k in range(800)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, label_id bigint")
    labelled = spark.createDataFrame([(r[2], r[3]) for r in rows if r[0] % 2 == 0], "label_id bigint, bad int")
    found = {r.page_id: r for r in urls.url_filter(pages, labelled).collect()}
    assert all(found[k].verdict == ("block" if k % 4 == 0 else "allow") for k in range(800))
    assert {r.template for r in found.values()} <= {"/spam/*", "/?/*", "/news/*", "/blog/*", "/wiki/*"} and found[0].template == "/spam/*"


def test_many_rare_children_are_one_variable_segment(spark):
    pages = spark.createDataFrame([(k, f"http://h.org/user/name{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}q/home") for k in range(600)], "page_id bigint, url string")
    found = urls.url_filter(pages).select("template").distinct().collect()
    assert [r.template for r in found] == ["/user/*/home"]


def test_a_rare_branch_with_its_own_evidence_stays_apart(spark):
    names = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(200)]
    rows = [(k, f"http://h.org/{'spam' if k < 20 else 'user' + names[k % 200]}/{k}", k, int(k < 20)) for k in range(4000)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, label_id bigint")
    labelled = spark.createDataFrame([r[2:] for r in rows if r[0] % 2 == 0], "label_id bigint, bad int")
    found = {r.page_id: r for r in urls.url_filter(pages, labelled).collect()}
    assert all(found[k].verdict == ("block" if k < 20 else "allow") for k in range(4000))
    assert {r.template for r in found.values()} == {"/spam/*", "/*/*"}


def test_branches_that_differ_beyond_the_fourth_segment_are_told_apart(spark):
    rows = [(k, f"http://h.org/a/b/c/d/e/{'spam' if k % 4 == 0 else ('news', 'blog')[k % 2]}/{k}", k, int(k % 4 == 0)) for k in range(400)]
    rows += [(1000 + k, f"http://i.org/a/b/c/d/e/x{k % 3}q/{k}", 1000 + k, 0) for k in range(30)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, label_id bigint")
    labelled = spark.createDataFrame([r[2:] for r in rows if r[0] % 2 == 0 or r[0] >= 1000 or r[0] % 8 == 1], "label_id bigint, bad int")
    found = {r.page_id: r for r in urls.url_filter(pages, labelled).collect()}
    assert all(found[r[0]].verdict == ("block" if r[3] else "allow") for r in rows)
    assert found[0].template == "/a/b/c/d/e/spam/*" and found[1000].template == "/a/b/c/d/e/?/*"
