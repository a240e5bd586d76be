"""Extraction on pages whose main text is known, and simple tree matching by brute force."""

import json
import os
import random
import re
from functools import lru_cache
from html import escape

from tidemark.llm import html_extract as hx
from tidemark.llm import html_tree
from tidemark.llm.html_tree import Node, blocks, parse

LONG = "the quick brown fox jumps over the lazy dog and runs away from here"


def texts(html):
    return blocks([parse(html)])


def test_blocks():
    assert texts("<p>a <b>b</b>&amp;c<br>d</p>\n e &lt;x&gt; <div>f<p>g<p>h</div>i") == ["a b&c d", "e <x>", "f", "g", "h", "i"]
    assert texts("<p><b>x<br><p>y</p>z < 3 &copy 1") == ["x", "y", "z < 3 © 1"]
    assert texts("a<script>var x='<p>no</p>'</script>b<style>p{}</style><!-- c --><!doctype x>d") == ["a", "b", "d"]
    assert texts("<ul><li>1<li>2</ul><table><tr><td>3<td>4<tr><td>5</table>") == ["1", "2", "3", "4", "5"]
    assert texts('x <span class="ad">buy</span> y<form>f</form><div class="post-content">z</div><p hidden>h') == ["x y", "z"]
    assert texts('<a title="a > b">l</a> m<p class=\'x">y\'>n') == ["l m", "n"]
    assert texts("<p>cut &am") == ["cut &am"] and texts("<p>a<b") == ["a"] and texts("<script>x") == [] and texts("") == []
    assert texts("<article><header><h1>t</h1>by me</header><p>b</p></article><header><h1>no</h1></header>") == ["t", "b"]
    assert texts("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end") == ["deep", "end"]


def test_boilerplate_names():
    junk = ['class="ad-slot"', 'id=comments', 'class="post-comments"', "class='entry-footer'", 'class="advertBox sideBar cookieNotice"', 'class="x newsletter-signup"', 'role=navigation', "hidden", 'aria-hidden="true"',
            'style="color:red; display: none"', 'id="relatedPosts"', 'class="comment-body"']
    kept = ['class="adventure"', 'class="has-sidebar"', 'class="content-sidebar-wrap"', 'data-id="menu"', 'class="post article-body"', 'aria-hidden="false"', "class", 'title="hidden"']
    for a in junk:
        assert texts(f"<div {a}>no</div>yes") == ["yes"], a
    for a in kept:
        assert texts(f"<div {a}>yes</div>") == ["yes"], a
    assert texts('<body class="sidebar-left ads"><article id="comments">yes</article></body>') == ["yes"]


def test_host():
    assert hx.host_of("http://u:p@A.example:80/x?y") == "a.example" and hx.host_of(None) == "" and hx.host_of("/x") == ""
    assert hx.host_of("//[::1]:3/") == "[::1]" and hx.host_of("http://b.example#c") == "b.example"


def test_matching_is_the_largest():
    rng = random.Random(4)

    def tree(depth):
        return hx.Skel(rng.choice("ab"), False, children=[tree(depth - 1) for _ in range(rng.randrange(4))] if depth else [])

    def plain(a, b):
        if a.label != b.label:
            return 0

        @lru_cache(None)
        def best(i, j):
            if i == len(a.children) or j == len(b.children):
                return 0
            return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + plain(a.children[i], b.children[j]))

        return 1 + best(0, 0)

    def size(x):
        return 1 + sum(map(size, x.children))

    for _ in range(200):
        a, b = tree(3), tree(3)
        assert hx.matching(a, b) == plain(a, b)
        if a.label == b.label:
            assert size(hx.merge(a, b)) == size(a) + size(b) - plain(a, b)
            assert hx.matching(hx.merge(a, b), a) == size(a)


def page(k, body):
    """A site without telling names: its template shows only by comparing pages."""
    return (
        f"<html><head><title>t{k}</title></head><body><div><div><b>My Site</b> of many things that we sell here every day of the week</div>"
        f"<div><p>{escape(body)}</p><p>{k} second {LONG}</p><div>Written by the staff of My Site. All rights reserved by us.</div></div>"
        f"<div><a href=/{k}>more {LONG} {k}</a><a>{LONG} {k + 1}</a></div><div>Call us any time of the day or night at the number below</div></div></body></html>"
    )


def test_wrapper_of_a_site(spark):
    rows = [(k, f"http://Site.example/{k}", page(k, f"{k} & {LONG} {k}")) for k in range(30)]
    rows += [(100 + k, "http://copies.example/", page(1, "same")) for k in range(20)]
    rows += [(200, "http://site.example/other", "<body><main><p>Another layout</p></main><p>foot</p></body>"), (201, None, None), (202, "x", ""), (3, "http://site.example/3", rows[3][2])]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, rules int")
    got = hx.main_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    for k in range(30):
        assert text[k] == f"{k} & {LONG} {k}\n{k} second {LONG}"
    assert "same\n1 second" in text[100] and text[200] == "Another layout" and text[201] == text[202] == ""


def test_merging_order_does_not_matter():
    pages = [hx.skeleton(parse(page(k, f"{k} {LONG}"))) for k in range(12)]

    def rules(order):
        now = pages[order[0]]
        for k in order[1:]:
            now = hx.merge(now, pages[k])
        return hx.rules(now, list(range(8)))

    assert rules(range(12)) == rules(range(11, -1, -1)) and "true" in json.dumps(rules(range(12)))


def test_generated_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in hx.main_text(pages).collect():
        inner = html[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text == "\n".join(texts(f"<div>{inner}</div>")) and r.n_chars > 0
    assert hx.main_text(pages.limit(0)).collect() == []
    assert isinstance(parse("x").parts[0], tuple) and isinstance(parse("<p>").parts[0], Node)


def test_deep_pages():
    deep = lambda x, n=200: "<div>" * n + x + "</div>" * n
    page = f"<body><div>top<article><div>{deep('<p>one</p><nav>menu <div>more</div></nav>two<p>three <a>link</a>')}</div><p>four</p></article></div><p>end"
    assert texts(page) == ["top", "one", "two", "three link", "four", "end"]
    assert hx.extract(page) == "one\ntwo\nthree link\nfour"
    assert texts(deep("<aside>" * 300 + "no" + "</aside>" * 300 + "yes") + "after") == ["yes", "after"]
    assert texts("<span>" * 3000 + "<li>a" * 3000) == ["a"] * 3000


def test_rare_children_still_count():
    site = lambda k: hx.skeleton(parse(f"<body><div class=x>{''.join(f'<div class={chr(97 + k % 26)}{chr(97 + i)}{chr(97 + k // 26)}><p>{k} {i} {LONG}</p></div>' for i in range(12))}</div></body>"))
    now = site(0)
    for k in range(1, 60):
        now = hx.merge(now, site(k))
    body = now.children[0]
    box = next(c for c in body.children if c.label == "div.x")
    assert len(box.children) == hx.NODES + 1 and box.children[-1].label == ""
    assert hx._mass(now, False) == sum(len(f"{k} {i} {LONG}") for k in range(60) for i in range(12))


def induced(html, monkeypatch=None):
    """Texts of one host's pages without Spark."""
    trees = [hx.skeleton(parse(h)) for h in html]
    now = trees[0]
    for t in trees[1:]:
        now = hx.merge(now, t)
    rule = json.loads(json.dumps(hx.rules(now, list(range(min(len(set(html)), hx.MIN_PAGES))))))
    return [hx.extract(h, rule) for h in html]


def test_induction_finds_articles_without_their_names(spark, sf, monkeypatch):
    """Where nothing is called article or main the root is the same; and with an article no class or role is needed."""
    hosts = {}
    larger = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.1")  # hosts of the smaller tables have too few pages
    for r in spark.read.parquet(f"{larger}/pages.parquet").collect():
        hosts.setdefault(hx.host_of(r.url), []).append(r.html or "")
    large = sorted((h for h in hosts.values() if len(set(h)) >= hx.MIN_PAGES), key=len)[:12]
    want = [induced(h) for h in large]
    unnamed = [[re.sub(r"(</?)(article|main)\b", r"\1div", x) for x in h] for h in large]
    assert [induced(h) for h in unnamed] == want
    for name in ("JUNK_ROLES", "JUNK_WORDS"):
        monkeypatch.setattr(html_tree, name, frozenset())
    assert [induced(h) for h in large] == want


def test_names_tell_what_varies_but_is_no_article():
    site = lambda k: f"<body><div class=post><p>{k} {LONG} {k}</p><p>{k} again {LONG}</p><div class=comments><p>reader {k}: I think {LONG}</p></div></div><div>foot of all pages</div></body>"
    assert induced([site(k) for k in range(20)]) == [f"{k} {LONG} {k}\n{k} again {LONG}" for k in range(20)]


def test_very_long_pages():
    rows = "".join(f"<tr><td>{i}<td>b{i}" for i in range(20_000))
    paragraphs = "".join(f"<p>{i} of many" for i in range(20_000))
    page = f"<body><article><table>{rows}</table>{paragraphs}</article><p>foot"
    want = [x for i in range(20_000) for x in (str(i), f"b{i}")] + [f"{i} of many" for i in range(20_000)]
    assert hx.extract(page) == "\n".join(want)
    table = parse(f"<table>{rows}</table>").parts[0]
    assert {x.tag for x in table.parts} == {"tr"} and len(table.parts) == 20_000
    assert induced([page.replace("<article>", f"<article><h1>t{k}</h1>") for k in range(9)])[3] == "t3\n" + "\n".join(want)
