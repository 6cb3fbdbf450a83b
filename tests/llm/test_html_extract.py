"""HTML extraction: the blocks, the field against enumeration, held-out pages, and the given pages by their own markup."""

import html
import itertools
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import html_blocks, html_extract, html_pages


def texts(page):
    return [(b.path[-1] if b.path else "", b.text) for b in html_blocks.blocks(page)]


def test_blocks():
    page = """<!DOCTYPE html><!-- a --><div class="Main-Content col2" id='x'>one <b>two</b><br>three&nbsp;&amp;&lt;b&gt;
      <p>p1<p>p2 <a href="?a>b">link</a></div><script>var x = "</p><p>no";</script><ul><li>i<li>j<ul><li>k</ul>l</ul>
      <table><tr><td>c1<td>c2<tr><td>c3</table><style>p{}</style>a < b <3 end</p>tail<!-- open"""
    assert texts(page) == [("div main content col x", "one two three &<b>"), ("p", "p1"), ("p", "p2 link"), ("li", "i"), ("li", "j"), ("li", "k"), ("li", "l"), ("td", "c1"), ("td", "c2"), ("td", "c3"), ("", "a < b <3 end"), ("", "tail")]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<p") == [] and html_blocks.blocks("<script>x") == []
    assert texts("<!-->x") == [("", "x")] and texts("</ foo>x<a b='>y") == [("", "xy")]
    linked = html_blocks.blocks("<p>ab<a>cde</a>f</p><a><div>gh</div></a>i")
    assert [(b.linked, b.links) for b in linked] == [(3, 1), (2, 0), (0, 0)]


def test_hostile_pages_take_time_in_proportion():
    began = time.time()
    for page in ("<div>" * 60_000 + "x", "<ul>" + "<div>" * 20_000 + "<li>a" * 20_000, "<p>" * 100_000, "<" * 300_000, "</li>" * 100_000, "<a href='x" * 3_000, "&" * 300_000, "<b>x</b>" * 100_000):
        html_blocks.blocks(page)
    assert time.time() - began < 60


def test_field_against_enumeration():
    rnd = np.random.default_rng(2)
    score, pair, start = rnd.normal(0, 1, (4, 2)), rnd.normal(0, 1, (2, 2)), 0.4
    one, both = html_extract._marginals(score, [2, 2, 2, 1], pair, start)

    def total(ys, p):
        return sum(score[t, p] * y for t, y in enumerate(ys)) + start * ys[0] + sum(pair[a][b] for a, b in itertools.pairwise(ys))

    want_both = np.zeros((2, 2))
    for p, n in ((0, 4), (1, 3)):
        every = list(itertools.product((0, 1), repeat=n))
        weight = [math.exp(total(ys, p)) for ys in every]
        for t in range(n):
            assert one[t, p] == pytest.approx(sum(w for ys, w in zip(every, weight, strict=True) if ys[t]) / sum(weight))
        for ys, w in zip(every, weight, strict=True):
            for a, b in itertools.pairwise(ys):
                want_both[a, b] += w / sum(weight)
        field = html_extract.Field({}, pair.tolist(), start)
        field._scores = lambda blocks, p=p, n=n: score[:n, p].tolist()
        assert tuple(field.decode([None] * n)) == max(every, key=lambda ys: total(ys, p))
    assert both == pytest.approx(want_both)


def test_held_out_pages():
    field = html_extract.default_field()
    hit = wrong = missed = 0
    for page in html_pages.labelled_pages(200, 77):
        found = html_blocks.blocks(page)
        gold = [html_pages.MARK in b.text for b in found]
        found = [html_blocks.Block(b.path, b.text.replace(html_pages.MARK, "").strip() or "-", b.linked, b.links) for b in found]
        for y, z in zip(gold, field.decode(found), strict=True):
            hit, wrong, missed = hit + (y and z), wrong + (z and not y), missed + (y and not z)
    assert hit / (hit + wrong) > 0.98 and hit / (hit + missed) > 0.98


#: Pages written by hand, with their main text.
PAGES = [
    ("""<html><head><title>T</title></head><body><header class="site-header"><a href="/">My Site</a><nav><a href="/a">A</a> <a href="/b">B</a></nav></header>
    <main><article><header><h1>The title of it</h1></header><p>First paragraph, with a <a href="/l">link</a>.</p><div class="advert">Buy this thing now, it is cheap.</div>
    <p>Second paragraph &amp; more text here.</p><ul><li>One item of a list.</li><li>Another item of it.</li></ul></article>
    <section class="comments"><h3>2 comments</h3><div class="comment"><p>I think that this is a nice article, thank you.</p></div><div class="comment"><p>Me too, really, it was good to read.</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story</a></li><li><a href="/y">More</a></li></ul></aside>
    <form class="newsletter"><label>Email</label><input><button>Subscribe</button></form><footer>&copy; 2024 My Site. All rights reserved.</footer></body></html>""",
     "The title of it\nFirst paragraph, with a link.\nSecond paragraph & more text here.\nOne item of a list.\nAnother item of it."),
    ("""<body><div id="cookie-notice">This site uses cookies to be better. <button>Accept</button></div><div class="menu"><ul><li><a href=1>Home<li><a href=2>News</ul></div>
    <div class="post-content"><h1>Title</h1><p>It was a day like any other, and so it began.<p>Then it ended, as days do.</div>
    <div id="footer"><p>Copyright by nobody</p></div>""", "Title\nIt was a day like any other, and so it began.\nThen it ended, as days do."),
    ("<p>Just one plain paragraph of text, and nothing else on this page.</p>", "Just one plain paragraph of text, and nothing else on this page."),
    ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
    ("<!-- nothing --><script>x()</script>", ""),
]


def test_pages_by_hand_and_awkward_rows(spark):
    rows = [(i, f"u{i}", page) for i, (page, _) in enumerate(PAGES)] + [(50, None, None), (51, "u", ""), (None, None, PAGES[0][0]), (0, "u0", PAGES[0][0]), (52, "u", "plain"), (53, "u", "<article>" + "<p>A sentence of a long page.</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit("x").alias("n_chars"))
    got = html_extract.extract_main_text(df).collect()
    assert len(got) == len(rows)
    assert all(len(r.text) == r.n_chars for r in got)
    by = {(r.page_id, r.url): r.text for r in got}
    for i, (_, want) in enumerate(PAGES):
        assert by[i, f"u{i}"] == want
    assert by[50, None] == by[51, "u"] == "" and by[None, None] == PAGES[0][1]
    assert by[53, "u"].count("\n") == 19_999
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_given_pages_by_their_own_article(spark):
    path = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = html_extract.op13(spark, path).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(filter(None, parts))
