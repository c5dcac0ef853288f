"""Extraction on written pages, alignment against the textbook table."""

import random

import numpy as np

from sitelight.llm import html


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_a_longest_common_subsequence():
    draw = random.Random(6)
    for _ in range(200):
        a = [draw.randint(0, 6) for _ in range(draw.randint(0, 14))]
        b = [draw.randint(0, 6) for _ in range(draw.randint(0, 14))]
        flags = html.shared_lines(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        kept = [x for x, f in zip(a, flags, strict=True) if f]
        assert len(kept) == lcs_length(a, b)
        it = iter(b)
        assert all(x in it for x in kept)


def texts(spark, pages):
    rows = [(i, u, h, "old", "kept") for i, (u, h) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")
    got = html.extract(frame).orderBy("page_id").collect()
    assert all(r.host == "kept" and r.n_chars == len(r.text) for r in got)
    return [r.text for r in got]


def test_markup_decides_inside_a_page(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>
      <!-- a <p>comment</p> --><script>var t="</p><p>no";</script><div class="cookie-notice">Cookies</div><div class='adBanner'>Buy</div>
      <article><header><h1>Title &amp; more</h1></header><p>One <b>bold<br>line</b>
      two&nbsp;&eacute;&#33;</p><aside>Side</aside><p>A &lt;b&gt; &am x<p>Last<ul><li>i<li>j</ul><form>Mail <input></form>
      <section id="comments"><p>First!</p></section></article><footer>&copy; Site</footer></body></html>"""
    assert texts(spark, [("http://a/x", page)]) == ["Title & more\n\nOne bold line two é!\n\nA <b> &am x\n\nLast\n\ni\n\nj"]


def test_shared_lines_go_where_there_is_no_article(spark):
    page = "<body><div>Menu</div><div>Welcome</div><p>{}</p><div>Imprint</div>"
    pages = [(f"http://h.com/a/{i}", page.format(f"story {i}")) for i in range(4)] + [("http://alone.com/", page.format("only"))]
    assert texts(spark, pages) == [*[f"story {i}" for i in range(4)], "Menu\n\nWelcome\n\nonly\n\nImprint"]


def test_shared_lines_of_articles_stay(spark):
    page = "<div>Menu</div><article><p>same</p><p>{}</p></article>"
    assert texts(spark, [(f"http://h/{i}", page.format(i)) for i in range(2)]) == ["same\n\n0", "same\n\n1"]


def test_alignment_decides_outside_articles(spark):
    page = "<div>Menu</div><p>lead {0}</p><article><p>story {0}</p></article><p>more {0}</p><div>Imprint</div><footer>f {0}</footer>"
    assert texts(spark, [(f"http://h/{i}", page.format(i)) for i in range(3)]) == [f"lead {i}\n\nstory {i}\n\nmore {i}" for i in range(3)]


def test_edges(spark):
    pages = [
        ("http://h/1", None), ("http://h/1", ""), (None, "<p>no url</p>"), ("nothing", "plain & simple"), ("http://h/2", "<p>cut <b"), ("http://h/3", "<p>" + "long " * 50000),
        ("http://h/4", "<div class=ad>never closed<article><p>text</p>"), ("http://h/5", "<p title='a>b'>x</p><p y=\"<p>\">z</p>"), ("http://h/5", "<p title='a>b'>x</p><p y=\"<p>\">z</p>"),
    ]
    got = texts(spark, pages)
    assert got[:5] == ["", "", "no url", "plain & simple", "cut"] and got[5] == ("long " * 50000).strip()
    assert got[6:] == ["text", "x\n\nz", "x\n\nz"]
    assert texts(spark, []) == []


def test_nearest_page_shares_the_longer_beginning(spark):
    from sitelight.llm.common import Scratch

    keys = spark.createDataFrame([(1, "h", "/a/1"), (2, "h", "/a/2"), (3, "h", "/b/1"), (4, "h", "/b/12"), (5, "i", "/b/12"), (6, "", "/")], "key long, host string, path string")
    got = {r.key: r.nearest for r in html.nearest(keys, Scratch(spark)).collect()}
    assert got == {1: 2, 2: 1, 3: 4, 4: 3}
