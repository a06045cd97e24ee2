"""Operator 5: pages of many shapes, labels that fit together, odd cases."""

import itertools

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from riskloom.llm import dom_boost

BODY = ["Thand er ofthe, rising and more of it in a row.", "Second block with &amp; a sign, and words, words, words all over the place again.", "Third one &lt;ends&gt; here, after a good many other words of the same kind as ever."]
TEXT = "Thand er ofthe, rising and more of it in a row. Second block with & a sign, and words, words, words all over the place again. Third one <ends> here, after a good many other words of the same kind as ever."
INNER = "".join(f"<p>{b}</p>" for b in BODY)
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; site, all rights</footer>"
SCHEMA = "page_id long, url string, html string, text string, n_chars long"

PAGES = {
    "plain": f"<html><body>{NAV}<article>{INNER}</article>{FOOT}</body></html>",
    "open tags": f"<body>{NAV}<article><p><b>{BODY[0]}<br><p>{BODY[1]}<p>{BODY[2]}</article>{FOOT}",
    "inline": f"<article><p>{BODY[0][:10]}<b>{BODY[0][10:20]}</b><i>{BODY[0][20:]}</i></p><p>{BODY[1]}</p>\n<p>  {BODY[2]} \n</p></article>",
    "script": f"<head><title>T</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><article>{INNER}<script>x<y</script></article><!-- <p>not this</p> -->",
    "sidebar": f'<header class="site-header"><h1>Site name</h1></header>{NAV}<div class="wrapper"><article>{INNER}</article><aside class="sidebar"><p>See also other things, and more of them.</p></aside></div>{FOOT}',
    "comments": f'{NAV}<article>{INNER}</article><section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>I think so too, what a fine text this is.</p></div><div class="comment"><p>Not me.</p></div></section>{FOOT}',
    "notice and form": f'<div class="cookie-notice"><p>We use cookies, please agree.</p></div><form class="search"><p>Find</p></form><main>{INNER}</main><form id="newsletter"><p>Subscribe to our letter now.</p></form>',
    "advert inside": f'<article><p>{BODY[0]}</p><div class="ad">Buy now, cheap.</div><p>{BODY[1]}</p><p>{BODY[2]}</p></article>{FOOT}',
    "divs": f'<div class="header">Site</div><div class="menu"><ul><li><a href="/">A</a></li><li><a href="/">B</a></li></ul></div><div class="content">{INNER}</div><div class="footer">All rights kept</div>',
}


@pytest.fixture(scope="module")
def trees(spark):
    return dom_boost.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))


def extracted(spark, trees, htmls):
    rows = [(i, f"u{i}", h, "clash", 1) for i, h in enumerate(htmls)]
    got = dom_boost.extract(spark.createDataFrame(rows, SCHEMA).repartition(2), trees).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_shapes(spark, trees):
    got = extracted(spark, trees, list(PAGES.values()))
    assert {k: got[i] for i, k in enumerate(PAGES)} == dict.fromkeys(PAGES, TEXT)


def test_odd_pages(spark, trees):
    long = "<article>" + "<p>word after word, and one more.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    got = extracted(spark, trees, [None, "", "   ", "<", "<p", "a < b", "<article></article>", long, deep, "</p></div>", "<!-- open", long])
    assert got[7] == got[11] == " ".join(["word after word, and one more."] * 20_000)
    assert all(got[i] == "" for i in (0, 1, 2, 6, 9, 10))


def test_pages_have_no_labels_of_their_own():
    html = "<article><div data-y='1.5'>a</div><div data-y=top>b</div><div data-y='0'>c</div></article>"
    page = dom_boost.Page(html)
    assert page.label == [None] * len(page.tag) and page.weak_labels()[1:] == [1, 1, 1, 1]


@pytest.mark.parametrize("tag", ["button", "select", "svg", "math", "object", "noscript", "video"])
def test_open_elements_take_no_text_along(tag):
    page = dom_boost.Page(f"<article><p>one <{tag}>two</{tag}> three</p><{tag}>four<p>five</p></article><p>six</p>")
    assert " ".join(t for _, t, _ in page.runs) == "one two three four five six"
    kept = page.weak_labels()
    assert " ".join(t for b, t, _ in page.runs if kept[b]) == "one two three four five"
    drawn = dom_boost.Page(f"<p>one <{tag}><path d='x'/><g>two</g></{tag}> three</p>")
    assert [drawn.tag[b] for b, _, _ in drawn.runs] == ["p", "g", "p"]


def test_learns_the_given_pages(spark, trees):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = dom_boost.extract(pages, trees).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    for r in got:
        page = dom_boost.Page(html[r.page_id])
        kept = page.weak_labels()
        assert r.text == " ".join(t for b, t, _ in page.runs if kept[b])


def test_labels_fit_together_and_are_the_likeliest():
    parent = [-1, 0, 1, 1, 0, 4, 5]
    rng = np.random.default_rng(2)
    for _ in range(50):
        odds = rng.normal(0, 3, len(parent))
        best, choice = -np.inf, None
        for labels in itertools.product("fac", repeat=len(parent)):
            fits = labels[0] == "f" and all((labels[parent[i]], labels[i]) in {("f", "f"), ("f", "a"), ("a", "a"), ("a", "c"), ("c", "c")} for i in range(1, len(parent)))
            worth = sum(-np.logaddexp(0, -o if x == "a" else o) for x, o in zip(labels, odds))
            if fits and worth > best:
                best, choice = worth, [x == "a" for x in labels]
        assert dom_boost.consistent(parent, odds) == choice


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dom_boost.extract(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, "", 0), (None, "u", "", "", 0)], SCHEMA)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in dom_boost.extract(blank).select("page_id", F.col("text"), "n_chars").collect()) == [(0, "", 0), (1, "", 0)]
