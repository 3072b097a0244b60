import pytest
from pyspark.sql import functions as F

from webloom.functions import hashing, html, robots, url
from webloom.functions.stem import porter_stem, stem


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_url_hash(spark):
    got = values(spark, [("http://foo.com:80/page1.html",), (None,)], "u string", hashing.url_hash(F.col("u")))
    assert got == [("mcdkxqnacktskkgejsnocqdgygxahgssfogkaswc",), (None,)]


def test_key_encoding(spark):
    keys = ["a/b_c-9é", "", "plain", "x y"]
    got = values(spark, [(k,) for k in keys], "k string", hashing.key_encode(F.col("k")), hashing.key_decode(hashing.key_encode(F.col("k"))))
    assert [g[0] for g in got] == ["a_2fb_5fc-9_e9", "", "plain", "x_20y"] and [g[1] for g in got] == keys


@pytest.mark.parametrize(
    "text, want",
    [
        ("http://foo.com/page1.html", ("http", "foo.com", None, "/page1.html")),
        ("https://h:8080/a", ("https", "h", "8080", "/a")),
        ("/x#y", (None, None, None, "/x#y")),
        ("https://h", ("https", "h", None, "/")),
        ("//cdn/y.js", (None, None, None, "//cdn/y.js")),
        ("mailto:a@b", (None, None, None, "mailto:a@b")),
        ("", (None, None, None, "")),
    ],
)
def test_url_parts(spark, text, want):
    assert values(spark, [(text,)], "u string", F.inline(F.array(url.url_parts(F.col("u"))))) == [want]


BASE = "https://foo.com:8000/bar/xyz.html"
NORMAL = [
    ("#abc", BASE), ("blah.html#t", "https://foo.com:8000/bar/blah.html"), ("../blubb/123.html", "https://foo.com:8000/blubb/123.html"),
    ("/one/two.html", "https://foo.com:8000/one/two.html"), ("http://elsewhere.com/some.html", "http://elsewhere.com:80/some.html"), ("pic.jpg", None),
    ("https://x.org", "https://x.org:443/"), ("ftp://x.org/a", None), ("http://h:81/a#b", "http://h:81/a#b"), ("mailto:x@y", "https://foo.com:8000/bar/mailto:x@y"),
    ("//cdn.x/y.js", "https://foo.com:8000//cdn.x/y.js"), (None, None),
]


def test_url_normalize(spark):
    got = values(spark, [(u, BASE) for u, _ in NORMAL], "u string, b string", url.url_normalize(F.col("u"), F.col("b")))
    assert got == [(w,) for _, w in NORMAL]
    assert values(spark, [("mailto:x@y", BASE), ("a/b", BASE)], "u string, b string", url.url_normalize(F.col("u"), F.col("b"), True)) == [(None,), ("https://foo.com:8000/bar/a/b",)]


def test_seed_normalize(spark):
    cases = [("http://a.b/c#d", "http://a.b:80/c"), ("https://a.b", "https://a.b:443/"), ("http://a:9/x", "http://a:9/x"), ("ftp://a/x", None), ("/x", None)]
    assert values(spark, [(c,) for c, _ in cases], "u string", url.seed_normalize(F.col("u"))) == [(w,) for _, w in cases]


def test_url_filter(spark):
    kept = ["http://a.com", "http://en.wikipedia.org", "http://h.co", "nodots", "http://a.com:80/x.community"]
    lost = ["http://de.wikipedia.org", "http://wiki.foo.com", "http://a.com/page.html", "http://a%20b", "http://archive.org", "http://h.info"]
    got = values(spark, [(u,) for u in kept + lost], "u string", url.url_filter(F.col("u")))
    assert got == [(True,)] * len(kept) + [(False,)] * len(lost)


def test_query_pairs(spark):
    got = values(spark, [("/s?a=1&b=&c&a=x%20y+z&d=1=2",), ("/none",)], "u string", url.query_pairs(F.col("u")))
    assert sorted((r.k, r.v) for r in got[0][0]) == [("a", "x y z"), ("b", ""), ("c", ""), ("d", "")] and got[1][0] == []


def test_links(spark):
    page = '<a href="x">1</a> <A class=c href=\'/y\'>2</A> <b href="no"> <a\nhref="z" > <abbr href="n"> <a href=> <a data-href="w">'
    assert values(spark, [(page,)], "h string", html.extract_links(F.col("h"))) == [(["x", "/y", "z", "w"],)]
    assert values(spark, [(page,)], "h string", html.extract_quoted_links(F.col("h"))) == [(["x", "z"],)]


def test_words_and_titles(spark):
    page = "<HEAD><title>T\nx</title></HEAD><h1>Big <b>News</b></h1><p class=a>It's 2 pm</p><script>var p;</script>One,two one"
    own = "h string"
    assert values(spark, [(page,), ("<p>x",)], own, html.page_title(F.col("h"))) == [("T\nx",), (None,)]
    assert values(spark, [(page,)], own, html.heading_paragraph_words(F.col("h"))) == [(["big", "news", "it", "s", "pm"],)]
    assert values(spark, [(page,)], own, html.html_words(F.col("h"))) == [(["t", "x", "big", "news", "it", "s", "pm", "one", "two", "one"],)]
    assert values(spark, [("A b, a (B)-c",)], own, html.page_words(F.col("h"))) == [(["a", "b", "c"],)]


ROBOTS = "User-agent: *\nAllow: /abc\nDisallow: /a\nCrawl-delay: 2\n\nUser-agent: me\nDisallow: /own\nDisallow:\nbroken line\n"


def test_robots(spark):
    cases = [("/abcd", True), ("/ax", False), ("/z", True), ("/own/x", True)]
    assert values(spark, [(ROBOTS, p) for p, _ in cases], "r string, p string", robots.robots_allowed(F.col("r"), F.col("p"), "other")) == [(w,) for _, w in cases]
    assert values(spark, [(ROBOTS, p) for p in ("/own/x", "/ax", "/q")], "r string, p string", robots.robots_allowed(F.col("r"), F.col("p"), "me")) == [(False,), (False,), (True,)]
    assert values(spark, [(ROBOTS,), ("",)], "r string", robots.robots_delay(F.col("r"), "me")) == [(2000.0,), (1000.0,)]


def test_stem(spark):
    cases = {"caresses": "caress", "ponies": "poni", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "adjustment": "adjust", "adoption": "adopt", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is"}
    assert {w: stem(w) for w in cases} == cases
    assert values(spark, [("running",), (None,)], "w string", porter_stem(F.col("w"))) == [("run",), (None,)]
