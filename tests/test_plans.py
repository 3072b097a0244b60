import inspect
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from webloom.functions.hashing import url_hash
from webloom.functions.html import extract_links
from webloom.functions.url import url_normalize
from webloom.plans import crawl, index, pagerank, search
from webloom.plans.queries import QUERIES
from webloom.streaming import frontier

HOST = "http://foo.com:80"
THREE = [
    (f"{HOST}/page1.html", 'This links to <a href="http://foo.com:80/page2.html">page 2</a>', 1.191681575822917),
    (f"{HOST}/page2.html", 'A link to <a href="http://foo.com:80/page1.html">page 1</a> and <a href="http://foo.com:80/page3.html">page 3</a>', 1.1637322274926893),
    (f"{HOST}/page3.html", 'Linking back to <a href="http://foo.com:80/page1.html">page 1</a>', 0.644586196684393),
]
# links of nine pages (by number) and their known ranks, self-links kept
NINE = {0: [0, 3, 4, 5, 6, 7, 8], 1: [5], 2: [1, 5], 3: [4, 6], 4: [4, 6, 8], 5: [7], 6: [1, 4, 5, 6], 7: [2], 8: []}
NINE_RANKS = [0.17073170731719883, 0.890940650951408, 1.5045544412921787, 0.17073170731719883, 0.48265779281379606, 1.6640183069267134, 0.48265779281379606, 1.5840614770952648, 0.30751177010942815]


def test_pagerank_of_three_pages(spark):
    pages = spark.createDataFrame([(u, h) for u, h, _ in THREE], "url string, page string")
    links = pages.select(F.col("url").alias("src"), F.explode(extract_links(F.col("page"))).alias("link")).select("src", url_normalize(F.col("link"), F.col("src")).alias("dst"))
    got = {r.node: r.rank for r in pagerank.pagerank(pages.select(F.col("url").alias("node")), links, 0.001).collect()}
    assert all(abs(got[u] - rank) < 1e-12 for u, _, rank in THREE)


def test_pagerank_of_nine_pages(spark):
    nodes = spark.range(9).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(a, b) for a, to in NINE.items() for b in to for _ in range(2)], "src long, dst long")
    got = {r.node: r.rank for r in pagerank.pagerank(nodes, links, 0.01, exclude_self_links=False).collect()}
    assert all(abs(got[k] - rank) < 1e-9 for k, rank in enumerate(NINE_RANKS))


def test_inverted_index(spark):
    rows = [("http://foo.com/page1.html", "apples bananas coconuts"), ("http://foo.com/page2.html", "dates elderberries figs"), ("http://foo.com/page3.html", "<b>guavas</b>\tHazelnuts, guavas!"), ("x", None)]
    got = {r.term: r.urls for r in index.inverted_index(spark.createDataFrame(rows, "url string, page string")).collect()}
    assert got == {w: [u] for u, t in rows[:3] for w in t.lower().replace("<b>", "").replace("</b>", "").replace("\t", " ").replace(",", "").replace("!", "").split()}


def test_tfidf_and_search(spark):
    rows = [("u1", " cat dog cat"), ("u2", " dog bird"), ("u3", None)]
    own = spark.createDataFrame(rows, "url string, page string")
    tf = {(r.url, r.term): r.tf for r in index.html_term_frequencies(own).collect()}
    assert tf == {("u1", "cat"): 2 / 3, ("u1", "dog"): 1 / 3, ("u2", "dog"): 1 / 2, ("u2", "bird"): 1 / 2}
    weights = index.tfidf(index.html_term_frequencies(own), 3)
    w = {(r.term, r.url): r.tfidf for r in weights.collect()}
    assert abs(w["cat", "u1"] - 2 / 3 * math.log(3)) < 1e-12
    ranks = spark.createDataFrame([("u2",)], "u string").select(url_hash(F.col("u")).alias("url_hash"), F.lit(0.5).alias("rank"))
    got = {r.url: r.score for r in search.search(spark, weights, 3, "cat Dog, dog zzz", ranks, stemmed=False).collect()}
    q = {"cat": 1 / 4 * math.log(3), "dog": 2 / 4 * math.log(1.5)}
    below = math.sqrt(w["cat", "u1"] ** 2 + 2 * w["dog", "u1"] ** 2 + 2 * w["dog", "u2"] ** 2) * math.sqrt(q["cat"] ** 2 + q["dog"] ** 2)
    assert abs(got["u1"] - (w["cat", "u1"] * q["cat"] + 2 * w["dog", "u1"] * q["dog"]) / below) < 1e-12
    assert abs(got["u2"] - 2 * w["dog", "u2"] * q["dog"] / below - 0.5) < 1e-12
    every = spark.createDataFrame([("a", " x y"), ("b", " x z")], "url string, page string")
    none = search.search(spark, index.tfidf(index.html_term_frequencies(every), 2), 2, "x", stemmed=False)
    assert all(math.isnan(r.score) for r in none.collect())
    assert search.search(spark, weights, 3, " ! ").count() == 0
    titled = search.to_json(spark.createDataFrame([("u", 1.0, 'a "q"'), ("v", 2.0, None)], "url string, score double, title string"))
    assert titled.first().json == '{"data":[{"url":"v"},{"url":"u","title":"a \\"q\\""}]}'


def test_stemmed_dictionary_terms(spark):
    own = spark.createDataFrame([("u", "<h1>Running runs</h1><p>The hotels ran</p>"), ("v", "<p>x</p>")], "url string, page string")
    known = spark.createDataFrame([("run",), ("hotel",)], "word string")
    got = {(r.url, r.term): r.tf for r in index.heading_paragraph_term_frequencies(own, known, stemmed=True).collect()}
    assert got == {("u", "run"): 1.0, ("u", "hotel"): 0.5}


def test_stemmed_terms_are_parsed_once_and_stemmed_once_a_word(spark):
    from webloom.functions.stem import stem

    known = {"run", "hotel", "gener", "generate", "relate", "relat", "xyz"}
    texts = {"u": ["running runs generates", "related relating hotels ran"], "v": ["Runs"], "w": ["hotels relates the run run"], "z": [""]}
    own = spark.createDataFrame([(u, f"<p>{t}</p>") for u, all_ in texts.items() for t in all_] + [("n", None), (None, "<p>run run hotel</p>")], "url string, page string")
    tf = index.heading_paragraph_term_frequencies(own, spark.createDataFrame([(w,) for w in sorted(known)], "word string"), stemmed=True)
    want = {}
    for u, all_ in texts.items():
        once = [s for t in all_ for w in t.lower().split() if (s := stem(w)) in known]
        for term in {stem(s) for s in once} & known:
            if len(once) > 1:
                want[u, term] = sum(stem(s) == term for s in once) / (len(once) - 1)
    assert {(r.url, r.term): r.tf for r in tf.collect()} == want and len(want) > 4
    plan = tf._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "_stem_all" not in plan and plan.count("Generate explode") == 1


def test_crawl_follows_links_and_robots(spark):
    web = spark.createDataFrame([("http://a.com:80/", '<a href="/x">x</a><a href="http://b.com/">b</a><a href="/no">n</a>'), ("http://a.com:80/x", '<a href="/">home</a>'), ("http://b.com:80/", "end"), ("http://a.com:80/no", "secret")], "url string, page string")
    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /no\n")], "host string, robots string")
    got = {r.url: r.page for r in crawl.crawl(spark, ["http://a.com"], web, robots, filtered=False, most_rounds=10).collect()}
    assert got.keys() == {"http://a.com:80/", "http://a.com:80/x", "http://b.com:80/"}


def test_crawl_does_not_stop_early_in_silence(spark):
    assert inspect.signature(crawl.crawl).parameters["most_rounds"].default is None
    web = spark.createDataFrame([(f"http://a.com:80/{k}", "x") for k in range(3)], "url string, page string")
    seeds = [f"http://a.com/{k}" for k in range(3)]
    with pytest.raises(RuntimeError, match="1 URLs"):
        crawl.crawl(spark, seeds, web, most_rounds=2)
    visited, left = crawl.crawl_rounds(spark, seeds, web, most_rounds=2)
    assert {r.url for r in visited.collect()} == set(web.toPandas()["url"][:2]) and [r.url for r in left.collect()] == ["http://a.com:80/2"]
    assert {r.url for r in crawl.crawl(spark, seeds, web).collect()} == set(web.toPandas()["url"])


def test_whole_crawl_against_brute_force(spark, tmp_path):
    links = {f"http://h{k % 3}.com:80/{k}": [f"http://h{j % 3}.com:80/{j}" for j in (k + 1, 7 * k % 12, 100 + k)] for k in range(12)}
    rows = [(k, u, "".join(f'<a href="{v}">.</a>' for v in to)) for k, (u, to) in enumerate(links.items())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))

    def brute(todo):
        seen = set()
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += links.get(u, [])
        return {(u, u in links) for u in seen}

    got = [(r.url, r.found) for r in QUERIES["crawl_whole"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(list(links))
    # one URL a host a round, from one seed: the same as all at once
    web = df.select("url", F.col("html").alias("page"))
    some = {k: v for k, v in links.items() if k in list(links)[8:]}
    few = web.where(F.col("url").isin(list(some)))
    links = some
    seed = list(some)[0]
    for polite in (True, False):
        visited = crawl.crawl(spark, [seed], few, filtered=False, one_per_host=polite)
        assert {(r.url, r.page is not None) for r in visited.collect()} == brute([seed])


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"url": ["http://h/1", "http://h/2", "http://h/1", "http://g/1"], "ts": pd.to_datetime(["2024-01-01 00:00:00.0", "2024-01-01 00:00:00.2", "2024-01-01 00:00:05.0", "2024-01-01 00:00:00.0"]), "page": ["a b", "b", "c", "a"]})
    spark.createDataFrame(rows, "url string, ts timestamp, page string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, ts timestamp, page string").parquet(str(tmp_path / "in"))
    got = {}
    for name, df in (("polite", frontier.polite(stream)), ("seen", frontier.first_seen(stream)), ("words", frontier.word_counts(stream, lateness="0 seconds"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got[name] = spark.table(name).collect()
    times = sorted(r.at.timestamp() for r in got["polite"] if r.host == "h")
    assert len(got["polite"]) == 4 and all(b - a >= 0.999 for a, b in zip(times, times[1:]))
    assert sorted(r.url for r in got["seen"]) == ["http://g/1", "http://h/1", "http://h/2"]


def test_fetching_from_a_server(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked = []

    class Site(BaseHTTPRequestHandler):
        def do_HEAD(self):
            asked.append((self.command, self.path))
            here = {
                "/robots.txt": (200, "text/plain", "User-agent: webloom\nDisallow: /secret\nCrawl-delay: 0.05\n"),
                "/": (200, "text/html; charset=utf-8", '<a href="/one.html">1</a> <a href="/moved.html">2</a> <a href="/secret.html">3</a> <a href="/data.bin">4</a> <a href="/gone.html">5</a>'),
                "/one.html": (200, "text/html", "one"),
                "/moved.html": (302, "text/html", "/target.html"),
                "/target.html": (200, "text/html", "<p>target</p>"),
                "/data.bin": (200, "application/octet-stream", "x" * 100),
            }.get(self.path)
            code, kind, body = here or (404, "text/html", "gone")
            self.send_response(code)
            self.send_header("Content-Type", kind)
            if code == 302:
                self.send_header("Location", body)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body.encode())

        do_GET = do_HEAD

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows, left = crawl.crawl_online(spark, [f"{base}/", "http://127.0.0.1:1/"], filtered=False, timeout=5.0)
    got = {r.url.removeprefix(base): r for r in rows.collect()}
    server.shutdown()
    assert left.isEmpty() and {k: r.response_code for k, r in got.items()} == {"/": 200, "/one.html": 200, "/moved.html": 302, "/secret.html": 0, "/data.bin": 200, "/gone.html": 404, "/target.html": 200, "http://127.0.0.1:1/": -1}
    assert got["/one.html"].page == "one" and got["/target.html"].page == "<p>target</p>" and got["/data.bin"].page is None and got["/data.bin"].length == 100
    assert ("GET", "/data.bin") not in asked and not [p for _, p in asked if p == "/secret.html"]


def test_a_large_frontier_loses_nothing(spark):
    links = "".join(f'<a href="http://h{i % 50}.com/{i}">x</a>' for i in range(7000))
    web = spark.createDataFrame([("http://h.com:80/", links)], "url string, page string")
    got = crawl.crawl(spark, ["http://h.com"], web, filtered=False, one_per_host=False)
    assert got.select("url").distinct().count() == 7001


def test_ranks_that_do_not_settle_are_an_error(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    links = spark.createDataFrame([("a", "b")], "src string, dst string")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        pagerank.pagerank(nodes, links, 1e-6, most_rounds=1)


def test_stemmed_search_against_counting(spark, sf):
    import math

    from webloom.functions.stem import stem
    from webloom.plans.queries import SEARCH, q_search_stemmed, q_tfidf_stemmed_dictionary

    weights = {(r.term, r.url): r.tfidf for r in q_tfidf_stemmed_dictionary(spark, sf).collect()}
    n, tokens = spark.read.parquet(f"{sf}/pages.parquet").count(), [stem(w) for w in SEARCH.split()]
    times = {w: tokens.count(w) for w in tokens}
    df = {w: sum(x == w for x, _ in weights) for w in times}
    q = {w: times[w] / len(tokens) * math.log(n / df[w]) for w in times if df[w]}
    below = math.sqrt(sum(times[w] * v * v for (w, _), v in weights.items() if w in q)) * math.sqrt(sum(v * v for v in q.values()))
    want = {}
    for (w, u), v in weights.items():
        if w in q:
            want[u] = want.get(u, 0.0) + times[w] * v * q[w] / below
    got = {r.url: r.score for r in q_search_stemmed(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[u] - want[u] - 0.15) < 2e-6 for u in got)


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Pages of which some URLs have two or three rows, and one is null."""
    duckdb = pytest.importorskip("duckdb")
    folder = tmp_path_factory.mktemp("repeated")
    rows = [(k, f"http://h{k % 3}.com/{k % 6}" if k < 16 else None, f"<head><title>t{k % 7}</title></head> the word{k} and of x{k % 4} hotel{k % 2}") for k in range(17)]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", pages)
    con.execute(f"COPY pages TO '{folder}/pages.parquet' (FORMAT parquet)")
    return str(folder), con


def against_sql(spark, repeated, name):
    from __spark_entry__ import oracle_sql

    folder, con = repeated
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = sorted(str(tuple(r)) for r in QUERIES[name](spark, folder).select(*names).collect())
    assert got == want
    return got


def test_search_per_doc_with_urls_crawled_again(spark, repeated):
    got = against_sql(spark, repeated, "search_per_doc")
    assert len(got) == 17


def test_search_ranked_with_urls_crawled_again(spark, repeated):
    got = against_sql(spark, repeated, "search_ranked")
    assert len(got) == 4 * 3**2 + 2 * 2**2 + 1  # each rank row with each title


def test_ranks_of_pages_parse_each_page_once(spark, monkeypatch):
    from webloom.plans import queries

    seen = []
    real = pagerank.pagerank
    monkeypatch.setattr(pagerank, "pagerank", lambda nodes, links, *a: seen.extend((nodes, links)) or real(nodes, links, *a))
    a, b, c = (f"http://{h}.com:80/" for h in "abc")
    web = spark.createDataFrame([(a, f'<a href="{b}">b</a> <a href="{b}">b</a>'), (b, f'<a href="{c}">c</a>'), (a, f'<a href="{b}">b</a>'), (b, None), (None, "")], "url string, page string")
    got = [(r.url, round(r.rank, 9)) for r in queries.page_ranks(web).collect()]
    assert sorted(got, key=str) == sorted([(a, 0.15), (b, 0.2775), (c, 0.385875), (None, 0.15)], key=str)
    assert not any("regexp_extract_all" in df._jdf.queryExecution().optimizedPlan().toString() for df in seen)


def test_posting_blocks_hold_all_postings(spark):
    web = spark.createDataFrame([(f"u{i}", "common word" if i % 2 else "common") for i in range(300)] + [("u1", "common")], "url string, page string")
    got = index.posting_blocks(web, 40).collect()
    assert sorted(u for r in got if r.term == "common" for u in r.urls) == sorted({f"u{i}" for i in range(300)})
    assert len([r for r in got if r.term == "common"]) == 8 and max(len(r.urls) for r in got) < 80
