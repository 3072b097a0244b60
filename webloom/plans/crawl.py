"""Crawling in rounds over a table of pages that stands for the web."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.functions.html import extract_links
from webloom.functions.robots import AGENT, robots_allowed, robots_rules
from webloom.functions.url import seed_normalize, url_filter, url_normalize, url_parts
from webloom.workspace import written


def unvisited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct URLs of the frontier that have not been fetched."""
    return frontier.select("url").distinct().join(visited.select("url"), "url", "left_anti")


def with_host(urls: DataFrame) -> DataFrame:
    parts = url_parts(F.col("url"))
    return urls.select("url", parts["host"].alias("host"), parts["rest"].alias("path"))


def permitted(urls: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """``url, host`` of those that their host's robots.txt (``host, robots``) allows."""
    return with_host(urls).join(robots.select("host", "robots"), "host", "left").where(robots_allowed(F.coalesce("robots", F.lit("")), F.col("path"), agent)).select("url", "host")


def polite(urls: DataFrame) -> DataFrame:
    """``url, host, now``: of each host one URL is fetched in this round, the first in order; the others wait."""
    first = urls.groupBy("host").agg(F.min("url").alias("_first"))
    return urls.join(first, "host").select("url", "host", (F.col("url") == F.col("_first")).alias("now"))


def links_of(fetched: DataFrame, filtered: bool = True) -> DataFrame:
    """``url``: links of fetched pages (url, page), as absolute URLs that the crawl follows."""
    each = fetched.where("page is not null").select(F.col("url").alias("base"), F.explode(extract_links(F.col("page"))).alias("link"))
    found = each.select(url_normalize(F.col("link"), F.col("base")).alias("url")).where("url is not null")
    return found.where(url_filter(F.col("url"))) if filtered else found


def crawl_round(frontier: DataFrame, visited: DataFrame, web: DataFrame, robots: DataFrame | None = None, filtered: bool = True, one_per_host: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fetched, next frontier): what this round fetches of ``web`` (url, page), and what is to be fetched next."""
    todo = unvisited(frontier, visited)
    todo = permitted(todo, robots) if robots is not None else with_host(todo).select("url", "host")
    if one_per_host:
        marked = polite(todo)
        todo, later = marked.where("now"), marked.where(~F.col("now")).select("url")
    else:
        later = todo.where(F.lit(False)).select("url")
    fetched = todo.select("url").join(web.select("url", "page"), "url", "left")
    return fetched, later.unionAll(links_of(fetched, filtered))


def crawl_rounds(
    spark: SparkSession,
    seeds: list[str] | DataFrame,
    web: DataFrame,
    robots: DataFrame | None = None,
    filtered: bool = True,
    most_rounds: int | None = None,
    most_frontier: int = 0,
    sampled: int = 3000,
    seed: int = 1,
    one_per_host: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(``url, page`` of all that is fetched from the seeds on, frontier that is left): rounds go on until the
    frontier is empty, or for ``most_rounds`` of them.

    ``seeds`` are URLs, or a table with a column ``url``. With ``most_frontier`` a frontier of more URLs
    than that is sampled down to about ``sampled``: URLs are lost; 0, the default, keeps all. Without ``one_per_host`` a round fetches all that is known, so
    there are as many rounds as the links are deep; what is fetched in the end is the same.
    """
    given = spark.createDataFrame([(s,) for s in seeds], "url string") if isinstance(seeds, list) else seeds
    frontier = written(given.select(seed_normalize(F.col("url")).alias("url")).where("url is not null").distinct(), "crawl-seeds")
    # a table a round: what is fetched is never written again; for what is known already URLs are enough
    rounds = [written(web.select("url", "page").limit(0), "crawl-0")]
    k = 0
    while not frontier.isEmpty() and (most_rounds is None or k < most_rounds):
        known = _all(rounds).select("url")
        fetched, ahead = crawl_round(frontier, known, web, robots, filtered, one_per_host)
        rounds.append(written(fetched, f"crawl-fetched-{k}"))
        # the next frontier follows from what was written
        ahead = ahead if one_per_host else links_of(rounds[-1], filtered)
        frontier = written(unvisited(ahead, _all(rounds).select("url")), f"crawl-frontier-{k}")
        n = frontier.count() if most_frontier else 0
        if n > most_frontier:
            frontier = written(frontier.sample(False, sampled / n, seed), f"crawl-sample-{k}")
        k += 1
    return _all(rounds), frontier


def _all(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema that ``written`` made, as one scan however many they are."""
    folders = sorted({f.rpartition("/")[0] for t in tables for f in t.inputFiles()})
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*folders) if folders else tables[0]


def crawl(spark: SparkSession, seeds: list[str] | DataFrame, web: DataFrame, robots: DataFrame | None = None, filtered: bool = True, most_rounds: int | None = None, **settings) -> DataFrame:
    """``url, page`` of all that ``crawl_rounds`` fetches until the frontier is empty; an error if ``most_rounds`` do
    not get there, since what is left would be missing."""
    visited, left = crawl_rounds(spark, seeds, web, robots, filtered, most_rounds, **settings)
    if not left.isEmpty():
        raise RuntimeError(f"{left.count()} URLs are still to be fetched after {most_rounds} rounds")
    return visited


FETCHED = "url string, response_code int, content_type string, length long, location string, page string"
REDIRECTS = (301, 302, 303, 307, 308)


def fetch(urls: DataFrame, timeout: float = 10.0, agent: str = AGENT, most_wait_ms: float = 60_000) -> DataFrame:
    """``FETCHED`` columns from the network, for ``url``, in batches on the executors.

    URLs are dealt by host, so that one task keeps a host's rules: its robots.txt is fetched once a task, URLs
    that it denies get the code 0, and between requests to a host lies its Crawl-delay (``most_wait_ms`` at
    most). A HEAD request comes first; only an HTML page that answers 200 is then fetched. Redirects are not
    followed: ``location`` says where they lead (see ``redirected``). The code is -1 where there is no answer.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        visit = _Visitor(timeout, agent, most_wait_ms)
        for b in batches:
            yield pd.DataFrame([visit(u) for u in b["url"]], columns=FETCHED.replace(",", "").split()[::2], dtype=object)

    return with_host(urls).repartition("host").sortWithinPartitions("host", "url").select("url").mapInPandas(run, FETCHED)


class _Visitor:
    """What one task knows of the hosts that it asks."""

    def __init__(self, timeout: float, agent: str, most_wait_ms: float):
        self.timeout, self.agent, self.most_wait_ms = timeout, agent, most_wait_ms
        self.rules: dict[str, tuple[list[tuple[str, str]], float]] = {}
        self.last: dict[str, float] = {}

    def ask(self, method: str, url: str) -> tuple[int, dict[str, str], bytes]:
        import http.client
        from urllib.parse import urlsplit

        parts = urlsplit(url)
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        connection = kind(parts.hostname, parts.port, timeout=self.timeout)
        try:
            connection.request(method, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": self.agent})
            answer = connection.getresponse()
            return answer.status, {k.lower(): v for k, v in answer.getheaders()}, answer.read() if method == "GET" else b""
        finally:
            connection.close()

    def site(self, url: str) -> tuple[list[tuple[str, str]], float]:
        from urllib.parse import urlsplit

        parts = urlsplit(url)
        site = f"{parts.scheme}://{parts.netloc}"
        if site not in self.rules:
            try:
                code, _, body = self.ask("GET", f"{site}/robots.txt")
            except Exception:
                code, body = -1, b""
            self.rules[site] = robots_rules(body.decode("utf-8", "replace") if code == 200 else "", self.agent)
        return self.rules[site]

    def wait(self, url: str, delay_ms: float) -> None:
        import time
        from urllib.parse import urlsplit

        host = urlsplit(url).netloc
        if host in self.last:
            time.sleep(max(0.0, self.last[host] + min(delay_ms, self.most_wait_ms) / 1000 - time.monotonic()))
        self.last[host] = time.monotonic()

    def __call__(self, url: str) -> tuple:
        from urllib.parse import urlsplit

        try:
            rules, delay = self.site(url)
            path = urlsplit(url).path or "/"
            if next((verdict == "Disallow" for verdict, start in rules if path.startswith(start)), False):
                return url, 0, None, None, None, None
            self.wait(url, delay)
            code, head, _ = self.ask("HEAD", url)
            kind = head.get("content-type", "").partition(";")[0].strip() or None
            length = int(head["content-length"]) if head.get("content-length", "").isdigit() else None
            if code in REDIRECTS:
                return url, code, kind, length, head.get("location"), None
            if code != 200 or kind != "text/html":
                return url, code, kind, length, None, None
            code, _, body = self.ask("GET", url)
            return url, code, kind, len(body), None, body.decode("utf-8", "replace") if code == 200 else None
        except Exception:  # whatever a server does, the other URLs of the task go on
            return url, -1, None, None, None, None


def redirected(fetched: DataFrame, filtered: bool = True) -> DataFrame:
    """``url``: where redirects among fetched rows lead; they go back to the frontier."""
    found = fetched.where(F.col("response_code").isin(*REDIRECTS) & F.col("location").isNotNull()).select(url_normalize(F.col("location"), F.col("url")).alias("url")).where("url is not null")
    return found.where(url_filter(F.col("url"))) if filtered else found


def crawl_online(spark: SparkSession, seeds: list[str], filtered: bool = True, most_rounds: int | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """(``FETCHED`` rows of all that is fetched from the seeds on, frontier that is left); a table a round."""
    frontier = written(spark.createDataFrame([(s,) for s in seeds], "url string").select(seed_normalize(F.col("url")).alias("url")).where("url is not null").distinct(), "online-seeds")
    rounds: list[DataFrame] = []
    while not frontier.isEmpty() and (most_rounds is None or len(rounds) < most_rounds):
        rounds.append(written(fetch(frontier, **settings), f"online-{len(rounds)}"))
        ahead = links_of(rounds[-1], filtered).unionAll(redirected(rounds[-1], filtered))
        frontier = written(unvisited(ahead, _all(rounds).select("url")), f"online-frontier-{len(rounds)}")
    return (_all(rounds) if rounds else spark.createDataFrame([], FETCHED)), frontier
