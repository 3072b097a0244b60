"""Crawl streams: first sightings, politeness a host, word counts a window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.functions.html import page_words
from webloom.functions.url import url_parts


def first_seen(urls: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A stream of (url, ts) without URLs seen before within the watermark."""
    return urls.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["url"])


def polite(urls: DataFrame, delay_seconds: float = 1.0) -> DataFrame:
    """``url, host, at``: a stream of (url, ts) with, for each host, the earliest time at which a URL may be
    fetched, requests in order of arrival and ``delay_seconds`` apart. The state is one time a host."""
    hosted = urls.select("url", "ts", url_parts(F.col("url"))["host"].alias("host")).where("host is not null")

    def place(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for b in batches:
            rows = []
            for url, ts in b.sort_values(["ts", "url"])[["url", "ts"]].itertuples(index=False):
                at = ts.timestamp() if last is None else max(ts.timestamp(), last + delay_seconds)
                last = at
                rows.append((url, key[0], pd.Timestamp(at, unit="s")))
            if rows:
                state.update((last,))
                yield pd.DataFrame(rows, columns=["url", "host", "at"])

    return hosted.groupBy("host").applyInPandasWithState(place, "url string, host string, at timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def word_counts(pages: DataFrame, window: str = "10 minutes", slide: str | None = None, lateness: str = "30 minutes") -> DataFrame:
    """``window, term, pages``: in how many pages of a stream of (ts, page) each word occurs."""
    each = pages.withWatermark("ts", lateness).select("ts", F.explode(page_words(F.col("page"))).alias("term"))
    return each.groupBy(F.window("ts", window, slide), "term").agg(F.count("*").alias("pages"))
