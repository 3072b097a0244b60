"""Ranked search: cosine of query and documents over TF-IDF, plus PageRank."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.functions.hashing import url_hash
from webloom.functions.html import page_title
from webloom.functions.stem import stem
from webloom.workspace import partitions, written


@dataclass
class Index:
    """What a search reads: ``weights`` (term, url, tfidf) in ranges of term, sorted, so that only the row groups
    that hold a word of the query are read; ``titles`` (url, title); and the number of documents."""

    weights: DataFrame
    titles: DataFrame
    n_docs: int


def stored(weights: DataFrame, crawl: DataFrame) -> Index:
    """The index of a crawl, written to the shared folder once for all searches."""
    ranges = weights.select("term", "url", "tfidf").repartitionByRange(partitions(crawl.sparkSession), "term", "url").sortWithinPartitions("term", "url")
    titles = crawl.select("url", page_title(F.col("page")).alias("title"))
    return Index(written(ranges, "search-weights"), written(titles, "search-titles"), crawl.count())


def query_terms(query: str, stemmed: bool = True) -> list[str]:
    parts = (re.sub("[^a-zA-Z ]", " ", p).lower().strip() for p in query.split(" "))
    return [stem(p) if stemmed else p for p in parts if p]


def search(spark: SparkSession, weights: DataFrame, n_docs, query: str, ranks: DataFrame | None = None, norm: str = "global", stemmed: bool = True) -> DataFrame:
    """``url, score`` of all pages with a word of the query. Not ordered.

    A word given twice counts twice against documents, once in the query's norm. The document norm is one
    for all matches (``global``) or each document's own (``per_doc``). Where a norm is 0 the score is NaN
    (``global``) or 0. ``ranks`` holds ``url_hash, rank``; a page with several rows there is given once for each.
    """
    tokens = query_terms(query, stemmed)
    if not tokens:
        return spark.createDataFrame([], "url string, score double")
    terms = sorted({(t, tokens.count(t), tokens.count(t) / len(tokens)) for t in tokens})
    asked = spark.createDataFrame(terms, "term string, times long, qtf double")
    # as many rows as the query has words, so this side may be broadcast
    # the plain condition reaches the words of the pages, before anything is counted or shuffled
    found = weights.where(F.col("term").isin(*sorted(set(tokens)))).join(F.broadcast(asked), "term")
    # read four times below; only postings of the query's words
    found = written(found, "search-postings")
    of_term = found.groupBy("term", "qtf").agg(F.count("*").alias("df")).select("term", (F.col("qtf") * F.ln(F.lit(n_docs) / F.col("df"))).alias("q"))
    scored = found.join(F.broadcast(of_term), "term").groupBy("url").agg(F.sum(F.col("times") * F.col("tfidf") * F.col("q")).alias("dot"), F.sum(F.col("times") * F.col("tfidf") * F.col("tfidf")).alias("own"))
    query_norm = F.sqrt(of_term.agg(F.sum(F.col("q") * F.col("q"))).scalar())
    if norm == "global":
        below = F.sqrt(found.agg(F.sum(F.col("times") * F.col("tfidf") * F.col("tfidf"))).scalar()) * query_norm
        empty = float("nan")
    else:
        below, empty = F.sqrt("own") * query_norm, 0.0
    scored = scored.select("url", below.alias("_below"), "dot").select("url", F.when(F.col("_below") == 0, F.lit(empty)).otherwise(F.try_divide("dot", "_below")).alias("score"))
    if ranks is None:
        return scored
    keyed = scored.withColumn("url_hash", url_hash(F.col("url")))
    return keyed.join(ranks.select("url_hash", "rank"), "url_hash", "left").select("url", (F.col("score") + F.coalesce("rank", F.lit(0.0))).alias("score"))


def top(results: DataFrame, k: int | None = None) -> DataFrame:
    """By descending score (NaN first), then url."""
    ordered = results.orderBy(F.desc("score"), "url")
    return ordered if k is None else ordered.limit(k)


def with_titles(results: DataFrame, titles: DataFrame) -> DataFrame:
    """``results`` with the title of each page (``titles``: url, title), null without one, and once for each row of it there."""
    return results.join(titles, "url", "left")


def to_json(results: DataFrame, k: int | None = None) -> DataFrame:
    """One row, ``json``: {"data": [{"url", "title"}, ...]} of the best k results, or all; a missing title is left out."""
    best = top(results, k)
    listed = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "url", "title"))).alias("all"))
    return listed.select(F.to_json(F.struct(F.transform("all", lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"))).alias("data"))).alias("json"))
