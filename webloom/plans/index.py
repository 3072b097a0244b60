"""Inverted index and TF-IDF over crawled pages (``url, page``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from webloom.functions.html import heading_paragraph_words, html_text, page_words, words_of
from webloom.functions.stem import porter_stem
from webloom.workspace import partitions, written


def postings(crawl: DataFrame) -> DataFrame:
    """``term, url``: the distinct words of each page, once a row of the page."""
    return crawl.where("page is not null and url is not null").select(F.explode(page_words(F.col("page"))).alias("term"), "url")


def inverted_index(crawl: DataFrame) -> DataFrame:
    """``term, urls`` in order of url: a word that very many pages have is one long row; see ``posting_blocks``."""
    return postings(crawl).groupBy("term").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def posting_blocks(crawl: DataFrame, size: int = 10_000) -> DataFrame:
    """``term, block, urls``: the same postings in blocks of about ``size`` urls, dealt by a hash of the url."""
    own = written(postings(crawl).distinct(), "postings")
    n = own.groupBy("term").agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = F.pmod(F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 8), 16, 10).cast("long"), F.col("blocks"))
    return own.join(n, "term").groupBy("term", dealt.alias("block")).agg(F.array_sort(F.collect_list("url")).alias("urls"))


def term_frequencies(of_page: DataFrame) -> DataFrame:
    """``url, term, tf`` of ``url, words, total``: occurrences over the total; pages with a total of 0 give none."""
    each = of_page.where("total <> 0").select("url", "total", F.explode("words").alias("term"))
    counted = each.groupBy("url", "term", "total").agg(F.count("*").alias("n"))
    return counted.select("url", "term", (F.col("n") / F.col("total")).alias("tf"))


def html_term_frequencies(crawl: DataFrame) -> DataFrame:
    # step by step: each column is evaluated once a page, not once a use or an exploded row
    text = crawl.where("page is not null").select("url", html_text(F.col("page")).alias("text"))
    split = text.select("url", words_of(F.col("text")).alias("words"), F.col("text").startswith(" ").alias("gap"))
    return term_frequencies(split.select("url", "words", (F.size("words") - F.when(F.col("gap"), 0).otherwise(1)).alias("total")))


def heading_paragraph_term_frequencies(crawl: DataFrame, dictionary: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """Divided by the number of words less one. With a dictionary (``word``) only its words count; with
    ``stemmed`` words are stemmed before the dictionary is asked, and once more after."""
    words = heading_paragraph_words(F.col("page"))
    if dictionary is None and not stemmed:
        split = crawl.where("page is not null").select("url", words.alias("words"))
        return term_frequencies(split.select("url", "words", (F.size("words") - 1).alias("total")))
    # written, so that pages are parsed once: an explode evaluates its words a second time, to skip empty ones
    pages = written(crawl.where("page is not null and url is not null").select("url", words.alias("words")), "words")
    each = pages.select("url", F.explode("words").alias("raw"))
    kept = known_terms(each.select("raw").distinct(), dictionary, stemmed)
    found = each.groupBy("url", "raw").agg(F.count("*").alias("n")).join(kept, "raw")
    # one shuffle by url for both sums; a page has as many rows as distinct words
    counted = found.repartition("url").groupBy("url", "term", "known").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("_total", F.sum("n").over(Window.partitionBy("url")) - 1)
    return counted.where("known and _total <> 0").select("url", "term", (F.col("n") / F.col("_total")).alias("tf"))


def known_terms(raws: DataFrame, dictionary: DataFrame | None, stemmed: bool) -> DataFrame:
    """``raw, term, known`` of the distinct words that count: those in the dictionary, as it finds them stemmed once;
    ``term`` is stemmed once more, and known if the dictionary has that too."""
    again = porter_stem if stemmed else lambda x: x
    if stemmed:
        # partitions that are not merged, since stemming costs more than the bytes of the words tell; and written, since a
        # join would be pushed below the distinct, where every occurrence would be stemmed
        stems = written(raws.repartition(partitions(raws.sparkSession), F.xxhash64("raw")).select("raw", porter_stem(F.col("raw")).alias("once")), "stems")
    else:
        stems = raws.withColumn("once", F.col("raw"))
    if dictionary is None:
        once = stems.select("once").distinct()
        terms = once.select("once", again(F.col("once")).alias("term"), F.lit(True).alias("known"))
    else:
        words = written(dictionary.select("word").distinct(), "dictionary")
        terms = words.select(F.col("word").alias("once"), again(F.col("word")).alias("term"))
        terms = terms.join(words.select(F.col("word").alias("term"), F.lit(True).alias("known")), "term", "left").select("once", "term", F.coalesce("known", F.lit(False)).alias("known"))
    return written(stems.join(written(terms, "terms"), "once").select("raw", "term", "known"), "known-terms")


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(tf: DataFrame, n_docs: int | Column) -> DataFrame:
    """``term, url, tfidf``: tf times ln(N / df)."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    tf = written(tf, "tf")  # read twice, and dear to compute
    return tf.join(document_frequencies(tf), "term").select("term", "url", (F.col("tf") * F.ln(n / F.col("df"))).alias("tfidf"))


def crawl_size(crawl: DataFrame) -> Column:
    """Rows of the crawl, those without a page too, as a scalar subquery."""
    return crawl.agg(F.count("*").alias("n")).scalar()
