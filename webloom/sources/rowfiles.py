"""Tables kept as one file a row: ``key SP (column SP length SP bytes SP)*``, and the schemas built on them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webloom.functions.hashing import url_hash
from webloom.functions.url import seed_normalize


def parse_row(data: bytes) -> tuple[str, list[tuple[str, bytes]]] | None:
    """(key, [(column, value)]) of one row; None if there is no key."""

    def token(at: int) -> tuple[bytes | None, int]:
        end = data.find(b" ", at)
        stop = data.find(b"\n", at)
        if end < 0 or 0 <= stop < end:
            return None, len(data)
        return data[at:end], end + 1

    key, at = token(0)
    if key is None:
        return None
    cells = []
    while at < len(data):
        name, at = token(at)
        if name is None:
            break
        size, at = token(at)
        n = int(size or b"0")
        cells.append((name.decode("utf-8", "replace"), data[at : at + n]))
        at += n + 1
    return key.decode("utf-8", "replace"), cells


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """``key, column, value`` of all rows of a table folder; parsed in batches on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r[0], c, v.decode("utf-8", "replace")) for content in b["content"] if (r := parse_row(bytes(content))) for c, v in r[1]]
            yield pd.DataFrame(rows, columns=["key", "column", "value"], dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "key string, column string, value string")


def read_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``key`` and the named columns, null where a row has none."""
    cells = read_cells(spark, path)
    return cells.groupBy("key").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    rows = read_rows(spark, path, ["url", "responseCode", "contentType", "length", "page"])
    return rows.select(
        "key", "url", F.col("responseCode").try_cast("int").alias("response_code"), F.col("contentType").alias("content_type"), F.col("length").try_cast("long").alias("length"), "page"
    )


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """A table of (url, html) in the schema of a crawl."""
    url = seed_normalize(F.col("url"))
    return pages.select(
        url_hash(url).alias("key"),
        url.alias("url"),
        F.lit(200).alias("response_code"),
        F.lit("text/html").alias("content_type"),
        F.octet_length("html").cast("long").alias("length"),
        F.col("html").alias("page"),
    )


def dictionary(lines: DataFrame, stemmed: Column | None = None, longer_than: int = 2) -> DataFrame:
    """``word``: distinct trimmed (and stemmed) lines that are long enough."""
    word = F.trim("value") if stemmed is None else stemmed
    return lines.select(word.alias("word")).where(F.length("word") > longer_than).distinct()
