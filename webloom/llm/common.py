"""Definitions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webloom.workspace import written

#: A word: a longest run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is then evaluated once however often x is used."""
    return F.transform(F.array(value), body)[0]


def bucket_of_id(name: str, modulus: int) -> Column:
    """CRC-32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hash_sample(rows: DataFrame, group: str, n: int, place: Column) -> DataFrame:
    """The rows of each group whose ``place`` (a 64-bit hash) lies below a threshold that leaves about ``n`` places.

    Groups are only counted (distinct places, by a sketch of fixed size), so no group meets in one task and
    repeated rows don't crowd out others. The row with the least hash is always taken, so no group is lost.
    A sample has n distinct places but for the sketch's 2 % and chance: beyond n + 1,000 or 1.3 n, whichever
    is more, there are none in practice.
    """
    at = F.shiftrightunsigned(place, 33)
    counted = rows.groupBy(group).agg(F.approx_count_distinct(at, 0.02).alias("_places"), F.min(at).alias("_least"))
    # written, so that its size is known and rows meet it before any shuffle
    limits = written(counted.select(group, F.greatest(F.col("_least"), F.floor(F.lit(float(n) * (1 << 31)) / F.col("_places")) - 1).alias("_limit")), "sample-limits")
    return rows.withColumn("_at", at).join(limits, group).where("_at <= _limit").select(*rows.columns)
