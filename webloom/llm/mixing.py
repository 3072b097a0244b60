"""Mixing sources to target weights, by hash-threshold histograms.

Each source gets a word budget. A document has a fixed 60-bit hash; a budget is met by taking all
documents whose hash lies at or below a threshold, so a smaller budget always takes a subset of what a
larger one takes. The threshold is found without sorting: words are summed by source and leading hash
bits, the bucket in which the running sum crosses the budget is the boundary bucket, and only that bucket
is summed again by the next bits. The sums are combined before they are shuffled, so one source with a
third of all rows costs no more than any other: at most ``2**BITS`` rows a source and task.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from webloom.llm.common import word_count
from webloom.workspace import written

#: Bits of the hash by which a histogram splits a bucket, and bits of the whole hash.
BITS, ALL_BITS = 10, 60


def _source_key(source: str = "source") -> Column:
    """The source as a key that is never null; by code point, null last."""
    return F.concat(F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(F.col(source).cast("string"), F.lit("")))


def _hash(doc_id: str = "doc_id") -> Column:
    """60 bits that depend on the id alone: reruns, and other engines, get the same."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(measured: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """One row a source: ``_src, source_size, target``.

    Sources in order of their code points (null last) take the weights in turn and share ``share`` of all
    words in proportion. A target stops at ``max_epochs`` times the source's size; what is cut off is
    shared again among the rest by weight, until no target is above. In closed form: the sources that stop
    are a prefix by size over weight. The two windows have one row a source, never one a document.
    """
    sizes = measured.groupBy("_src").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    ranked = sizes.select("_src", "source_size", (F.row_number().over(W.orderBy("_src")) - 1).alias("_at"))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % n + 1).cast("int")))
    everything = W.partitionBy()
    before = W.orderBy((F.col("source_size") / F.col("_w")), "_src").rowsBetween(W.unboundedPreceding, -1)
    total, most = F.col("_total"), F.col("source_size") * max_epochs
    ranked = ranked.withColumn("_total", F.sum("source_size").over(everything) * F.lit(share)).withColumn("_all_w", F.sum("_w").over(everything))
    ranked = ranked.withColumn("_most_before", F.coalesce(F.sum(most).over(before), F.lit(0))).withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    ranked = ranked.withColumn("_stops", most * (F.col("_all_w") - F.col("_w_before")) <= F.col("_w") * (total - F.col("_most_before")))
    spent = F.coalesce(F.sum(F.when(F.col("_stops"), most)).over(everything), F.lit(0))
    left_w = F.coalesce(F.sum(F.when(~F.col("_stops"), F.col("_w"))).over(everything), F.lit(0))
    ranked = ranked.withColumn("_left", total - spent).withColumn("_left_w", left_w)
    target = F.when(F.col("_stops"), most.cast("double")).otherwise((F.col("_w") * F.col("_left")).cast("double") / F.col("_left_w").cast("double"))
    return ranked.select("_src", "source_size", target.alias("target"))


def thresholds(measured: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``_epochs`` (times that every document is taken) and ``_cut`` (those whose hash is at
    most this are taken once more). The cut is the one whose words come nearest to the budget, save that
    documents with one hash stay together."""
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    plan = written(wanted.withColumn("_epochs", epochs).withColumn("_need", F.col("target") - F.col("_epochs") * F.col("source_size")), "mix-targets")
    open_ = plan.select("_src", "_need", F.lit(0).cast("long").alias("_path"))
    closed = None
    for level in range(ALL_BITS // BITS):
        shift = ALL_BITS - BITS * (level + 1)
        bucket = F.shiftright("_hash", shift)
        inside = measured.select("_src", "_hash", "size").where("size > 0")
        if level:
            inside = inside.join(open_.select("_src", "_path"), "_src").where(F.shiftright("_hash", shift + BITS) == F.col("_path"))
        sums = inside.groupBy("_src", bucket.alias("_bucket")).agg(F.sum("size").alias("_words"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high"))
        so_far = F.sum("_words").over(W.partitionBy("_src").orderBy("_bucket"))
        found = sums.withColumn("_sum", so_far).join(open_.select("_src", "_need"), "_src")
        before = F.col("_sum") - F.col("_words")
        found = written(
            found.where((before <= F.col("_need")) & (F.col("_sum") > F.col("_need"))).select("_src", F.col("_bucket").alias("_path"), (F.col("_need") - before).alias("_need"), "_words", "_low", "_high"),
            "mix-boundary",
        )
        single = found.where("_low = _high").select("_src", F.when(F.col("_need") * 2 >= F.col("_words"), F.col("_low")).otherwise(F.col("_low") - 1).alias("_cut"))
        closed = single if closed is None else closed.unionByName(single)
        open_ = found.where("_low < _high")
        if open_.isEmpty():
            break
    # no boundary bucket: the budget is at least what the source has
    # written, so that its size is known: documents need no shuffle to meet a few sources
    return written(plan.join(closed, "_src", "left").withColumn("_cut", F.coalesce("_cut", F.lit((1 << ALL_BITS) - 1).cast("long"))), "mix-plan")


def measure(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", _source_key().alias("_src"), _hash().alias("_hash"), word_count(F.col("text")).alias("size")), "mix-sizes")


def _copies(size: Column) -> Column:
    return F.when(size > 0, F.col("_epochs") + F.when(F.col("_hash") <= F.col("_cut"), 1).otherwise(0)).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """What the mix takes of each document: ``doc_id, size, source_size, target, taken, copies``.

    Null or wordless texts have size 0 and are taken 0 times. A null source is a source like any other, a
    null id is hashed like an empty one, and repeated rows (one id) are taken together. An empty table
    gives an empty result. Other columns of ``docs`` are not touched, whatever they are called.
    """
    sizes = measure(docs)
    cuts = thresholds(sizes, targets(sizes, weights, share, max_epochs))
    copies = _copies(F.col("size"))
    return sizes.join(cuts, "_src").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``."""
    sizes = measure(docs)
    cuts = thresholds(sizes, targets(sizes, weights, share, max_epochs))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("_row"), _source_key().alias("_src"), _hash().alias("_hash"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("_any"))
    times = _copies(F.when(F.col("_any"), 1).otherwise(0)).cast("int")
    taken = keyed.join(cuts, "_src").where(times > 0)
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), times))).select("_row.*")
