"""Connected components of a link table of any size, by alternating large and small stars.

Each round points every node to the smallest node it knows; the table of links shrinks to one star for
each component in a number of rounds that grows with the logarithm of the longest path. A node with very
many links is only ever met by a partial minimum and by a join whose large partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webloom.workspace import dropped, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v, distinct."""
    back = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    seen = links.unionByName(back) if large else links
    least = written(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    if large:  # larger neighbours move to the least of this node's
        moved = back.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u > v").distinct()
    # smaller neighbours, and the node itself, move to the least of them
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns u, v; longs) that isn't the least of its component."""
    links = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = written(links, "star-0")
    before = _state(links)
    for k in range(most_rounds):
        if not before[0]:
            break
        large = written(_star(links, True), f"star-{k}l")
        small = written(_star(large, False), f"star-{k}s")
        dropped(large)
        dropped(links)
        links = small
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
