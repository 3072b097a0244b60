"""PageRank over a link table: 0.15 + 0.85 times what comes in; mass of pages without links is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webloom.workspace import dropped, written

DAMPING = 0.85


def shares(links: DataFrame, exclude_self_links: bool = True) -> DataFrame:
    """``src, dst, share``: distinct links with one over the number of the source's links."""
    links = links.select("src", "dst").distinct()
    if exclude_self_links:
        links = links.where("src <> dst")
    degree = links.groupBy("src").agg(F.count("*").alias("n"))
    return links.join(degree, "src").select("src", "dst", (1.0 / F.col("n")).alias("share"))


def step(ranks: DataFrame, share: DataFrame) -> DataFrame:
    """One round: ``node, rank, prev``. Links to nodes that have no row give nothing."""
    came = share.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("_in"))
    return ranks.join(came, "node", "left").select("node", (1 - DAMPING + DAMPING * F.coalesce("_in", F.lit(0.0))).alias("rank"), F.col("rank").alias("prev"))


def fixed_rounds(nodes: DataFrame, links: DataFrame, rounds: int, exclude_self_links: bool = True) -> DataFrame:
    """A number of rounds as one plan; for few rounds."""
    ranks, share = nodes.select("node", F.lit(1.0).alias("rank"), F.lit(1.0).alias("prev")), shares(links, exclude_self_links)
    for _ in range(rounds):
        ranks = step(ranks, share)
    return ranks


def converged_percent(ranks: DataFrame, threshold: float) -> DataFrame:
    """``percent`` of nodes whose rank moved by ``threshold`` at most."""
    return ranks.agg((F.avg(F.when(F.abs(F.col("rank") - F.col("prev")) <= threshold, 1.0).otherwise(0.0)) * 100).alias("percent"))


def pagerank(nodes: DataFrame, links: DataFrame, threshold: float, percent: float = 100.0, exclude_self_links: bool = True, most_rounds: int = 200) -> DataFrame:
    """``node, rank, prev`` once at least ``percent`` of the nodes moved by ``threshold`` at most; an error if
    ``most_rounds`` don't get there.

    Each round is written to the shared folder, so plans stay short and a lost executor costs one round.
    """
    share = written(shares(links, exclude_self_links), "pagerank-links")
    ranks = written(nodes.select("node", F.lit(1.0).alias("rank"), F.lit(1.0).alias("prev")), "pagerank-0")
    for k in range(most_rounds):
        before, ranks = ranks, written(step(ranks, share), f"pagerank-{k + 1}")
        dropped(before)
        done = converged_percent(ranks, threshold).first()["percent"]
        if done is None or done >= percent:
            return ranks
    raise RuntimeError(f"ranks of {100 - done:.3g} % of the nodes still move after {most_rounds} rounds")
