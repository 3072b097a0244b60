"""URL filters: rules first, then what the link graph says of the host.

Rules allow or block a host with all its subdomains, below a path. Hosts most of whose pages are allowed
(blocked) by rules are trusted (blocked) seeds. Trust spreads along links from the trusted seeds, distrust
against them from the blocked seeds (who links to a bad host is suspect), each as a personalised PageRank
over distinct host-to-host links. A host whose distrust outweighs its trust and is not negligible is
blocked wherever no rule speaks; a host without evidence is allowed.

Only DataFrame functions are used. Everything about hosts stays in tables: links are counted before they
are shuffled, each round's scores are written to the shared folder, and a host with a third of all pages
is met only by partial sums and by joins whose large partitions Spark can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from webloom.workspace import dropped, written

#: (rule, verdict): host, then the path from the first slash on.
RULES: tuple[tuple[str, str], ...] = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
DAMPING = 0.85
#: Propagation ends when a round moves no more than this share of all evidence; more rounds than this are an error.
SETTLED, MOST_ROUNDS = 1e-9, 400
#: Distrust counts from this share of the mean over hosts.
LEAST = 0.1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Target of a link: the href of an a element, quoted or not.
_HREF = r"(?i)<a\s[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``; both empty if the url is null or has no ``://``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.substring_index(F.col(url), "://", 1))
    rest = F.when(rest.isNotNull(), F.substring(F.col(url), F.length(rest) + 4, F.length(F.col(url))))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def rule_of(rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``; null if none does."""
    host, path = F.col("host"), F.col("path")
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):  # the last one wins
        name, slash, below = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + below)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rules: Sequence[tuple[str, str]] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for rule, verdict in rules:
        out = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: from how many pages of one host links go to another. Relative links stay within a host."""
    targets = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1)), lambda u: F.translate(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), _UPPER, _LOWER)), lambda h: h != ""))
    out = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("src <> dst")
    return out.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``host, score``: personalised PageRank along ``links`` (src, dst, n) from ``seeds`` (host).

    The seeds share 1. What reaches a host without links is not passed on. Rounds go on until one moves
    ``settled`` at most in all, which takes about log(settled) / log(damping) of them; it is an error if
    ``most_rounds`` don't get there.
    """
    n = seeds.count()
    start = written(seeds.select("host", F.lit(1.0 / max(n, 1)).alias("score")), "ppr-seeds")
    total = written(links.groupBy("src").agg(F.sum("n").alias("all")), "ppr-out")
    shares = written(links.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "ppr-links")
    if not n or shares.isEmpty():
        return start.withColumn("score", F.col("score") * (1 - damping))
    scores = written(start.withColumn("before", F.lit(0.0)), "ppr-0")
    for k in range(most_rounds):
        moved = shares.join(scores, shares["src"] == scores["host"]).groupBy("dst").agg((F.sum(F.col("share") * F.col("score")) * damping).alias("score"))
        parts = [
            start.select("host", (F.col("score") * (1 - damping)).alias("score"), F.lit(0.0).alias("before")),
            moved.select(F.col("dst").alias("host"), "score", F.lit(0.0).alias("before")),
            scores.select("host", F.lit(0.0).alias("score"), F.col("score").alias("before")),
        ]
        both = parts[0].unionByName(parts[1]).unionByName(parts[2])
        after = written(both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), f"ppr-{k + 1}")
        dropped(scores)
        scores = after
        if (scores.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) <= settled:
            return scores.select("host", "score")
    raise RuntimeError(f"evidence still moves after {most_rounds} rounds")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, least: float = LEAST, damping: float = DAMPING) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html
    has no links. Repeated rows count as often as they occur. No rows give no rows.
    """
    ruled = with_parts(pages.select("page_id", "url", "html")).withColumn("rule", rule_of(rules)).withColumn("_by_rule", verdict_of(rules))
    hosts = written(
        ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("_by_rule") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("_by_rule") == "block", 1)).alias("blocked")),
        "url-hosts",
    )
    links = written(host_links(ruled), "url-links")
    trust = propagate(links, hosts.where("2 * allowed > n").select("host"), damping)
    against = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(against, hosts.where("2 * blocked > n").select("host"), damping)
    mean = 1.0 / max(hosts.count(), 1)
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    scored = written(both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "url-scores")
    out = ruled.select("page_id", "host", "path", "rule", "_by_rule").join(scored, "host", "left")
    trust_, distrust_ = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when((distrust_ > trust_) & (distrust_ >= least * mean), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", by_graph).alias("verdict"), trust_.alias("trust"), distrust_.alias("distrust"))
