"""Quality rules, as a ledger of rule bitmasks.

Every rule is evaluated once for each document; the ledger keeps its failure bits in one long and the
measurements behind them; ``stored`` writes it to the shared folder. A policy is a named, versioned set of rules, i.e. a mask: applying one to the
ledger is a bitwise AND, and asking what a policy would do without one of its rules is an aggregation of
such masks. Neither reads a text again. Only DataFrame functions are used, and of documents only counts by
mask leave their tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webloom.llm.common import WORD, let
from webloom.workspace import written

#: Words of a window in which repeats are sought.
WINDOW = 8

#: (name, condition of failing), in the order of their bits. New rules go to the end: bits never move.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that a document must not fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "web-2": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window found at least twice. Windows are compared by 64-bit hashes within a text."""

    def windows(hashes: Column) -> Column:
        return F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def twice(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(ordered, lambda a: F.filter(a, lambda x, j: F.coalesce((x["h"] == F.get(a, j - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(a, j + 1)["h"], F.lit(False))))
        starts = F.sort_array(F.transform(starts, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")))["n"]

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    found = let(let(hashes, windows), lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), twice(keys)).otherwise(F.lit(0)))
    return found.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failed`` (a bit a rule).

    A null text counts as an empty one: all measurements are 0. ``n_lines`` counts lines with a word. Ids
    are passed on as they are, null and repeated ones too; other columns are not read. Whole texts count.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda words: F.struct(F.size(words).cast("long").alias("n_words"), _repeat_words(words).alias("n_repeat_words")),
    )
    of_lines = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    measured = docs.select(
        "doc_id",
        counts.alias("_w"),
        of_lines.alias("_l"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
    ).select("doc_id", "_w.n_words", "word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of ``docs`` as a table in the shared folder: no policy or ablation evaluates a rule again."""
    return written(ledger(docs), "quality-ledger")


def apply_policy(kept_in: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; a document that fails a base rule is never kept."""
    base, all_ = F.lit(mask("base-1")).cast("long"), F.lit(mask(policy) | mask("base-1")).cast("long")
    return kept_in.withColumn("base_failed", F.col("failed").bitwiseAND(base) != 0).withColumn("kept", F.col("failed").bitwiseAND(all_) == 0)


def lone_failures(kept_in: DataFrame, policy: str) -> DataFrame:
    """``kept_in`` with what dropping a single rule would change: ``lone_rule`` (the one rule of the policy that
    the document fails; null if it fails none or several) and ``lone_docs`` (documents that this rule alone keeps
    out, so that would be kept without it; 0 without such a rule)."""
    alone = F.lit(None).cast("string")
    bits = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    for rule in POLICIES[policy]:
        alone = F.when(bits == BIT[rule], F.lit(rule)).otherwise(alone)
    # one row a rule
    counts = F.broadcast(written(ablations(kept_in, policy), "quality-ablations").select(F.col("rule").alias("lone_rule"), F.col("n_only").alias("_only")))
    return kept_in.withColumn("lone_rule", alone).join(counts, "lone_rule", "left").withColumn("lone_docs", F.coalesce("_only", F.lit(0).cast("long"))).drop("_only")


def ablations(kept_in: DataFrame, policy: str) -> DataFrame:
    """``rule, n_failed, n_only`` for each rule of a policy: documents that fail it, and those that would be
    kept without it. One pass over the masks: documents are first counted by mask, at most one row a mask."""
    m = F.lit(mask(policy)).cast("long")
    by_mask = kept_in.groupBy(F.col("failed").bitwiseAND(m).alias("bits")).agg(F.count("*").alias("n"))
    sums = []
    for rule in POLICIES[policy]:
        bit = F.lit(BIT[rule]).cast("long")
        sums += [F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias(f"{rule}_f"), F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), F.lit(0)).alias(f"{rule}_o")]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_f").alias("n_failed"), F.col(f"{r}_o").alias("n_only")) for r in POLICIES[policy]])
    return by_mask.agg(*sums).select(F.inline(rows))
