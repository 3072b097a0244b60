"""The queries ``opN_<name>``: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.llm import language, lines, mixing, quality, sentencepiece, simhash, substrings, topk, toxicity, urls
from webloom.llm.common import bucket_of_id, table

#: Score from which a document counts as toxic.
TOXIC = 0.7


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepiece.Vocabulary(sentencepiece.vocabulary_path(spark))
    return sentencepiece.encoding_report(table(spark, sf_dir, "documents"), vocabulary)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, sf_dir, "documents"), texts=False)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, bucket_of_id("doc_id", 4) != 2)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (bucket_of_id("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = quality.stored(table(spark, sf_dir, "documents"))
    judged = quality.apply_policy(quality.lone_failures(own, "web-2"), "web-2")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "lone_rule", "lone_docs")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled rows that aren't held out."""
    allowed = bucket_of_id("doc_id", 3) != 1
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), allowed)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (bucket_of_id("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
}
