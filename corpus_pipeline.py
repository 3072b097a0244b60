"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.llm import lines, mixing, sentencepiece, simhash, toxicity
from webloom.llm.common import unused
from webloom.llm.queries import TOXIC, toxicity_model
from webloom.workspace import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``TOXIC`` or more go. The model is fitted on labelled rows of the whole table."""
    name = unused(docs, "_toxicity")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), name)
    return scored.where(F.col(name) < TOXIC).drop(name)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents or more share stay in one of them; every document stays, n_chars follows its text."""
    cut = lines.without_shared_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (rows with a null id always stay)."""
    found = simhash.near_duplicates(docs, root=True)
    names = F.col("doc_id") == F.col("component_id")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count(F.when(names, 1)).alias("names"))
    stays = written(ids.where("names > 0").select("doc_id", "n"), "pipeline-stays")
    # whole rows are one column on the way, so that no name of theirs clashes with those used here
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # the ids that stay grow with the corpus, so they are never broadcast: one plan at every size
    kept = rows.join(stays.hint("merge"), "doc_id").select("row", "n")
    out = kept.where("n = 1").select("row.*")
    if not stays.where("n > 1").isEmpty():  # rows that share an id: one of each component that it names
        repeated = kept.where("n > 1").select(F.col("row").alias("doc_id"), "row.text")
        marked = simhash.fingerprints(repeated).select("doc_id.doc_id", "fp", F.col("doc_id").alias("row"))
        of = found.where(names).join(stays.where("n > 1").hint("merge"), "doc_id").select("doc_id", "fp", "root").distinct()
        out = out.unionByName(marked.join(of.hint("merge"), ["doc_id", "fp"]).dropDuplicates(["doc_id", "root"]).select("row.*"))
    return out.unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_ids, ids``: what a model is trained on."""
    vocabulary = sentencepiece.Vocabulary(sentencepiece.vocabulary_path(spark))
    encoded = sentencepiece.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary)
    return encoded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Trained models, fingerprint links and token ids are beyond SQL; tests/llm/test_pipeline.py has brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
