"""A training corpus from `documents`: quality filter, near-duplicate removal, line deduplication, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Null texts are scored as
empty, link with nothing and pass the other stages as null; rows with a null id are only filtered by quality; repeated rows get the same
decisions; extra columns of docs pass through until packing, which reads the id and the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import jaccard_join, line_dedup, packing, pii, rule_ensemble
from lexloom.llm.common import cut, release, rest_bucket, small_batches, table
from lexloom.llm.tokens import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, trained on the labels outside the held-out fold, scores at 0.3 or more."""
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"), "quality", rest_bucket() != 0)
    return rule_ensemble.measured(docs).where(model.score("__statistics.") >= 0.3).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of links at a Jaccard similarity of 0.75 or more."""
    groups = jaccard_join.link(docs)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_anti")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines, and the passages inside lines, that an earlier document, or an earlier line, has already."""
    return _with_text(docs, line_dedup.dedup(docs, runs=True, out=("__left", "__removed")).drop("text").withColumnRenamed("__left", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return _with_text(docs, pii.redact(docs, pii.train(pii.labelled(spark))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars (if there is one) of the changed text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*(F.col(f"`{c}`") for c in docs.columns))


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a session that hands texts to Python in small batches; the setting stays, as the result is worked out later."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(stage.__name__, _in_small_batches(stage)) for stage in (quality, near_duplicates, repeated_lines, personal_data, pack)]

#: Trained models, tokenisers and fields aren't expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return made
        before, docs = docs, cut(made)
        if hasattr(before, "cut_path"):
            release(before)
    return docs
