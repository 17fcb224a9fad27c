"""Reading questions and binary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "id string, question string, answer_type string, route_hint string"


def questions(spark: SparkSession, path: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """Questions of a JSON-lines file (or one JSON array), and the rejected rows with a reason; blank lines don't count."""
    schema = f"{QUESTION}, _corrupt string"
    rows = spark.read.schema(schema).json(path, multiLine=not lines, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE")
    reason = F.when(F.col("_corrupt").isNotNull(), "not_json").when(F.coalesce(F.trim("id"), F.lit("")) == "", "id_missing").when(F.coalesce(F.trim("question"), F.lit("")) == "", "question_missing")
    marked = rows.withColumn("reason", reason)
    good = marked.where("reason IS NULL").select("id", "question", F.coalesce("answer_type", F.lit("free_text")).alias("answer_type"), "route_hint")
    return good, marked.where("reason IS NOT NULL").select("id", "reason", F.col("_corrupt").alias("raw"))


def binary_documents(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """Files with a suffix, whatever its case: member name, sanitised id, SHA-256 of the bytes, length; equal files point to the first by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(F.lower("path").endswith(suffix)).select(name.alias("member"), F.sha2("content", 256).alias("content_hash"), "length", F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[^A-Za-z0-9._-]+", "_").alias("document_id"))
    first = rows.groupBy("content_hash").agg(F.min_by("document_id", F.lower("member")).alias("anchor"))
    return rows.join(first, "content_hash").withColumn("duplicate_group_id", F.when(F.col("document_id") != F.col("anchor"), F.col("anchor"))).drop("anchor")
