"""Writing keyed tables and submissions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.versions import merge_by_key


def upsert(new: DataFrame, old: DataFrame | None, path: str, keys: list[str]) -> DataFrame:
    """Writes the old rows merged with the new as a version of its own under `path` and reads it; the old version stays as it is."""
    merged = new if old is None else merge_by_key(old.select(*new.columns), new, keys)
    version = f"{path}/{uuid.uuid4().hex}"
    merged.write.parquet(version)
    return new.sparkSession.read.schema(new.schema).parquet(version)


def submission(answers: DataFrame, path: str, question: str, answer: str, pages: str) -> None:
    """JSON lines of (question_id, answer, retrieved pages distinct in order), refused if an id repeats."""
    if answers.groupBy(question).count().where("count > 1").limit(1).count():
        raise ValueError("a question has more than one answer")
    answers.select(F.col(question).alias("question_id"), F.col(answer).alias("answer"), F.array_distinct(pages).alias("pages")).write.mode("errorifexists").json(path)
