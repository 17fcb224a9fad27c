"""Cutting documents into chunks, and the links between chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal from 1, chunk) of the non-blank lines."""
    cut = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "chunk"))
    return cut.where(F.trim("chunk") != "").select(key, (F.col("pos") + 1).cast("long").alias("ordinal"), "chunk")


def linked(chunks: DataFrame, key: str, heading: Column) -> DataFrame:
    """Adds the chunks before and after, and the last heading at or before each, within a document."""
    w = Window.partitionBy(key).orderBy("ordinal")
    return chunks.withColumn("prev_ordinal", F.lag("ordinal").over(w)).withColumn("next_ordinal", F.lead("ordinal").over(w)).withColumn("heading_ordinal", F.last(F.when(heading, F.col("ordinal")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sized(docs: DataFrame, key: str, text: str, most: int = 900, least: int = 200) -> DataFrame:
    """(key, ordinal from 0, chunk): paragraphs with all white space of Unicode collapsed, those over `most` characters cut at the last space before `most` that leaves `least`, else hard.

    Paragraphs end at empty lines; no chunk runs across two, and all chunks of a text are kept. One regular expression cuts a paragraph: what is
    left goes whole if it fits, else up to a space, else at the limit. Null and blank texts give no rows.
    """
    paragraphs = F.split(F.coalesce(F.col(text), F.lit("")), "\n{2,}")
    flat = F.transform(paragraphs, collapsed)
    piece = rf"(?s) ?(.{{1,{most}}}$|.{{{least},{most - 1}}}(?= )|.{{{most}}})"
    pieces = F.flatten(F.transform(flat, lambda p: F.regexp_extract_all(p, F.lit(piece), 1)))
    return docs.select(key, F.posexplode(pieces).alias("ordinal", "chunk")).where(F.col("chunk") != "")
