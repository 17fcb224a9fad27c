"""How well the propositions of a candidate answer a question: weighted overlap of distinct words, the best two of each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed
from .joins import spread_join

# --- fixed values: words, words that say nothing in a question, weights ----------------------------------------------------------------
TOKEN = r"([A-Za-z0-9][A-Za-z0-9_.()/:-]+)"
STOPWORDS = ("the", "a", "an", "of", "to", "under", "this", "that", "is", "are", "by", "with", "their", "any")
CITED_ARTICLE, CITED_CASE, ELIGIBLE, BOOST = 0.2, 0.2, 0.05, 0.45
# ---------------------------------------------------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(collapsed(text), F.lit(TOKEN), 1), F.lower))


def signal_tokens(question: Column) -> Column:
    """The distinct words of a question that say something."""
    return F.array_except(tokens(question), F.array(*map(F.lit, STOPWORDS)))


def match_features(pairs: DataFrame, questions: DataFrame, assertions: DataFrame, question: str, candidate: str, salts: int = 16) -> DataFrame:
    """pairs (question, candidate) with the best and the second proposition of the candidate for the question.

    questions: (question, text, article_refs, case_numbers); assertions: (candidate, place, words, citations, eligible) with `words` all that a proposition
    says, as text. A proposition scores the share of the question's words that it holds, more if it cites an article or case that the question
    names, and if it may answer directly. Of equal scores the first by `place` wins. A candidate without propositions scores nothing; repeated pairs
    count once; nulls are empty. Candidates with very many propositions are dealt over several tasks.
    """
    none = F.array().cast("array<string>")
    asked = questions.select(question, signal_tokens(F.col("text")).alias("asked"), F.coalesce("article_refs", none).alias("articles"), F.coalesce("case_numbers", none).alias("cases"))
    held = assertions.select(candidate, "place", tokens(F.col("words")).alias("held"), F.coalesce("citations", none).alias("citations"), F.coalesce("eligible", F.lit(False)).alias("eligible"))
    met = spread_join(held, pairs.distinct(), [candidate], salts).join(asked, question)
    cites = lambda refs, change: F.arrays_overlap(F.transform(refs, change), F.transform("citations", change))
    bonus = lambda hit, weight: F.when(F.coalesce(hit, F.lit(False)), weight).otherwise(0.0)
    share = F.size(F.array_intersect("asked", "held")).cast("double") / F.greatest(F.size("asked"), F.lit(1))
    score = share + bonus(cites("articles", F.lower), CITED_ARTICLE) + bonus(cites("cases", F.upper), CITED_CASE) + bonus(F.col("eligible"), ELIGIBLE)
    rank = F.row_number().over(Window.partitionBy(question, candidate).orderBy(F.col("score").desc(), "place"))
    best = met.select(question, candidate, "place", score.alias("score"), F.size("asked").alias("n")).withColumn("rank", rank).where("rank <= 2")
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    found = best.groupBy(question, candidate).agg(at(1, "score").alias("top"), at(2, "score").alias("second"), at(1, "place").alias("top_place"), F.max("n").alias("n"))
    out = pairs.distinct().join(found, [question, candidate], "left")
    top = F.coalesce("top", F.lit(0.0))
    return out.select(
        question,
        candidate,
        "top_place",
        F.least(F.lit(BOOST), top * BOOST).alias("boost"),
        F.coalesce(F.bround(top * F.col("n")).cast("int"), F.lit(0)).alias("terms_hit"),
        F.round(top, 4).alias("top_score"),
        F.round(F.coalesce("second", F.lit(0.0)), 4).alias("second_score"),
    )
