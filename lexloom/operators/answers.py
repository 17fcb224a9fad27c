"""From ranked candidates to typed answers with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once

#: fixed values: what each structural match adds to a candidate's score
BOOSTS = {"exact_identifier": 0.35, "current_version": 0.06, "lineage": 0.15, "article": 0.2, "law_number": 0.15, "law_year": 0.08, "law_title": 0.12, "doc_type": 0.05, "case_number": 0.2, "structural": 0.5}


def rerank(candidates: DataFrame, question: str, key: str, score: str, matches: dict[str, str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the boosts of the match columns and ranks each question's candidates, one row per key."""
    boosted = F.col(score)
    for name, column in matches.items():
        boosted = boosted + F.when(F.coalesce(F.col(column), F.lit(False)), BOOSTS[name]).otherwise(0.0)
    rows = candidates.withColumn("boosted_score", boosted)
    order = [F.col("boosted_score").desc(), *(F.col(t) for t in ties)]
    one = rows.withColumn("__n", F.row_number().over(Window.partitionBy(question, key).orderBy(*order))).where("__n = 1").drop("__n")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(question).orderBy(*order, F.col(key))))


def unanimous(candidates: DataFrame, question: str, value: str) -> DataFrame:
    """The only distinct value of each question's candidates; none or several abstain."""
    values = candidates.groupBy(question).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("considered"))
    sure = F.col("lo").isNotNull() & (F.col("lo") == F.col("hi"))
    return values.select(question, F.when(sure, F.col("lo")).alias("answer"), (~sure).alias("abstained"), "considered")


def boolean_vote(candidates: DataFrame, question: str, text: str, positive: str, negative: str) -> DataFrame:
    """True if candidates match `positive` and none `negative` (which goes first), false the other way round, else abstain."""
    no = F.coalesce(F.col(text).rlike(negative), F.lit(False))
    yes = F.coalesce(F.col(text).rlike(positive), F.lit(False)) & ~no
    votes = candidates.groupBy(question).agg(F.count_if(yes).alias("yes"), F.count_if(no).alias("no"))
    answer = F.when((F.col("yes") > 0) & (F.col("no") == 0), True).when((F.col("no") > 0) & (F.col("yes") == 0), False)
    return votes.select(question, answer.alias("answer"), answer.isNull().alias("abstained"), "yes", "no")


def name_union(candidates: DataFrame, question: str, names: str) -> DataFrame:
    """All candidates' names, distinct and in order."""
    listed = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(names)), lambda n: F.trim(n) != "")))
    return candidates.groupBy(question).agg(listed.alias("answer")).withColumn("abstained", F.size("answer") == 0)


def abstain_reason(abstained: Column, answer_type: Column, top: Column, gap: Column, pages: Column, exact: Column, agreeing: Column) -> Column:
    """Why a question stays unanswered: no support, no unique value, a conflict, or a text that rests on weak retrieval; null if answered."""
    weak = (answer_type == "free_text") & (top < 0.35) & (gap < 0.05) & (pages >= 3) & (exact == 0)
    return F.when(abstained, F.when(top <= 0, "no_corpus_support").when(agreeing <= 0, "insufficient_uniqueness").otherwise("conflicting_evidence")).when(weak, "low_retrieval_quality")


def evidence_cover(refs: DataFrame, question: str, page: str, score: str, keywords: str, exact: str, limit: int = 2) -> DataFrame:
    """(question, page, place, gain): pages picked one at a time by best score + 0.25 for each keyword not yet covered + 0.45 for an exact hit.

    A question's pages are an array of one entry a page, picked from in a fold; ties go to the better score, then the page's name. Null pages fall away.
    """
    words = refs.where(F.col(page).isNotNull()).select(question, page, score, F.col(exact).cast("int").alias("x"), F.explode_outer(keywords).alias("word"))
    pages = words.groupBy(question, page).agg(F.max(score).cast("double").alias("best"), F.collect_set("word").alias("words"), F.max("x").alias("exact"))
    listed = pages.groupBy(question).agg(F.collect_list(F.struct("best", "words", "exact", F.col(page).alias("page"))).alias("left"))
    kind = dict(refs.dtypes)[page]
    picked = f"array<struct<page: {kind}, place: int, gain: double>>"

    def step(acc: Column, turn: Column) -> Column:
        gain = lambda p: p["best"] + 0.25 * F.size(F.array_intersect(p["words"], acc["open"])) + 0.45 * F.coalesce(p["exact"], F.lit(0))
        # the least of (-gain, -score, page) is the best page
        every = F.array_min(F.transform(acc["left"], lambda p: F.struct((-gain(p)).alias("gain"), (-p["best"]).alias("best"), p["page"].alias("page"), p["words"].alias("words"))))

        def picks(best: Column) -> Column:
            more = F.array(F.struct(best["page"].alias("page"), turn.alias("place"), (-best["gain"]).alias("gain"))).cast(picked)
            return F.struct(F.filter(acc["left"], lambda p: p["page"] != best["page"]).alias("left"), F.array_except(acc["open"], best["words"]).alias("open"), F.concat(acc["out"], more).alias("out"))

        # the best page is bound once: named inside the filter it would be sought again for every page
        return F.when(F.size(acc["left"]) == 0, acc).otherwise(once(every, picks))

    every = F.array_distinct(F.flatten(F.transform("left", lambda p: p["words"])))
    start = F.struct(F.col("left").alias("left"), every.alias("open"), F.array().cast(picked).alias("out"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step, lambda acc: acc["out"])
    return listed.select(question, F.explode(found).alias("p")).select(question, F.col("p.page").alias(page), "p.place", "p.gain")
