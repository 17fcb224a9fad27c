"""A fixed number of questions from families with quotas: each family's questions in a diverse order, what is missing from a spare family."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clauses import first_match

# --- fixed values: quotas, order of the result, cues of themes, families and risks ------------------------------------------------------
QUOTAS = {"law_article_lookup": 8, "law_relation_or_history": 5, "cross_law_compare": 5, "case_family": 3, "negative_or_unanswerable": 4}
SPARE, SIZE = "law_scope_or_definition", 25
ORDER = ("law_article_lookup", "law_relation_or_history", "cross_law_compare", "law_scope_or_definition", "case_family", "negative_or_unanswerable")
CASE_ROUTES = ("case_entity_lookup", "case_outcome_or_value", "case_cross_compare")
TYPED = ("number", "boolean", "name", "date")
THEMES = [
    ("title_identity", ("official law number", "title page", "cover page")),
    ("history_or_version", ("effective date", "enacted", "published", "amended", "consolidated version")),
    ("authority_or_administration", ("administers", "responsible for administering", "who administers", "who made")),
    ("numeric_requirement", ("how many", "months", "days", "years", "business days", "hours")),
    ("boolean_norm", ("void", "valid", "permitted", "can ", "does ")),
    ("identity_lookup", ("who is", "who are", "claimant", "defendant", "judge", "party")),
    ("compare_dimension", ("earlier", "higher", "common", "both cases", "both")),
    ("adversarial_no_answer", ("miranda", "jury", "plea bargain", "parole")),
]
COMPARES = r"article\s+\d+[^\n\r?]*\band article\s+\d+|between [^?]*law[^?]* and [^?]*law"
HISTORY = ("which specific difc laws were amended", "effective date", "enacted", "published", "consolidated version")
RISKS = ("effective date", "amended", "common party", "earlier", "higher", "void", "valid")
# ---------------------------------------------------------------------------------------------------------------------------------------


def _holds(text: Column, cues: tuple[str, ...]) -> Column:
    return reduce(or_, (text.contains(c) for c in cues))


def theme(question: Column, answer_type: Column) -> Column:
    """The first of THEMES whose cues the question has (a norm only for yes or no), else the type of its answer."""
    q, kind = F.lower(F.coalesce(question, F.lit(""))), F.coalesce(answer_type, F.lit(""))
    only = {"boolean_norm": kind == "boolean"}
    rules = [(name, _holds(q, cues) & only.get(name, F.lit(True))) for name, cues in THEMES]
    return first_match(rules, F.when(kind == "", "general").otherwise(kind))


def family(question: Column, route: Column, doc_types: Column) -> Column:
    """The family of a question by its expected route, the kinds of documents it aims at, and its words."""
    q, r = F.lower(F.coalesce(question, F.lit(""))), F.coalesce(route, F.lit(""))
    on_cases = F.coalesce(F.array_contains(doc_types, "case"), F.lit(False))
    rules = [
        ("negative_or_unanswerable", r == "negative_or_unanswerable"),
        ("cross_law_compare", r == "cross_law_compare"),
        ("case_family", r.isin(*CASE_ROUTES) | (on_cases & (r == "law_article_lookup"))),
        ("cross_law_compare", q.rlike(COMPARES)),
        ("law_relation_or_history", _holds(q, HISTORY) | (r == "law_relation_or_history")),
        (SPARE, r == SPARE),
    ]
    return first_match(rules, "law_article_lookup")


def risk(question: Column, chosen: Column, label: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    high = (chosen == "negative_or_unanswerable") | F.coalesce(label.isin("critical", "high"), F.lit(False)) | _holds(q, RISKS)
    return F.when(high, "high").otherwise("medium")


def build_selection(rows: DataFrame, key: str) -> DataFrame:
    """(key, family, theme, substitute, place): SIZE questions, or all that the families hold if they are too few.

    rows: (key, family, theme, route, severity, answer_type). In a family the first question of each theme comes before the others, by severity, typed
    answers first, then key; cases take one question of each of their routes first. What the quotas leave open is filled from the spare family. Only the first
    SIZE of a family are ranked on, so no family is sorted in one task; the quotas' sums are a row of one table.
    """
    typed = F.when(F.col("answer_type").isin(*TYPED), 0).otherwise(1)
    rows = rows.withColumn("__by", F.struct((-F.col("severity")).alias("severity"), typed.alias("typed"), F.col(key).alias("key")))
    # the first of a theme, or of a case route: pre-aggregated, a row for each family and group
    group = F.when(F.col("family") == "case_family", F.when(F.col("route").isin(*CASE_ROUTES), F.col("route"))).otherwise(F.nullif("theme", F.lit("")))
    rows = rows.withColumn("__group", group)
    firsts = rows.where("__group IS NOT NULL").groupBy("family", "__group").agg(F.min("__by").alias("__first"))
    rows = rows.join(firsts, ["family", "__group"], "left")
    leads = F.coalesce(F.col("__by") == F.col("__first"), F.lit(False))
    turn = F.when(~leads, len(CASE_ROUTES)).when(F.col("family") == "case_family", F.array_position(F.array(*map(F.lit, CASE_ROUTES)), F.col("route")) - 1).otherwise(0)
    ranked = rows.withColumn("__turn", turn).withColumn("__rank", F.row_number().over(Window.partitionBy("family").orderBy("__turn", "__by"))).where(F.col("__rank") <= SIZE)
    quota = F.coalesce(*(F.when(F.col("family") == f, n) for f, n in QUOTAS.items()), F.lit(0))
    taken = ranked.agg(F.coalesce(F.sum(F.when(F.col("__rank") <= quota, 1)), F.lit(0)).alias("__taken"))
    open_ = F.greatest(F.lit(SIZE) - F.col("__taken"), F.lit(0))
    chosen = ranked.crossJoin(F.broadcast(taken)).where((F.col("__rank") <= quota) | ((F.col("family") == SPARE) & (F.col("__rank") <= open_)))  # a table of one row
    order = F.array_position(F.array(*map(F.lit, ORDER)), F.col("family"))
    place = F.row_number().over(Window.orderBy(order, "__by"))  # at most SIZE rows
    return chosen.select(key, "family", "theme", (F.col("family") == SPARE).alias("substitute"), place.alias("place"))
