"""Failure buckets of answered questions, their severity and review status, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of each failure bucket.
BUCKET_WEIGHTS = {
    "contract_or_telemetry_error": 100,
    "route_error": 90,
    "wrong_sources": 85,
    "retrieval_error": 80,
    "answerable_vs_abstain_conflict": 70,
    "compare_dimension_conflict": 65,
    "history_or_version_conflict": 60,
    "case_identity_conflict": 55,
}
CROSS_DOCUMENT, TYPED_ANSWER = 5, 5  # added for a question across documents, and for a failed name, date or number


def failure_buckets(route: Column, route_fits: Column, success: Column, contract_valid: Column, model: Column, pages: Column, abstained: Column, negative: Column, historical: Column, cross_document: Column, of_case: Column) -> Column:
    """The buckets that a run's row falls into, in the order of the rules.

    `route_fits` is null where the route has no counterpart among the expected ones; `contract_valid` null counts as valid; `negative` marks questions that
    have no answer; `of_case` questions on a case that took a case route. A null number of pages counts as none.
    """
    n = F.coalesce(pages, F.lit(0))
    lost = abstained | (n == 0)
    name = F.trim(F.coalesce(route, F.lit("")))
    rules = {
        "route_error": name.isin("", "unknown") | ~F.coalesce(route_fits, F.lit(True)),
        "contract_or_telemetry_error": ~success | ~F.coalesce(contract_valid, F.lit(True)) | (F.trim(F.coalesce(model, F.lit(""))) == ""),
        "retrieval_error": ~negative & (n == 0),
        "answerable_vs_abstain_conflict": ~negative & abstained,
        "history_or_version_conflict": historical & lost,
        "compare_dimension_conflict": cross_document & (abstained | (n < 2)),
        "case_identity_conflict": of_case & lost,
        "wrong_sources": negative & abstained & (n > 0),
    }
    return F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items())))


def severity(buckets: Column, cross_document: Column, typed: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for pair in BUCKET_WEIGHTS.items() for x in pair))
    summed = F.aggregate(F.transform(buckets, lambda b: weights[b]), F.lit(0), lambda a, w: a + w)
    return summed + F.when(cross_document, CROSS_DOCUMENT).otherwise(0) + F.when(typed & (F.size(buckets) > 0), TYPED_ANSWER).otherwise(0)


def severity_label(score: Column) -> Column:
    return F.when(score >= 140, "critical").when(score >= 100, "high").when(score >= 70, "medium").otherwise("low")


def status(score: Column, negative: Column) -> Column:
    """Review status: a question without an answer that shows no fault is an expected negative."""
    return F.when(negative & (score == 0), "expected_negative").when(score >= 100, "review_high").when(score > 0, "review").otherwise("monitor")
