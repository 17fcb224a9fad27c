"""Scores of answers and sources as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BETA = 2.5


def fbeta(hits: Column, predicted: Column, gold: Column, beta: float = BETA) -> Column:
    """F-beta from counts: 1 if both sides are empty, 0 if only one is or nothing meets."""
    p, r, b = hits / predicted, hits / gold, beta * beta
    return F.when((predicted == 0) & (gold == 0), 1.0).when((predicted == 0) | (gold == 0) | (hits == 0), 0.0).otherwise((1 + b) * p * r / (b * p + r))


def overlap(predicted: Column, gold: Column, beta: float = BETA) -> dict[str, Column]:
    """Set precision, recall and F-beta of two arrays (null counts as empty)."""
    p, g = F.array_distinct(F.coalesce(predicted, F.array())), F.array_distinct(F.coalesce(gold, F.array()))
    hits, n, m = F.size(F.array_intersect(p, g)), F.size(p), F.size(g)
    one_sided = lambda by: F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(hits / by)
    return {"precision": one_sided(n), "recall": one_sided(m), "f_beta": fbeta(hits, n, m, beta)}


def list_answer_score(answer: Column, expected: Column, abstained: Column) -> Column:
    """Abstaining is right only without an expected answer; equal sets give 1, else the share of the expected items that were found."""
    a, e = F.array_distinct(F.coalesce(answer, F.array())), F.array_distinct(F.coalesce(expected, F.array()))
    found = F.size(F.array_intersect(a, e)) / F.size(e)
    return F.when(abstained, F.when(expected.isNull(), 1.0).otherwise(0.0)).when(F.size(e) == 0, F.when(F.size(a) == 0, 1.0).otherwise(0.0)).otherwise(F.when(F.size(F.array_except(a, e)) + F.size(F.array_except(e, a)) == 0, 1.0).otherwise(found))


def latency_factor(ms: Column, best_seconds: float = 1.0, best: float = 1.05, worst_seconds: float = 5.0, worst: float = 0.85) -> Column:
    """Linear from `best` at best_seconds or less to `worst` at worst_seconds or more."""
    s = ms / 1000.0
    return F.when(s <= best_seconds, best).when(s >= worst_seconds, worst).otherwise(best + (s - best_seconds) / (worst_seconds - best_seconds) * (worst - best))


def error_tags(answer_score: Column, precision: Column, recall: Column, cited: Column, factor: Column, telemetry_complete: Column, abstained: Column, has_gold: Column, valid: dict[str, Column]) -> Column:
    """Error tags of an answer, in a fixed order. `valid` may hold `answer_schema`, `source_page_id`, `telemetry_contract` and `no_answer_form`, each true where
    the check passed; missing or null checks count as passed. Sources are overcited only where some were cited."""
    failed = lambda name: ~F.coalesce(valid.get(name, F.lit(True)), F.lit(True))
    tags = {
        "answer_mismatch": answer_score < 1,
        "answer_schema_invalid": failed("answer_schema"),
        "missing_primary_source": recall < 1,
        "overcited_sources": (precision < 1) & (cited > 0),
        "invalid_source_page_id": failed("source_page_id"),
        "telemetry_incomplete": ~telemetry_complete | failed("telemetry_contract"),
        "ttft_slow": factor < 1,
        "abstain_mismatch": abstained == has_gold,
        "no_answer_form_invalid": failed("no_answer_form"),
    }
    return F.array_compact(F.array(*(F.when(c, name) for name, c in tags.items())))
