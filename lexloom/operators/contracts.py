"""Contract checks of answers as arrays of issues, and the preflight over a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("boolean", "number", "date", "name", "names", "free_text")
PAGE_ID = r"^[A-Za-z0-9._-]+_[0-9]+$"


def _issues(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in checks)))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def answer_issues(text: Column, number: Column, flag: Column, names: Column, answer_type: Column, abstained: Column) -> Column:
    """The answer is a union: at most one of the four columns is set. A flag is not a number."""
    null = text.isNull() & number.isNull() & flag.isNull() & names.isNull()
    known, given = answer_type.isin(*TYPES), ~abstained & ~null
    return _issues(
        (~known, "unsupported_answer_type"),
        (known & abstained & (answer_type == "free_text") & ~null & _blank(text), "free_text_abstain_answer_must_be_non_empty_text_or_null"),
        (known & abstained & (answer_type != "free_text") & ~null, "abstain_answer_must_be_null_for_non_free_text"),
        (known & ~abstained & null, "non_abstained_answer_must_not_be_null"),
        (given & (answer_type == "boolean") & flag.isNull(), "boolean_answer_must_be_bool"),
        (given & (answer_type == "number") & number.isNull(), "number_answer_must_be_numeric"),
        (given & (answer_type == "date") & _blank(text), "date_answer_must_be_non_empty_text"),
        (given & (answer_type == "name") & _blank(text), "name_answer_must_be_non_empty_text"),
        (given & (answer_type == "free_text") & _blank(text), "free_text_answer_must_be_non_empty_text"),
        (given & (answer_type == "names") & F.coalesce(F.size(names) == 0, F.lit(True)), "names_answer_must_be_non_empty_list"),
        (given & (answer_type == "names") & F.coalesce(F.exists(names, lambda n: _blank(n)), F.lit(False)), "names_answer_items_must_be_non_empty_text"),
    )


def source_issues(sources: Column) -> Column:
    """One issue at most per used source (source_page_id, pdf_id, page_num, used)."""

    def of(s: Column, i: Column) -> Column:
        page = F.trim(F.coalesce(s["source_page_id"], F.lit("")))
        pdf = F.trim(F.coalesce(s["pdf_id"], F.lit("")))
        what = F.when(page == "", "source_page_id_missing").when(~page.rlike(PAGE_ID), "source_page_id_pattern_invalid").when(pdf == "", "pdf_id_missing").when(s["page_num"].isNull() | (s["page_num"] < 0), "page_num_invalid").when(page != F.concat(pdf, F.lit("_"), s["page_num"].cast("string")), "source_page_id_not_canonical")
        return F.when(F.coalesce(s["used"], F.lit(False)) & what.isNotNull(), F.concat(F.lit("sources["), i.cast("string"), F.lit("]."), what))

    return F.array_compact(F.transform(F.coalesce(sources, F.array()), of))


def telemetry_issues(t: Column) -> Column:
    first, total = F.coalesce(t["ttft_ms"], F.lit(0.0)), F.coalesce(t["total_response_ms"], F.lit(0.0))
    return _issues(
        (~F.coalesce(t["telemetry_complete"], F.lit(False)), "telemetry_complete_flag_false"),
        *((_blank(t[c]), f"{c}_missing") for c in ("trace_id", "model_name", "route_name", "search_profile")),
        (first < 0, "ttft_ms_negative"),
        (total < 0, "total_response_ms_negative"),
        (total < first, "total_response_ms_below_ttft_ms"),
    )


def no_answer_issues(null_answer: Column, text: Column, answer_type: Column, abstained: Column, confidence: Column, sources: Column) -> Column:
    used = F.exists(F.coalesce(sources, F.array()), lambda s: F.coalesce(s["used"], F.lit(False)))
    return _issues(
        (abstained & used, "abstained_response_must_not_have_used_sources"),
        (abstained & (F.coalesce(confidence, F.lit(0.0)) > 0), "abstained_response_confidence_must_be_zero"),
        (abstained & (answer_type == "free_text") & ~null_answer & _blank(text), "free_text_abstain_answer_must_be_non_empty_text_or_null"),
        (abstained & (answer_type != "free_text") & ~null_answer, "abstained_non_free_text_answer_must_be_null"),
    )


def merged(**parts: Column) -> Column:
    """One array with each part's name before its issues."""

    def named(name: str, issues: Column) -> Column:
        return F.transform(issues, lambda x: F.concat(F.lit(f"{name}:"), x))

    return F.flatten(F.array(*(named(name, issues) for name, issues in parts.items())))


def preflight(rows: DataFrame, issues: str) -> DataFrame:
    """Counts, pass rate and gate of a run."""
    bad = F.count_if(F.size(issues) > 0)
    return rows.agg(F.count("*").alias("n"), bad.alias("invalid"), F.coalesce(F.try_divide(F.count("*") - bad, F.count("*")), F.lit(0.0)).alias("pass_rate"), (bad == 0).alias("gate_passed"))


def used_pages(sources: Column) -> Column:
    """Ordered distinct ids of used, well-formed pages."""
    own = F.filter(F.coalesce(sources, F.array()), lambda s: F.coalesce(s["used"], F.lit(False)) & F.coalesce(F.trim(s["source_page_id"]).rlike(PAGE_ID), F.lit(False)))
    return F.array_distinct(F.transform(own, lambda s: F.trim(s["source_page_id"])))
