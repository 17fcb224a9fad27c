"""Question routing as column expressions: signals, an ordered rule table, sub-routes and retrieval budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the words and patterns that define the signals --------------------------------------------------------------------
WORDS = {
    "compare": ("compare", "difference", "compared to", "versus"),
    "history": ("history", "amended", "amended by", "repealed", "repeal", "amendment", "amendment law", "supersede", "superseded", "modify", "modified", "latest law", "previous law", "version", "consolidated version", "enactment notice", "enacted", "enacted on", "enactment date", "came into force", "came in force", "commencement", "commenced", "effective date", "authority to make", "conferring powers", "what law did it amend"),
    "lineage": ("amended by", "amendment law", "enacted", "repealed by", "repealed", "superseded by", "superseded", "supersedes", "enacted on", "enactment date", "came into force", "commencement date", "previous version", "latest law"),
    "article": ("article", "clause", "section", "paragraph", "schedule"),
    "case": ("case", "court", "judge", "appeal"),
    "negative": ("jury", "parole", "miranda", "plea bargain"),
    "entity": ("claimant", "respondent", "party", "parties", "judge", "entity", "individual"),
    "case_compare": ("same judge", "in common", "common to both", "both cases", "both case", "appeared in both", "any of the same", "main party", "earlier", "later", "issued first", "higher monetary amount", "higher amount"),
    "law_compare": ("compare", "versus", "difference between", "common elements", "same year", "earlier in the year", "earlier than", "later than", "same day", "same date", "common commencement date", "same authority", "same entity", "which of the laws", "among these laws", "titles of"),
    "law_plural": ("which laws", "both laws"),
    "law_filter": ("mention", "administer", "title", "common elements", "same year", "same authority", "same entity", "earlier", "later", "date"),
    "temporal": ("same year", "earlier in the year", "earlier than", "later than", "same day", "same date", "common commencement date"),
    "provision": ("according to article", "under article"),
}
PATTERNS = {
    "case_ref": r"(?i)\b(?:cfi|ca|arb|tcd|enf|dec|sct)\s*\d{1,3}/\d{4}\b",
    "law_ref": r"(?i)\blaw\s+no\.?\s*\d+\s+of\s+\d{4}\b",
    "law_word": r"(?i)\blaws?\b",
    "regulation_word": r"(?i)\bregulations?\b",
    "provision": r"(?i)\b(article|section|paragraph|clause|schedule)\s+\d",
}
#: route: profile, multiplier, most candidate pages, used pages (short answers, texts), milliseconds, structural lookup, lineage expansion
PROFILES = {
    "article_lookup": ("article_lookup_recall_v2", 2.0, 16, 2, 3, 1500, True, False),
    "single_case_extraction": ("single_case_extraction_compact_v2", 1.5, 12, 2, 3, 1800, False, False),
    "history_lineage": ("history_lineage_graph_v1", 2.0, 20, 4, 5, 2200, False, True),
    "cross_case_compare": ("cross_case_compare_pairwise_v1", 2.0, 18, 3, 4, 2100, True, False),
    "cross_law_compare": ("cross_law_compare_matrix_v1", 2.5, 24, 4, 5, 2300, True, True),
    "no_answer": ("no_answer_fast_path_v1", 0.0, 0, 0, 0, 400, False, False),
}
DEFAULT_PROFILE = ("default_compare_v1", 1.0, 100, 2, 2, 3000, False, False)
SHORT_ANSWERS = ("boolean", "number", "date", "name", "names")


def signals(question: Column) -> dict[str, Column]:
    t = F.lower(F.coalesce(question, F.lit("")))
    any_of = {k: t.rlike("|".join(words)) for k, words in WORDS.items()}  # one search for all words keeps the generated code small
    count = {k: F.regexp_count(t, F.lit(p)) for k, p in PATTERNS.items()}
    many_laws = (count["law_ref"] >= 2) | (count["law_word"] >= 2) | (count["regulation_word"] >= 2)
    has_law, has_rule = count["law_word"] > 0, count["regulation_word"] > 0
    has_case, many_cases = (count["case_ref"] > 0) | any_of["case"], count["case_ref"] >= 2
    provision = (count["provision"] > 0) | any_of["provision"]
    history = any_of["history"] & ~any_of["temporal"]
    administered = t.contains("administer") & ~provision & (many_laws | any_of["law_plural"] | t.contains("same entity") | t.contains("same authority"))
    framing = any_of["law_compare"] | any_of["compare"] | administered | (any_of["law_plural"] & (any_of["law_filter"] | any_of["temporal"] | many_laws))
    joined = t.contains(" and ") | t.contains(" or ") | t.contains("between ")
    return {
        "compare": any_of["compare"],
        "history": any_of["history"],
        "strong_history": history,
        "lineage": any_of["lineage"],
        "article": any_of["article"],
        "provision": provision,
        "case": has_case,
        "negative": any_of["negative"],
        "entity": any_of["entity"],
        "law": has_law,
        "regulation": has_rule,
        "notice": t.contains("enactment notice"),
        "temporal": any_of["temporal"],
        "cross_case": has_case & many_cases & (any_of["compare"] | any_of["case_compare"] | joined),
        "cross_law": (has_law | has_rule) & (many_laws | any_of["law_plural"]) & framing & ~(history & ~any_of["compare"] & ~any_of["law_compare"]),
    }


def decide(question: Column, hint: Column | None = None) -> dict[str, Column]:
    """route, rule and confidence: the first rule that holds; a hint goes before all."""
    s = signals(question)
    rules = [
        (s["cross_case"], "cross_case_compare", "cross_case_compare_signal", 0.93),
        (s["cross_law"], "cross_law_compare", "cross_law_compare_signal", 0.92),
        (s["negative"], "no_answer", "strong_negative_signal", 0.94),
        (s["strong_history"] & s["lineage"] & ~s["compare"], "history_lineage", "strong_history_lineage_signal", 0.9),
        (s["provision"], "article_lookup", "strong_provision_lookup", 0.9),
        (s["history"], "history_lineage", "history", 0.85),
        (s["article"], "article_lookup", "article", 0.85),
        (s["case"], "single_case_extraction", "single_case", 0.8),
    ]
    rules.append((F.lit(True), "article_lookup", "default_article_lookup", 0.6))
    index = F.when(rules[0][0], 1)
    for i, rule in enumerate(rules[1:], 2):
        index = index.when(rule[0], i)
    hinted = F.lit(False) if hint is None else F.coalesce(hint != "", F.lit(False))
    pick = lambda k, first: F.when(hinted, first).otherwise(F.element_at(F.array(*(F.lit(r[k]) for r in rules)), index))
    return {"route": pick(1, F.lit(None).cast("string") if hint is None else hint), "rule": pick(2, F.lit("route_hint")), "confidence": pick(3, F.lit(0.99))}


def subroute(route: Column, s: dict[str, Column], answer_type: Column) -> Column:
    """The finer class of a routed question."""
    cases = F.when(s["cross_case"], "case_cross_compare").when(s["negative"], "negative_or_unanswerable").when(answer_type.isin("name", "names") & s["entity"], "case_entity_lookup").otherwise("case_outcome_or_value")
    articles = F.when(s["cross_law"], "cross_law_compare").when(s["negative"], "negative_or_unanswerable").when(s["provision"], "law_article_lookup").when(s["history"], "law_relation_or_history").when(s["article"], "law_article_lookup").otherwise("law_scope_or_definition")
    laws = F.when(s["strong_history"] & ~s["compare"], "law_relation_or_history").otherwise("cross_law_compare")
    return F.when(route == "cross_case_compare", "case_cross_compare").when(route == "cross_law_compare", laws).when(route == "history_lineage", "law_relation_or_history").when(route == "no_answer", "negative_or_unanswerable").when(route == "single_case_extraction", cases).when(route == "article_lookup", articles)


def budget(route: Column, max_pages: Column, answer_type: Column) -> dict[str, Column]:
    """profile, candidate and used pages, and the latency budget of a route."""

    def look(k: int) -> Column:
        out = None
        for name, profile in PROFILES.items():
            out = F.when(route == name, profile[k]) if out is None else out.when(route == name, profile[k])
        return out.otherwise(DEFAULT_PROFILE[k])

    base = F.least(F.greatest(max_pages, F.lit(1)), F.lit(100))
    candidates = F.least(look(2), F.greatest(base, F.bround(base * look(1)).cast("int")))
    # a compact case profile gives yes-or-no answers the longer allowance
    short = answer_type.isin(*SHORT_ANSWERS) & ~((route == "single_case_extraction") & (answer_type == "boolean"))
    return {"profile": look(0), "candidate_pages": candidates, "used_pages": F.least(F.when(short, look(3)).otherwise(look(4)), candidates), "budget_ms": look(5), "structural": look(6), "lineage": look(7)}
