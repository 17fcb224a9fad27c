"""Names of legal instruments, and what a question wants to compare, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, once, slug

# --- fixed values: words that open a title, kinds of instruments, cues of dimensions and operators -------------------------------------
TITLE_OPENINGS = (r"(?i)^(?:what|which|was|is|are|do|does|did|how|when|can|could|would|should) ", "(?i)^(?:the|a|an) ", "(?i)^(?:and|or) ")
TITLE_CLOSING = r" [?.!;,]+$"
NUMBERED = {"law": "law", "regulation": "regulation", "enactment_notice": "notice"}
DIMENSIONS = {
    "enactment_date": ("enacted", "enactment", "same year", "earlier in the year", "earlier than", "later than", "same day", "same date"),
    "commencement_date": ("commencement", "came into force", "come into force", "common commencement date", "effective date", "effective from", "in force"),
    "administering_authority": ("administer", "administering authority", "issuing authority", "authority"),
    "title_full": ("full title", "citation title", "title of", "titles of", "what is the title"),
    "definition_or_scope": ("definition", "define", "scope", "interpretation", "interpretative"),
    "penalties_or_sanctions": ("penalty", "penalties", "sanction", "sanctions", "fine", "offense"),
    "schedule_presence": ("schedule",),
    "feature_presence": ("mention", "contains", "contain", "include", "common elements", "same term", "same entity", "both"),
}
OPEN_SET = r"\bwhich laws?\b|\blaws? (?:are|that)\b"
COMPARING = ("compare", "comparison", "difference", "different", "versus", "vs", "same", "common", "earlier", "later")
OPERATORS = [
    ("earlier_than", ("earlier", "before")),
    ("later_than", ("later", "after")),
    ("same_or_common", ("same", "common", "both")),
    ("both_contain_feature", ("mention", "contains", "contain", "include")),
    ("contrast", ("difference", "compare", "versus", "vs")),
]
# ---------------------------------------------------------------------------------------------------------------------------------------


def _holds(text: Column, cues: tuple[str, ...]) -> Column:
    return reduce(or_, (text.contains(c) for c in cues))


def instrument_type(kind: Column) -> Column:
    named = lambda k: F.when(k.isin("law", "laws"), "law").when(k.isin("regulation", "regulations"), "regulation").when(k.contains("notice"), "enactment_notice").otherwise("other")
    return once(F.lower(collapsed(kind)), named)


def clean_title(title: Column) -> Column:
    """The title without question words, an article or a conjunction before it, and signs that stand alone behind it."""
    return collapsed(F.regexp_replace(reduce(lambda t, p: F.regexp_replace(t, p, ""), TITLE_OPENINGS, collapsed(title)), TITLE_CLOSING, ""))


def instrument_identifier(kind: Column, title: Column, number: Column, year: Column) -> Column:
    """kind_no_number_of_year for a law, regulation or notice; else the title's words with what there is; empty without any."""
    name = F.element_at(F.create_map(*(F.lit(x) for pair in NUMBERED.items() for x in pair)), kind)
    some = lambda c: F.when(c != "", c)

    def identifier(x: Column) -> Column:
        n, y = some(x["n"]), some(x["y"])
        dated = lambda head: F.concat(head, F.lit("_no_"), n, F.coalesce(F.concat(F.lit("_of_"), y), F.lit("")))
        # the title is looked at only where the kind and the number don't name the instrument
        titled = once(slug(clean_title(title)), lambda t: F.when(t != "", F.coalesce(dated(t), F.concat_ws("_", t, y))))
        return F.coalesce(dated(x["name"]), titled, F.lit(""))

    return once(F.struct(name.alias("name"), collapsed(number).alias("n"), collapsed(year).alias("y")), identifier)


def compare_dimensions(question: Column) -> Column:
    """What a question compares, in the order of DIMENSIONS; a question that only says that it compares asks for titles."""

    def named(q: Column) -> Column:
        found = [F.when(_holds(q, cues), name) for name, cues in DIMENSIONS.items()]
        every = F.array_compact(F.array(*found, F.when(q.rlike(OPEN_SET), "condition_satisfaction")))
        return once(every, lambda x: F.when((F.size(x) == 0) & _holds(q, COMPARING), F.array(F.lit("title_full"))).otherwise(x))

    return once(F.lower(collapsed(question)), named)


def open_set(question: Column) -> Column:
    return once(F.lower(collapsed(question)), _open)


def _open(q: Column) -> Column:
    return q.rlike(OPEN_SET) | q.contains("among these laws")


def compare_operator(question: Column, dimensions: Column) -> Column:
    """How a question compares: by the first cue, an open set of laws before all."""

    def operator(q: Column) -> Column:
        out = F.lit("unknown")
        for name, cues in reversed(OPERATORS):
            out = F.when(_holds(q, cues), name).otherwise(out)
        return F.when(_open(q) | F.array_contains(dimensions, "condition_satisfaction"), "which_satisfy_condition").otherwise(out)

    return once(F.lower(collapsed(question)), operator)


def feature_term(question: Column) -> Column:
    """The quoted words that a question looks for; empty without."""
    return F.lower(collapsed(F.regexp_extract(F.coalesce(question, F.lit("")), "['\"]([^'\"]{2,80})['\"]", 1)))


def condition_targets(question: Column) -> dict[str, Column]:
    """What an open question asks of laws: the year of enactment, the authority, quoted words (empty: nothing), and whether a schedule is needed."""
    q = collapsed(question)
    return {
        "year": F.regexp_extract(F.lower(q), r"enacted in ((?:19|20)\d{2})", 1),
        "authority": F.lower(collapsed(F.regexp_extract(q, r"(?i)administered by (?:the )?([A-Za-z][A-Za-z0-9\- ]{1,80})", 1))),
        "term": feature_term(question),
        "schedule": F.lower(q).contains("schedule"),
    }
