"""References, amounts and dates in texts, and what follows from them, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, iso_date, once

# --- fixed values: the patterns of each kind of reference, English and Russian ------------------------------------------------------
DATE = r"(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|(?:19|20)[0-9]{2})"
REFERENCES = {
    "article_refs": r"(?iU)(\b(?:article|art\.?|статья|ст\.)\s*[0-9]+(?:[-.][0-9A-Za-z]+)?)",
    "law_refs": r"(?iU)(\b(?:law|act|code|закон)\s*(?:no\.?|№)?\s*[A-Za-z0-9./-]{1,24})",
    "case_refs": r"(?iU)(\b(?:case|дело)\s*(?:no\.?|№)?\s*[A-Za-z0-9./-]{1,24})",
    "dates": rf"(\b{DATE}\b)",
    "money_mentions": r"(?iU)((?:[$€£₸]|(?:usd|eur|kzt|тенге))\s*[0-9]+(?:[.,][0-9]{1,2})?)",
    "entities": r"(?U)(\b[A-ZА-Я][a-zа-я]{2,}(?:\s+[A-ZА-Я][a-zа-я]{2,}){0,2}\b)",
}
HINTS = {
    "case": ("judgment", "court", "decision", "appeal", "claim no", "дело", "решение"),
    "enactment_notice": ("enactment notice", "notice", "enactment", "commencement", "gazette", "введение"),
    "regulation": ("regulations", "regulation", "rule", "rules", "order", "bylaw", "приказ", "положение"),
    "law": ("law no", "law", "act", "code", "statute", "закон", "кодекс"),
}
STRONG = {"case": r"\bclaim\s+no\b|\bjudgment\b|\bcourt\s+of\b|\bv\s+[a-z]", "enactment_notice": r"\benactment\s+notice\b", "regulation": r"\bregulations?\b", "law": r"\blaw\s+no\b|\bdifc\s+law\b|\bcompanies\s+law\b"}
#: the later of two equal scores wins
TIES = ("other", "case", "regulation", "law", "enactment_notice")
START = r"(?iU)(?:effective\s+from|effective\s+on|in\s+force\s+from|commenc\w*\s+on|commencement\s+date|вступает\s+в\s+силу\s+с|действует\s+с)\s*[:\-]?\s*"
END = r"(?iU)(?:effective\s+until|in\s+force\s+until|valid\s+until|until|till|through|expires?\s+on|expires?|ceases?\s+to\s+have\s+effect\s+on|repealed\s+on|утрачивает\s+силу\s+с|действует\s+до|по)\s*[:\-]?\s*"
ENDED = r"(?i)\b(repealed|expired|superseded|cease)\b"
SPOKEN = r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})\b"
#: kinds of accounts: cues of a question, and the terms that a text is searched for, in turn
SCOPES = [(("new account",), ("new account",)), (("pre-existing account", "pre existing account"), ("pre-existing account", "pre existing account"))]
NUMBERED = r"(?i)\b(?:law|act|code) no\.? ?[A-Za-z0-9./-]{1,24}\b"
ANCHOR_STOPWORDS, ANCHOR_WORDS = ("law", "laws", "act", "acts", "code", "codes", "difc", "of", "the", "and", "on", "in"), 8
STRONG_CASE = r"^(?:CA|CFI|DEC|ARB|ENF)(?: \d{1,4}/|-\d{1,4}-)(?:19|20)\d{2}(?:/\d+)?$"


def ordered_distinct(values: Column, most: int | None = None) -> Column:
    """First occurrences in order, whatever their case, or the first `most` of them; inner white space is collapsed, empty ones fall away."""
    clean = F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != "")
    # sorted, equal values stand side by side: none is sought among all the others; bound once, as the filter would make the search again for every value
    keyed = F.sort_array(F.transform(clean, lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("place"), v.alias("value"))))
    first = once(keyed, lambda k: F.filter(k, lambda x, i: (i == 0) | (x["low"] != F.get(k, i - 1)["low"])))
    kept = F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["place"].alias("place"), x["value"].alias("value")))), lambda x: x["value"])
    return kept if most is None else F.slice(kept, 1, most)


def references(text: Column, most: int | None = None) -> dict[str, Column]:
    """All values of each kind in a text, or the first `most` of each."""
    t = F.coalesce(text, F.lit(""))
    return {name: ordered_distinct(F.regexp_extract_all(t, F.lit(p), 1), most) for name, p in REFERENCES.items()}


def document_type(name: Column, text: Column) -> dict[str, Column]:
    """doc_type and confidence: hint counts, 4 more for a strong pattern, ties by precedence."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", name, text)), r"[_-]+", " "), r"\s+", " ")
    # phrases are counted as substrings, single words as words
    score = {kind: sum((F.regexp_count(t, F.lit(h if " " in h else rf"(?U)\b{h}\b")) for h in hints), F.when(t.rlike(STRONG[kind]), 4).otherwise(0)) for kind, hints in HINTS.items()}
    ranked = F.array_max(F.array(*(F.struct((score[k] if k in score else F.lit(0)).cast("int").alias("score"), F.lit(i).alias("tie"), F.lit(k).alias("kind")) for i, k in enumerate(TIES))))
    none = ranked["score"] == 0
    return {"doc_type": F.when(none, "other").otherwise(ranked["kind"]), "confidence": F.when(none, 0.2).otherwise(F.least(F.lit(0.95), 0.30 + ranked["score"] * 0.12))}


def plain_date(value: Column) -> Column:
    """A date in any of the three written forms as a day; d-m-y is read day first."""
    v = F.regexp_replace(F.trim(value), r"[./]", "-")
    ymd = F.try_to_timestamp(F.when(v.rlike(r"^[0-9]{4}-"), v), F.lit("y-M-d")).cast("date")
    dmy = F.try_to_timestamp(F.when(v.rlike(r"^[0-9]{1,2}-"), v), F.lit("d-M-y")).cast("date")
    return F.coalesce(ymd, dmy, F.when(v.rlike(r"^[0-9]{4}$"), iso_date(v)))


def effective_dates(text: Column) -> dict[str, Column]:
    """The dates after the cue phrases; without one, the first date, or the latest if the text says that it ended."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "_", " ")
    found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(REFERENCES["dates"]), 1), plain_date), lambda d: d.isNotNull())
    cue = lambda p: plain_date(F.nullif(F.regexp_extract(t, f"{p}({DATE})", 1), F.lit("")))
    return {"effective_start": F.coalesce(cue(START), F.get(found, F.lit(0))), "effective_end": F.coalesce(cue(END), F.when(t.rlike(ENDED), F.array_max(found)))}


def family_anchor(summary: Column) -> Column:
    """The last words of a law's title, before its number, joined by underscores; null without a number or without such words."""
    source = collapsed(F.regexp_replace(F.coalesce(summary, F.lit("")), "_", " "))
    title = F.when(source.rlike(NUMBERED), F.get(F.split(source, NUMBERED, 2), F.lit(0)))
    words = F.filter(F.transform(F.regexp_extract_all(title, F.lit("([A-Za-z]{2,})"), 1), F.lower), lambda w: ~w.isin(*ANCHOR_STOPWORDS))
    last = F.slice(words, F.greatest(F.size(words) - (ANCHOR_WORDS - 1), F.lit(1)), ANCHOR_WORDS)
    return F.nullif(F.array_join(last, "_"), F.lit(""))


def case_identifier(case_id: Column) -> Column:
    """A case's number in capitals, without space around / and -."""
    return F.regexp_replace(F.regexp_replace(F.upper(collapsed(case_id)), " ?/ ?", "/"), " ?- ?", "-")


def version_group(doc_type: Column, law_number: Column, case_id: Column, own_id: Column, summary: Column | None = None) -> Column:
    """type:title:number of a law or regulation (without the title where the summary names none), case:id of a case with a full number, else the document itself."""
    part = lambda c: F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9._-]+", "_"), r"^_+|_+$", ""), F.lit(""))
    anchor = F.lit(None).cast("string") if summary is None else family_anchor(summary)
    number = part(law_number)
    law = F.when(doc_type.isin("law", "regulation", "enactment_notice") & number.isNotNull(), F.concat_ws(":", doc_type, anchor, number))
    name = case_identifier(case_id)
    return F.coalesce(law, F.when((doc_type == "case") & name.rlike(STRONG_CASE), F.concat(doc_type, F.lit(":"), part(name))), own_id)


def spoken_date(token: Column) -> Column:
    """The day of an ISO date or of one with the month's name, in either order; null if there is no such day."""
    t = F.initcap(F.lower(F.regexp_replace(F.regexp_replace(F.trim(token), r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1"), ",", "")))
    read = lambda form: F.try_to_timestamp(t, F.lit(form)).cast("date")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), read("yyyy-MM-dd"))
    day_first = F.when(t.rlike(r"^\d"), F.coalesce(read("d MMM yyyy"), read("d MMMM yyyy")))
    month_first = F.when(t.rlike("^[A-Z]"), F.coalesce(read("MMM d yyyy"), read("MMMM d yyyy")))
    return F.coalesce(iso, day_first, month_first)


def nearest_date(text: Column, anchor: Column) -> Column:
    """The date of a text that begins nearest to the first character of `anchor` (case does not matter), the first of equals.

    Null if the text does not hold the anchor or a date. The text is cut before each date, and the pieces' lengths are summed on the way.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\n\t]", " ")
    low, sought = F.lower(t), F.lower(anchor)
    at = F.when((sought != "") & low.contains(sought), F.instr(low, sought) - 1)
    pieces = F.split(F.regexp_replace(t, SPOKEN, "\n$0\t"), "\n")
    start = F.struct(F.lit(0).alias("place"), F.lit(None).cast("int").alias("far"), F.lit(None).cast("date").alias("day"))

    def step(acc: Column, piece: Column) -> Column:
        dated = piece.contains("\t")
        day = F.when(dated, spoken_date(F.substring_index(piece, "\t", 1)))
        far = F.abs(acc["place"] - at)
        nearer = F.coalesce(day.isNotNull() & (acc["far"].isNull() | (far < acc["far"])), F.lit(False))
        length = F.length(piece) - F.when(dated, 1).otherwise(0)
        return F.struct(
            (acc["place"] + length).cast("int").alias("place"), F.when(nearer, far).otherwise(acc["far"]).cast("int").alias("far"), F.when(nearer, day).otherwise(acc["day"]).alias("day")
        )

    return F.when(at.isNotNull(), F.aggregate(pieces, start, step, lambda acc: acc["day"]))


def scoped_date(text: Column, question: Column) -> Column:
    """The date nearest to the kind of account that a question asks about; null for other questions."""
    asked = F.lower(F.coalesce(question, F.lit("")))
    low = F.lower(F.coalesce(text, F.lit("")))
    named = [F.when(reduce(or_, (asked.contains(cue) for cue in cues)) & low.contains(term), term) for cues, terms in SCOPES for term in terms]
    return nearest_date(text, F.coalesce(*named))
