"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once a row however often the body names it (branches are not shared otherwise)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def query_tokens(query: Column) -> Column:
    """White-space tokens in lower case, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda t: t != "")


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, tags become spaces, white space is collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


#: White space of Unicode and the four separators of ASCII, as a class that Java and RE2 read alike.
SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
#: What is more than one plain space: a run of white space, or another sign of it alone; most texts have none and pass as they are.
_UNEVEN = SPACES + r"{2,}|[\x09-\x0D\x1C-\x1F\x{85}\p{Z}&&[^ ]]"


def collapsed(text: Column) -> Column:
    """The text with each run of white space as one space, and none at its ends; null is empty."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " "))


def slug(*parts: Column) -> Column:
    """Lower-case ASCII words joined by underscores; empty parts fall away."""
    return F.btrim(F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), r"[^a-z0-9]+", "_"), F.lit("_"))


def number_token(value: Column) -> Column:
    """The first number of a text, thousands separators removed; null without one."""
    digits = F.regexp_replace(F.regexp_extract(value, r"-?[0-9][0-9,]*(\.[0-9]+)?", 0), ",", "")
    return digits.try_cast("double")


def boolean_token(value: Column) -> Column:
    """yes, true and 1 against no, false and 0, whatever their case; anything else is null."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("yes", "true", "1"), True).when(v.isin("no", "false", "0"), False)


def iso_date(value: Column) -> Column:
    """The day of an ISO prefix, of an unambiguous d/m/y, or the first of January of a bare year; ambiguous or broken dates are null."""
    v = F.trim(value)
    iso = F.try_to_timestamp(F.regexp_extract(v, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("yyyy-MM-dd")).cast("date")
    a, b, y = (F.regexp_extract(v, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", k) for k in (1, 2, 3))
    x, z = a.cast("int"), b.cast("int")
    slash = F.when((x > 12) & (z <= 12), F.concat_ws("-", y, F.lpad(b, 2, "0"), F.lpad(a, 2, "0"))).when((z > 12) & (x <= 12), F.concat_ws("-", y, F.lpad(a, 2, "0"), F.lpad(b, 2, "0")))
    day = F.when(a != "", F.try_to_timestamp(slash, F.lit("yyyy-MM-dd")).cast("date"))
    year = F.when(v.rlike(r"^[0-9]{4}$"), F.try_to_timestamp(F.concat(v, F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date"))
    return F.coalesce(iso, day, year)


#: Fixed value: a word of Latin or Cyrillic letters, of two signs or more.
WORD = "[A-Za-zА-Яа-я][A-Za-zА-Яа-я'-]+"


def quality_features(text: Column) -> dict[str, Column]:
    """Token and word counts, shares and flags of a text."""
    t = F.coalesce(text, F.lit(""))
    tokens = F.filter(F.split(t, r"[ \t\r\n]+"), lambda x: x != "")
    words = F.regexp_extract_all(t, F.lit(f"({WORD})"), 1)
    long_words = F.filter(words, lambda w: F.length(w) >= 3)
    n = F.size(tokens)
    share = lambda k, n: F.when(n == 0, 0.0).otherwise(k / n)
    return {
        "token_count": n.cast("long"),
        "word_count": F.size(words).cast("long"),
        "alpha_ratio": share(F.size(words), n),
        "slash_ratio": once(tokens, lambda x: share(F.size(F.filter(x, lambda w: w.startswith("/"))), F.size(x))),
        "diversity": once(long_words, lambda x: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_distinct(F.transform(x, F.lower))) / F.size(x))),
    }


#: Names of operators of a page description that leaks into extracted text.
PDF_OPERATORS = ["Type", "Catalog", "Pages", "Font", "Filter", "FlateDecode", "XObject", "Subtype", "Length", "ColorSpace", "DeviceRGB"]
#: Signs of a legal text, each counted once; \\b is a border between a letter, digit or underscore and anything else.
LEGAL_MARKERS = [r"\bcase[ \t\r\n]+no\b", r"\bcourt\b", r"\bjudgment\b", r"\border\b", r"\bclaimant\b", r"\bdefendant\b", r"\bart(icle\b|\.[\p{L}\p{N}_])", r"\blaw\b", r"\bregulation\b", r"\bsection\b", r"\btribunal\b", r"\benforcement\b"]


def bordered(pattern: str) -> str:
    """The pattern with borders that Java and RE2 read alike."""
    head = r"(^|[^\p{L}\p{N}_])" if pattern.startswith(r"\b") else ""
    return head + pattern.removeprefix(r"\b").replace(r"\b", r"([^\p{L}\p{N}_]|$)")


def noise_features(text: Column) -> dict[str, Column]:
    """Shares, counts and a flag that tell extraction noise from prose, and the number of legal markers; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    tokens = F.size(F.filter(F.split(t, r"[ \t\r\n]+"), lambda x: x != ""))
    single = F.size(F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[A-Za-z]$")))
    control = F.length(t) - F.length(F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return {
        "single_letter_ratio": F.when(tokens == 0, 0.0).otherwise(single / tokens),
        "pdf_operator_hits": F.size(F.regexp_extract_all(t, F.lit("/(" + "|".join(PDF_OPERATORS) + r")([^\p{L}\p{N}_]|$)"), 1)).cast("long"),
        "legal_hits": sum((F.lower(t).rlike(bordered(p)).cast("long") for p in LEGAL_MARKERS), F.lit(0).cast("long")),
        "non_printable_ratio": control / F.greatest(F.length(t), F.lit(1)),
        "repeated_chars": t.rlike(r"([^\n])\1{10}"),
    }


def quality_score(text: Column) -> tuple[Column, Column]:
    """Score of a text from 0 to 1 and whether it counts as low in quality: prose, varied words, legal markers and length against noise.

    Under 20 tokens, or null, the score is 0. Low are texts under 80 characters, 40 tokens or 25 words, those with a character eleven times in
    a row, leaked page descriptions, and scores under 0.58.
    """
    q = quality(text)
    return q["score"], q["low_quality"]


def quality(text: Column) -> Column:
    """A struct of `quality_score`'s score and low_quality, and the features of the text without white space at its ends, each worked out once."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")

    def features(t: Column) -> Column:
        parts = {"chars": F.length(t)} | quality_features(t) | noise_features(t)
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    kept = ["legal_hits", "pdf_operator_hits", "single_letter_ratio", "repeated_chars"]
    scored = lambda f: F.struct(*(f[k].alias(k) for k in kept), *(c.alias(k) for k, c in zip(("score", "low_quality"), _quality(f))))
    return once(once(trimmed, features), scored)


def _quality(f: Column) -> tuple[Column, Column]:
    """Score and low_quality of a struct of features."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    gains = [
        (0.30, f["alpha_ratio"]),
        (0.20, unit((f["diversity"] - 0.08) / 0.25)),
        (0.25, unit(f["legal_hits"] / 4.0)),
        (0.15, unit(f["token_count"] / 900.0)),
        (0.10, unit(1.0 - f["single_letter_ratio"] / 0.35)),
    ]
    noise = F.least(F.lit(0.85), f["slash_ratio"] * 1.8 + f["non_printable_ratio"] * 8.0 + f["pdf_operator_hits"] / 40.0 + F.when(f["repeated_chars"], 0.2).otherwise(0.0))
    score = F.when(f["token_count"] < 20, 0.0).otherwise(unit(sum((c * w for w, c in gains), F.lit(0.0)) - noise))
    short = (f["chars"] < 80) | (f["token_count"] < 40) | (f["word_count"] < 25)
    leaked = ((f["pdf_operator_hits"] >= 8) & (f["legal_hits"] < 1)) | ((f["alpha_ratio"] < 0.22) & (f["slash_ratio"] > 0.08))
    return score, short | f["repeated_chars"] | leaked | (score < 0.58)
