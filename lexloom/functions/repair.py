"""Repair of text that was read from scanned pages: words in capitals that were split, and headings that repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, collapsed

# --- fixed values: words that are put together again, words that stay alone, noise, and when a line is a heading -----------------------
SPLIT_WORDS = (
    "appeal appellants between centre chief court courts dated defendant debtor dubai enforcement financial international justice martin "
    "order orders reasons upon wayne with"
).split()
ALONE = ("A", "I", "IN", "NO", "OF", "ON", "OR", "THE", "TO", "V", "X")
PDF_NAMES, PDF_OBJECTS = r"/[A-Za-z][A-Za-z0-9_-]*", r"(?i)\b\d+\s+\d+\s+obj\b"
HEADING_LETTERS, HEADING_CAPITALS, HEADING_KEY = 12, 0.78, 16
# ---------------------------------------------------------------------------------------------------------------------------------------


def _halves(first: range, least_tail: int = 2, most: int = 6) -> list[tuple[str, str]]:
    """Every way to split one of the words in two, by the length of the first part."""
    upper = [w.upper() for w in SPLIT_WORDS]
    cuts = [(w[:k], w[k:]) for w in upper for k in first if least_tail <= len(w) - k <= most]
    return [x for x in cuts if x[0] not in ALONE]


def _between(pairs: list[tuple[str, str]], left: str, right: str) -> str:
    """A pattern of the space between the two parts of any pair."""
    return "|".join(rf"(?<={left}{a}) (?={b}{right})" for a, b in pairs)


def joined_capitals(line: Column) -> Column:
    """A line (white space collapsed) with words in capitals put together: letters that stand alone before a short word, then known words in two parts."""
    begin, end = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    spelt = rf"(?<={begin}[A-Z]) (?=(?:[A-Z] )+[A-Z]{{2,6}}{end})|(?<={begin}[A-Z] [A-Z]) (?=(?:[A-Z] )*[A-Z]{{2,6}}{end})"
    letter = _between(_halves(range(1, 2)), begin, end)
    parts = _between(_halves(range(2, 7)), "(?<![^ ])", "(?![^ ])")
    out = line
    for pattern in (spelt, letter, parts):
        out = F.regexp_replace(out, pattern, "")
    return F.when(line.rlike("[A-Z] [A-Z]"), out).otherwise(line)


def preview_text(text: Column) -> Column:
    """The text in one line without the noise of its file: split capitals repaired, blank lines gone, a heading in capitals only once. Null is empty."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x00", " "), PDF_NAMES, " "), PDF_OBJECTS, " ")
    lines = F.transform(F.split(F.regexp_replace(bare, "\r\n?", "\n"), "\n"), lambda x: joined_capitals(F.btrim(F.regexp_replace(x, SPACES + "+", " "))))
    letters = lambda x: F.length(F.regexp_replace(x, r"\P{L}", ""))
    capitals = lambda x: F.length(F.regexp_replace(x, r"\P{Lu}", ""))
    key = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]+", ""))
    heads = lambda x, k: (F.length(k) >= HEADING_KEY) & (letters(x) >= HEADING_LETTERS) & (capitals(x) >= letters(x) * HEADING_CAPITALS)
    mark = lambda x, i: _once(key(x), lambda k: F.struct(F.when(heads(x, k), k).alias("key"), i.alias("i"), x.alias("line")))
    placed = lambda rows: F.transform(rows, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line")))
    # headings sorted by key and place: the first of each key stays
    first = lambda rows: F.filter(rows, lambda x, j: (j == 0) | (F.get(rows, j - 1)["key"] != x["key"]))
    unique = lambda marked: _once(F.array_sort(F.filter(marked, lambda x: x["key"].isNotNull())), first)
    kept = _once(F.transform(lines, mark), lambda marked: F.concat(placed(F.filter(marked, lambda x: x["key"].isNull())), placed(unique(marked))))
    return collapsed(F.array_join(F.transform(F.array_sort(kept), lambda x: x["line"]), " "))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
