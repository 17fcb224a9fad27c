"""Matching of texts against a registry of names: every alias in one pass over a text, then the entry that comes first.

The aliases are an automaton that each task builds once from the registry (a parameter, bounded by `most_aliases`); a text of any length
is read once, whatever their number. Which entry wins, and what follows from it, are column expressions over the numbers of the aliases found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed


@dataclass(frozen=True)
class Entry:
    """A name with its aliases; `fields` are what a match gives, `prefixes` open the numbers of its cases."""

    key: str
    aliases: tuple[str, ...]
    prefixes: tuple[str, ...] = ()
    last: bool = False
    fields: dict[str, str | None] = field(default_factory=dict)


# --- fixed values: the registry of courts and streams of documents ---------------------------------------------------------------------
def _court(key: str, name: str, level: str, kind: str, prefixes: tuple[str, ...], aliases: tuple[str, ...]) -> Entry:
    division = name if kind == "division" else None
    return Entry(key, aliases, prefixes, kind == "division", {"court_name": name, "court_level": level, "court_kind": kind, "court_division_name": division})


COURTS = (
    _court("difc_court_of_appeal", "Court of Appeal", "Court of Appeal", "court", ("CA",), ("COURT OF APPEAL", "COURT OF APPEAL - ORDERS")),
    _court("difc_court_of_first_instance", "Court of First Instance", "Court of First Instance", "court", ("CFI", "ARB"), ("COURT OF FIRST INSTANCE", "COURT OF FIRST INSTANCE - ORDERS")),
    _court("difc_small_claims_tribunal", "Small Claims Tribunal", "Small Claims Tribunal", "tribunal", ("S CT", "SCT"), ("SMALL CLAIMS TRIBUNAL", "SCT - JUDGMENTS AND ORDERS", "SCT - ORDERS", "SCT - JUDGMENTS")),
    _court(
        "difc_digital_economy_court_division", "Digital Economy Court Division", "Court of First Instance", "division", ("DEC",),
        ("DIGITAL ECONOMY COURT", "DIGITAL ECONOMY COURT - ORDERS", "DIGITAL ECONOMY COURT - JUDGMENTS"),
    ),
    _court(
        "difc_technology_and_construction_division", "Technology & Construction Division", "Court of First Instance", "division", ("TCD",),
        ("TECHNOLOGY AND CONSTRUCTION DIVISION", "TECHNOLOGY AND CONSTRUCTION DIVISION - ORDERS", "TECHNOLOGY & CONSTRUCTION DIVISION", "TECHNOLOGY & CONSTRUCTION DIVISION - ORDERS"),
    ),
)
STREAMS = (
    Entry("orders", (" - ORDERS", " ORDERS")),
    Entry("judgments", (" - JUDGMENTS", " JUDGMENTS")),
    Entry("judgments_and_orders", ("JUDGMENTS AND ORDERS",)),
    Entry("order_with_reasons", ("ORDER WITH REASONS", "REASONS FOR THE ORDER")),
    Entry("enforcement_orders", ("ENFORCEMENT ORDERS",)),
)
SYSTEM = ("DUBAI INTERNATIONAL FINANCIAL CENTRE COURTS", "THE DUBAI INTERNATIONAL FINANCIAL CENTRE COURTS", "DIFC COURTS")
CASE_PREFIX = r"\b([A-Z]{2,4}) \d{1,5}/\d{4}\b"
NO_NAME = ("IN THE ", " BETWEEN ", "COUNSEL", "HEARING", "JUDGMENT :", "ORDER WITH REASONS")
# ---------------------------------------------------------------------------------------------------------------------------------------


def source_text(text: Column) -> Column:
    """Capitals, white space collapsed, the tribunal's letters joined."""
    return F.regexp_replace(F.upper(collapsed(text)), r"\bS *CT\b", "SCT")


def plain(alias: str) -> str:
    return " ".join(alias.upper().split())


def alias_hits(text: Column, aliases: list[str], most_aliases: int = 1_000_000) -> Column:
    """The numbers of the aliases that a text holds, rising; a null text has none. Blank aliases are found nowhere."""
    if len(aliases) > most_aliases:
        raise ValueError(f"{len(aliases)} aliases; a registry may have {most_aliases}")
    numbers: dict[str, list[int]] = {}
    for k, alias in enumerate(aliases):
        if alias:
            numbers.setdefault(alias, []).append(k)
    built: list = []

    @F.pandas_udf("array<int>")
    def find(column: pd.Series) -> pd.Series:
        import ahocorasick

        if not built:
            machine = ahocorasick.Automaton()
            for alias, own in numbers.items():
                machine.add_word(alias, own)
            if numbers:
                machine.make_automaton()
            built.append(machine)
        return column.map(lambda x: sorted({k for _, own in built[0].iter(x) for k in own}) if isinstance(x, str) and numbers else [])

    return find(text)


def ordered_courts(courts: tuple[Entry, ...]) -> list[Entry]:
    """Divisions before courts, more aliases before fewer; equals as they stand."""
    return sorted(courts, key=lambda e: (e.last, len(e.aliases)), reverse=True)


def court_structure(cases: DataFrame, number: str, context: str, name: str, level: str, courts: tuple[Entry, ...] = COURTS, streams: tuple[Entry, ...] = STREAMS, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """cases with the court, its division and the stream of documents that their context names; nulls where nothing is known.

    A court is named by one of its aliases or by the prefix of the case's number; the first in `ordered_courts` wins. A given name stays unless it
    is no name; a given level stays unless it is empty or unknown. Texts without a court, a stream, a prefix or the system get nulls only.
    """
    ranked = ordered_courts(courts)
    groups = [*(e.aliases for e in ranked), *(e.aliases for e in streams), system]
    aliases = [plain(a) for own in groups for a in own]
    owner = [k for k, own in enumerate(groups) for _ in own]
    prefix = F.nullif(F.regexp_extract(source_text(F.col(number)), CASE_PREFIX, 1), F.lit(""))
    rows = cases.withColumn("__prefix", prefix).withColumn("__hits", alias_hits(source_text(F.col(context)), aliases))
    owners, spoken = F.array(*map(F.lit, owner)), F.array(*map(F.lit, (a for own in groups for a in own)))
    rows = rows.withColumn("__owners", F.transform("__hits", lambda k: F.get(owners, k)))
    of = lambda low, high: F.array_min(F.filter("__owners", lambda k: (k >= low) & (k < high)))
    by_prefix = {p.upper(): k for k, e in reversed(list(enumerate(ranked))) for p in e.prefixes}
    prefixed = F.element_at(F.create_map(*(F.lit(x) for pair in by_prefix.items() for x in pair)), F.col("__prefix")) if by_prefix else F.lit(None).cast("int")
    n, m = len(ranked), len(streams)
    rows = rows.withColumn("__court", F.least(of(0, n), prefixed)).withColumn("__stream", of(n, n + m))
    own_alias = F.get(F.filter("__hits", lambda k: F.get(owners, k) == F.col("__court")), F.lit(0))
    known = F.col("__court").isNotNull() | F.col("__stream").isNotNull() | F.col("__prefix").isNotNull() | F.array_contains("__owners", n + m)
    field_of = lambda f: F.get(F.array(*(F.lit(e.fields.get(f)).cast("string") for e in ranked)), F.col("__court"))
    given, source = collapsed(F.col(name)), F.upper(collapsed(F.col(name)))
    bad = source == ""
    for mark in NO_NAME:
        bad = bad | source.contains(mark)
    grade = F.trim(F.coalesce(F.col(level), F.lit("")))
    found = F.col("__court").isNotNull()
    made = {
        "court_key": F.get(F.array(*(F.lit(e.key) for e in ranked)), F.col("__court")),
        "court": F.nullif(F.when(found & bad, field_of("court_name")).otherwise(given), F.lit("")),
        "court_level": F.nullif(F.when(found & F.lower(grade).isin("", "unknown"), field_of("court_level")).otherwise(grade), F.lit("")),
        "court_kind": field_of("court_kind"),
        "court_division_name": field_of("court_division_name"),
        "stream_key": F.get(F.array(*(F.lit(e.key) for e in streams)), F.col("__stream") - n),
        "matched_alias": F.when(found, F.coalesce(F.get(spoken, own_alias), "__prefix")),
    }
    return rows.select(*(F.col(f"`{c}`") for c in cases.columns if c not in made), *(F.when(known, v).alias(k) for k, v in made.items()))
