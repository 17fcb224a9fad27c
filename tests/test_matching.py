"""Propositions, courts, dates near an anchor, repaired capitals and selections on small cases."""

import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import references, repair
from lexloom.operators import courts, propositions, selection


def test_best_two_propositions(spark):
    questions = spark.createDataFrame(
        [(1, "Can an employee waive rights under this law by written agreement?", [], []), (2, "What of Article 11?", ["Article 11"], []), (3, None, None, None), (4, "see", [], ["cfi 1/2020"])],
        "q long, text string, article_refs array<string>, case_numbers array<string>",
    )
    assertions = spark.createDataFrame(
        [(10, 0, "employee may_waive rights written agreement", [], True), (10, 1, "the employee rights", ["article 11"], False), (10, 2, "rights employee", None, None), (11, 0, None, ["CFI 1/2020"], False)],
        "c long, place int, words string, citations array<string>, eligible boolean",
    )
    pairs = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, 10), (4, 11), (1, 12), (1, 11)], "q long, c long")
    got = {(r.q, r.c): (r.top_place, r.terms_hit, r.top_score, r.second_score, round(r.boost, 4)) for r in propositions.match_features(pairs, questions, assertions, "q", "c", 3).collect()}
    # can employee waive rights law written agreement: four of seven are held
    assert got[1, 10] == (0, 4, round(4 / 7 + 0.05, 4), round(2 / 7, 4), round((4 / 7 + 0.05) * 0.45, 4))
    assert got[2, 10][0] == 1 and got[2, 10][2] == 0.2 and got[4, 11] == (0, 0, 0.2, 0.0, 0.09)
    assert got[3, 10] == (0, 0, 0.05, 0.0, 0.0225) and got[1, 12] == (None, 0, 0.0, 0.0, 0.0) and got[1, 11][2] == 0.0


def test_courts(spark):
    rows = [
        ("CFI 067/2025", "in the court of first  instance - orders", "IN THE COURT", None),
        (" s ct 12/2021", None, None, "Unknown"),
        (None, "Technology and Construction Division of the Court of Appeal judgments", "My Court", "Top"),
        (None, "nothing of it", "x", "y"),
        ("XYZ 1/2020", "no alias", "Name", None),
        (None, "the DIFC Courts", None, None),
        ("DEC 001/2025", "Court of Appeal", None, None),
        (None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "number string, context string, name string, level string")
    got = [tuple(r)[4:] for r in courts.court_structure(frame, "number", "context", "name", "level").collect()]
    assert got == [
        ("difc_court_of_first_instance", "Court of First Instance", "Court of First Instance", "court", None, "orders", "COURT OF FIRST INSTANCE"),
        ("difc_small_claims_tribunal", "Small Claims Tribunal", "Small Claims Tribunal", "tribunal", None, None, "SCT"),
        ("difc_technology_and_construction_division", "My Court", "Top", "division", "Technology & Construction Division", "judgments", "TECHNOLOGY AND CONSTRUCTION DIVISION"),
        (None, None, None, None, None, None, None),
        (None, "Name", None, None, None, None, None),
        (None, None, None, None, None, None, None),
        ("difc_digital_economy_court_division", "Digital Economy Court Division", "Court of First Instance", "division", "Digital Economy Court Division", None, "DEC"),
        (None, None, None, None, None, None, None),
    ]


def test_aliases_in_one_pass(spark):
    aliases = [f"NAME {k}" for k in range(3000)] + ["", "NAME 7"]
    text = " ".join(f"NAME {k};" for k in range(0, 3000, 7))
    frame = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    want = sorted(k for k, a in enumerate(aliases) if a and a in text)
    assert [r[0] for r in frame.select(courts.alias_hits(F.col("t"), aliases)).collect()] == [want, [], []]
    with pytest.raises(ValueError, match="a registry may have"):
        courts.alias_hits(F.col("t"), aliases, 10)


def test_dates_near_an_anchor(spark):
    rows = [
        ("For a new account from 1st January 2020, else Feb 3, 2019", "When for a New Account?", "2020-01-01"),
        ("2018-05-06 is for a pre existing account; 2019-07-08", "any pre-existing account", "2018-05-06"),
        ("On 2001-01-01 new account 2002-02-02", "new account", "2001-01-01" if len("On 2001-01-01 ") - 3 <= 12 else "2002-02-02"),
        ("12 Parties 2020 and new account, 31 February 2021, 5 may 2022", "new account", "2022-05-05"),
        ("new account without a day", "new account", None),
        ("2001-01-01", "new account", None),
        ("new account 2001-01-01", "something else", None),
        (None, None, None),
        ("x " * 500_000 + "new account 2001-01-01", "new account", "2001-01-01"),
    ]
    frame = spark.createDataFrame([r[:2] for r in rows], "t string, q string")
    assert [r[0] for r in frame.select(references.scoped_date(F.col("t"), F.col("q")).cast("string")).collect()] == [r[2] for r in rows]


def plain_repair(line):
    """Word by word: letters alone before a short word, then a letter and a part, then two parts."""
    known, alone = {w.upper() for w in repair.SPLIT_WORDS}, set(repair.ALONE)
    line = re.sub(r"\b((?:[A-Z] ){2,})([A-Z]{2,6})\b", lambda m: m[1].replace(" ", "") + m[2], line)
    line = re.sub(r"\b([A-Z]) ([A-Z]{2,6})\b", lambda m: m[1] + m[2] if m[1] not in alone and m[1] + m[2] in known else m[0], line)
    words, out = line.split(" "), []
    while words:
        a, b = words[0], words[1] if len(words) > 1 else ""
        if re.fullmatch("[A-Z]{2,6}", a) and re.fullmatch("[A-Z]{2,6}", b) and a not in alone and a + b in known:
            out.append(a + b)
            words = words[2:]
        else:
            out.append(a)
            words = words[1:]
    return " ".join(out)


def test_split_capitals_are_joined(spark):
    lines = [
        "THE DU BAI INTERNATIONAL FINANCIAL CENTRE COU RTS", "COU RT OF APPEAL", "ORDER W ITH REAS ONS OF H.E. CHIEF J U S TICE W AYNE M ARTIN U PON", "Case No: ENF 269/2023",
        "IN TERN", "A PPEAL", "OR DER OR DERS", "X Y Z", "C OURT S", "B E T W EEN", "DEB TOR (DU BAI) DU BAI", "COU RTS COU RT", "", "a b c", "TO TO TO",
    ]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, t string")
    got = [r[0] for r in frame.orderBy("id").select(repair.joined_capitals(F.col("t"))).collect()]
    assert got == [plain_repair(x) for x in lines]
    assert got[2] == "ORDER WITH REASONS OF H.E. CHIEF JUSTICE WAYNE MARTIN UPON"


def test_preview_text(spark):
    raw = "THE DU BAI INTERNATIONAL FINANCIAL CENTRE COU RTS\nTHE DU BAI INTERNATIONAL FINANCIAL CENTRE COU RTS\r\nCOU RT OF APPEAL\r/Type 1 0 obj Case\x00No: ENF 269/2023\n \nORDER\nORDER"
    long = "A HEADING IN CAPITALS HERE\n" * 3 + "word " * 300_000
    frame = spark.createDataFrame([(0, raw), (1, None), (2, ""), (3, long)], "id long, t string")
    got = [r[0] for r in frame.orderBy("id").select(repair.preview_text(F.col("t"))).collect()]
    assert got[:3] == ["THE DUBAI INTERNATIONAL FINANCIAL CENTRE COURTS COURT OF APPEAL Case No: ENF 269/2023 ORDER ORDER", "", ""]
    assert got[3].count("HEADING") == 1 and got[3].count("word") == 300_000


def triage(n_spare):
    rows = [(f"article-{k}", 150 - k, "law_article_lookup", "") for k in range(8)] + [(f"history-{k}", 140 - k, "law_relation_or_history", "") for k in range(4)]
    rows += [("cross", 139, "law_article_lookup", "What differs between Law No. 1 and Law No. 2?")]
    rows += [(n, 130, r, "") for n, r in zip(("entity", "value", "compare"), selection.CASE_ROUTES, strict=True)] + [("value-2", 190, "case_outcome_or_value", "")]
    rows += [(f"negative-{k}", 0, "negative_or_unanswerable", "") for k in range(4)]
    return rows + [(f"scope-{k}", 120 - k, "law_scope_or_definition", "") for k in range(n_spare)]


def select(spark, rows):
    frame = spark.createDataFrame([(*r, ["law"], "free_text") for r in rows], "id string, severity int, route string, question string, types array<string>, answer_type string")
    frame = frame.withColumn("family", selection.family(F.col("question"), F.col("route"), F.col("types"))).withColumn("theme", selection.theme(F.col("question"), F.col("answer_type")))
    return selection.build_selection(frame, "id").orderBy("place").collect()


def test_selection_fills_what_is_missing(spark):
    got = select(spark, triage(9))
    ids = [r.id for r in got]
    assert len(ids) == 25 == len(set(ids)) and [r.place for r in got] == list(range(1, 26))
    assert sum(r.substitute for r in got) == 5 and {"cross", "entity", "compare"} < set(ids) and "value-2" in ids and "value" not in ids
    assert [r.family for r in got] == sorted((r.family for r in got), key=selection.ORDER.index)
    assert len(select(spark, triage(2))) == 22 and select(spark, triage(0)[:0] or [("x", 1, "other", None)])[0].id == "x"


def test_themes_and_risks(spark):
    rows = [("How many days?", "number", "numeric_requirement"), ("Is it valid?", "boolean", "boolean_norm"), ("Is it valid?", "name", "name"), (None, None, "general"), ("Which date was it enacted in days", "date", "history_or_version")]
    frame = spark.createDataFrame(rows, "q string, a string, want string")
    assert [r[0] for r in frame.select(selection.theme(F.col("q"), F.col("a"))).collect()] == [r[2] for r in rows]
    risks = frame.select(selection.risk(F.col("q"), F.lit("x"), F.lit(None).cast("string"))).collect()
    assert [r[0] for r in risks] == ["medium", "high", "high", "medium", "medium"]
