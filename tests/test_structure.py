"""Structural chunks: the cases of laws and orders, odd texts, and the whole text in the chunks."""

import pytest

from lexloom.operators.structure import COLUMNS, structural_chunks

LAW = (
    "EMPLOYMENT LAW 4 PART 2: HIRING EMPLOYEES 11. No waiver (1) The requirements of this Law are minimum requirements. "
    "(2) Nothing in this Law precludes an Employer from providing more favourable terms. "
    "12. No false representations An Employer shall not induce a person by misrepresenting the position."
)
PHRASE = (
    "PART 2: HIRING EMPLOYEES 11. No waiver Nothing in this Law precludes an Employee from waiving rights by written agreement "
    "as part in a settlement agreement with the Employer. 12. No false representations An Employer shall not induce a person."
)
CASE = (
    "CFI 067/2025 Coinmena B.S.C. (C) v Foloosi Technologies Ltd Claim No: CFI 067/2025 BETWEEN COINMENA Claimant and FOLOOSI Defendant "
    "ORDER WITH REASONS OF H.E. JUSTICE X UPON the Defendant's Application IT IS HEREBY ORDERED THAT: 1. The Applicant shall pay USD 155,879.50. "
    "2. The Applicant shall pay within 14 days. SCHEDULE OF REASONS 1. This Order concerns costs. 2. Interest shall accrue at 9% per annum."
)
CONTINUED = (
    "2. If these costs are not paid to the Appellants within fourteen (14) days of the date of this order, interest will accrue on the amount outstanding. "
    "SCHEDULE OF REASONS Summary 1. After hearing argument on the appeal, the Court pronounced orders allowing the appeal."
)
NESTED = "PART I CHAPTER 2: Fees and terms SECTION A 1. First rule here. SCHEDULE 3 2. Second rule there. PART II 3. Third rule."


def cut(spark, text, kind, rest=False):
    frame = spark.createDataFrame([(1, text, kind, "x", 0)], "id long, text string, type string, kind string, ordinal int")
    rows = [r.asDict() for r in structural_chunks(frame, "id", "text", "type", rest).collect()]
    return sorted(rows, key=lambda r: (r["ordinal"] is None, r["ordinal"], r["char_start"]))


def test_law_is_split_into_part_and_articles(spark):
    rows = cut(spark, LAW, "law")
    assert (rows[0]["chunk_type"], rows[0]["chunk"], rows[0]["local_key"]) == ("heading", "PART 2: HIRING EMPLOYEES", "heading:part_2")
    articles = [r for r in rows if r["article_number"]]
    assert [(r["article_number"], r["article_title"], r["part_ref"], r["parent_ordinal"], r["structural_level"]) for r in articles] == [
        ("11", "No waiver", "2", 0, 2),
        ("12", "No false representations", "2", 0, 2),
    ]
    assert articles[0]["next_ordinal"] == 2 and articles[1]["prev_ordinal"] == 1 and articles[1]["next_ordinal"] is None
    assert articles[0]["heading_path"] == ["PART 2: HIRING EMPLOYEES", "Article 11 No waiver"]
    assert all(LAW[r["char_start"] : r["char_end"]] == r["chunk"] for r in rows)


def test_phrase_is_no_heading(spark):
    rows = cut(spark, PHRASE, "law")
    assert [r["chunk"] for r in rows if r["chunk_type"] == "heading"] == ["PART 2: HIRING EMPLOYEES"]
    assert [r["article_number"] for r in rows if r["article_number"]] == ["11", "12"]


def test_case_is_split_into_caption_order_and_reasons(spark):
    rows = cut(spark, CASE, "case")
    assert [(r["chunk_type"], r["section_kind"], r["section_kind_case"], r["parent_ordinal"]) for r in rows] == [
        ("heading", "parties", "parties", None),
        ("heading", "order", "order", None),
        ("paragraph", "procedural_history", "procedural_history", 1),
        ("heading", "order", "order", 1),
        ("list_item", "order", "order", 3),
        ("list_item", "order", "order", 3),  # the sum's "50. " looks like a number of the list
        ("list_item", "order", "order", 3),
        ("heading", "reasoning", "reasoning", None),
        ("list_item", "reasoning", "reasoning", 7),
        ("list_item", "reasoning", "order", 7),
    ]
    assert [CASE[r["char_start"] : r["char_end"]] for r in rows[4:7]] == [r["chunk"] for r in rows[4:7]]
    assert rows[-1]["heading_path"] == ["SCHEDULE OF REASONS", "2. Interest shall accrue at 9% per annum."]


def test_case_that_goes_on_without_a_caption(spark):
    rows = cut(spark, CONTINUED, "case")
    kinds = [(r["chunk_type"], r["section_kind_case"], r["local_key"], r["parent_key"]) for r in rows]
    assert kinds[0] == ("heading", "order", "case:continuation_order", None) and kinds[1] == ("list_item", "order", None, "case:continuation_order")
    assert ("list_item", "reasoning", None, "case:reasons_heading") in kinds


def test_headings_stay_open_by_kind(spark):
    rows = [r for r in cut(spark, NESTED, "regulation") if r["article_number"]]
    refs = [(r["part_ref"], r["chapter_ref"], r["section_ref"], r["schedule_number"], r["parent_key"]) for r in rows]
    assert refs == [("I", "2", "A", None, "heading:section_a"), ("I", "2", "A", "3", "heading:section_a"), ("II", "2", "A", "3", "heading:section_a")]


@pytest.mark.parametrize(("text", "kind"), [(LAW, "law"), (PHRASE, "law"), (CASE, "case"), (CONTINUED, "case"), (NESTED, "law"), ("word " * 500, "law"), ("x" * 2000 + " y" * 300, None), ("Ünï 🙂 1. Één 2. Two 🙂 end", "law"), ("a b\u0085c", "case")])
def test_chunks_and_rest_hold_the_whole_text(spark, text, kind):
    rows = cut(spark, text, kind, rest=True)
    flat = " ".join(text.split())
    held = [False] * len(flat)
    for r in rows:
        if r["chunk"] not in ("Continuation", "IT IS HEREBY ORDERED THAT"):
            assert flat[r["char_start"] : r["char_end"]] == r["chunk"]
        held[r["char_start"] : r["char_end"]] = [True] * (r["char_end"] - r["char_start"])
    assert all(h or c == " " for h, c in zip(held, flat, strict=True))


def test_sizes_and_odd_rows(spark):
    long = ("word " * 400).strip()
    assert [len(r["chunk"]) for r in cut(spark, long, "memo")] == [899, 899, 199]
    assert [len(r["chunk"]) for r in cut(spark, "x" * 2000, None)] == [900, 900, 200]
    frame = spark.createDataFrame([(1, None, "law"), (2, " \n ", "case"), (3, "", None), (None, "1. Some text", "law")], "id long, text string, type string")
    rows = structural_chunks(frame, "id", "text", "type").collect()
    assert [(r.id, r.article_number) for r in rows] == [(None, "1")]
    assert structural_chunks(frame, "id", "text", "type").columns == ["id", *COLUMNS]


def test_each_kind_of_text_is_read_once(spark, tmp_path):
    texts = [
        (1, "PART 1: Scope 1. Alpha. PART 1: Scope 3. Gamma SECTION IV 4. Delta", "law"),
        (2, "IN THE COURT Claim No: 5 ORDER UPON x IT IS HEREBY ORDERED THAT: 1. pay 2. go SCHEDULE OF REASONS 1. why", "case"),
        (3, " \n ", "law"),
        (None, "PART 1: Scope 1. Alpha.", "law"),
    ]
    spark.createDataFrame(texts, "id long, text string, type string").write.parquet(str(tmp_path / "texts"))
    rows = structural_chunks(spark.read.parquet(str(tmp_path / "texts")), "id", "text", "type")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and "Join" not in plan, "the chunks are made twice"
    got = {i: [(r.ordinal, r.parent_ordinal) for r in sorted(rows.collect(), key=lambda r: r.ordinal) if r.id == i] for i in (1, 2, 3, None)}
    assert got[1] == [(0, None), (1, 2), (2, None), (3, 2), (4, None), (5, 4)]
    assert got[2] == [(0, None), (1, 0), (2, 0), (3, 2), (4, 2), (5, None), (6, 5)]
    assert got[3] == [] and got[None] == [(0, None), (1, None)]
