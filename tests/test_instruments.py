"""Identifiers of questions and chunks, anchors, and comparisons of instruments on small cases."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import instruments
from lexloom.operators import compare, identifiers
from lexloom.operators.joins import spread_join


def test_spread_join_equals_a_join(spark):
    large = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k int, v int")
    small = spark.createDataFrame([(1, "hot"), (3, "x"), (3, "y"), (None, "n")], "k int, w string")
    for how in ("inner", "left"):
        assert sorted(map(tuple, spread_join(large, small, ["k"], 7, how).collect()), key=str) == sorted(map(tuple, large.join(small, "k", how).collect()), key=str)


def test_flags_of_identifiers(spark):
    chunks = spark.createDataFrame(
        [
            (1, "11", ["7(2)"], "As Article 5 says, and article 9x", ["Part 2", "Article 11"], " A ", None, "3", "4", "2019", "Employment  Law", "law", None),
            (2, None, None, "", [], None, None, None, None, "2019", None, "law", "cfi 1/2020"),
            (3, "2", [], None, None, "b", "II", None, "10", "1999", "Data Protection Law", "law", None),
        ],
        "id long, article string, refs array<string>, text string, path array<string>, section string, part string, schedule string, number string, year string, title string, type string, case_no string",
    )
    own = {"section": "section", "part": "part", "schedule": "schedule", "law_number": "number", "law_year": "year", "law_title": "title", "doc_type": "type", "case_number": "case_no"}
    values = identifiers.chunk_values(F.col("article"), F.col("refs"), F.col("text"), F.col("path"), {k: F.col(c) for k, c in own.items()})
    held = identifiers.listed(chunks, "id", values)
    asked = spark.createDataFrame(
        [(10, {"article": ["5"], "law_year": ["2019"], "doc_type": ["law"]}), (20, {"paragraph": ["7(2)"], "clause": ["11"], "part": ["PART 2"], "section": ["a"], "schedule": ["3"]}), (30, {"case_number": ["CFI 1/2020"], "law_year": ["1999"]}), (40, {"law_title": ["protection law"]}), (50, {"law_year": ["2019"]}), (60, {"article": ["9"]})],
        "q long, ids map<string, array<string>>",
    )
    named = identifiers.listed(asked, "q", {k: F.element_at("ids", k) for k in identifiers.KINDS})
    got = {(r.q, r.id): {k for k, b in identifiers.BIT.items() if r.flags & b} for r in identifiers.matches(named, held, "q", "id", salts=3).collect()}
    assert got == {
        (10, 1): {"article", "law_year", "doc_type"},
        (20, 1): {"paragraph", "clause", "part", "section", "schedule"},
        (30, 2): {"case_number"},
        (40, 3): {"law_title"},
    }
    every = {(r.q, r.id) for r in identifiers.matches(named, held, "q", "id", weak=()).collect()}
    assert (50, 2) in every and (10, 3) in every and (60, 1) not in every
    plan = identifiers.matches(named, held, "q", "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_features_of_a_pair(spark):
    rows = spark.createDataFrame([(1, "article_lookup", True, None, ["amends"]), (64, "article_lookup", None, None, None), (0, "history_lineage", False, "x", [])], "flags int, route string, cur boolean, rel string, edges array<string>")
    f = identifiers.features(F.col("route"), F.col("cur"), F.col("rel"), F.col("edges"))
    assert [tuple(r) for r in rows.select(*f.values()).collect()] == [(True, True, True, True), (True, False, False, False), (False, False, False, True)]


def test_names_of_instruments(spark):
    rows = [("Laws", "What the Employment Law", "2", "2019", "law_no_2_of_2019"), ("regulation", None, "7", None, "regulation_no_7"), ("Commencement Notice", "x", "1", "2020", "notice_no_1_of_2020"), (None, "Was the Trust Law ?", None, "2018", "trust_law_2018"), ("law", "and A Code", None, None, "a_code"), ("other", "Data Rules", "3", "2001", "data_rules_no_3_of_2001"), (None, None, "9", None, "")]
    frame = spark.createDataFrame([r[:4] for r in rows], "k string, t string, n string, y string")
    found = frame.select(instruments.instrument_identifier(instruments.instrument_type(F.col("k")), F.col("t"), F.col("n"), F.col("y")))
    assert [r[0] for r in found.collect()] == [r[4] for r in rows]


@pytest.mark.parametrize(
    ("question", "dimensions", "operator"),
    [
        ("Were the two laws enacted in the same year?", ["enactment_date"], "same_or_common"),
        ("Which laws are administered by the Registrar?", ["administering_authority", "condition_satisfaction"], "which_satisfy_condition"),
        ("Did Law No. 1 come into force before Law No. 2?", ["commencement_date"], "earlier_than"),
        ("What is the difference?", ["title_full"], "contrast"),
        ("Hello", [], "unknown"),
        (None, [], "unknown"),
    ],
)
def test_what_a_question_compares(spark, question, dimensions, operator):
    rows = spark.createDataFrame([(question,)], "q string").withColumn("d", instruments.compare_dimensions(F.col("q")))
    assert list(rows.select("d", instruments.compare_operator(F.col("q"), F.col("d"))).first()) == [dimensions, operator]


def solve(spark, question, answer_type, named, rows):
    """One question through annotation, matrix and answer. named: (kind, number, year, title); rows: (number, year, title, text, enacted)."""
    one = spark.createDataFrame([(1, question, answer_type)], "q long, question string, answer_type string").withColumn("dimensions", instruments.compare_dimensions(F.col("question")))
    one = one.withColumn("operator", instruments.compare_operator(F.col("question"), F.col("dimensions"))).withColumn("open", instruments.open_set(F.col("question")))
    a = spark.createDataFrame([(1, k, *n) for k, n in enumerate(named)], "q long, place int, kind string, number string, year string, title string")
    a = a.withColumn("identifier", instruments.instrument_identifier(instruments.instrument_type(F.col("kind")), F.col("title"), F.col("number"), F.col("year")))
    c = spark.createDataFrame([(1, k, "law", *r) for k, r in enumerate(rows)], "q long, place int, kind string, number string, year string, title string, text string, enacted string")
    found = compare.annotate(c, a, "q").join(one.select("q", "question", "dimensions"), "q")
    t = instruments.condition_targets(F.col("question"))
    none = F.lit(None)
    values = compare.candidate_values(F.col("text"), F.col("title"), t["term"], none.cast("string"), F.col("enacted").cast("date"), none.cast("date"), none.cast("string"), none.cast("int"))
    met = compare.satisfying(found, "q", "place", t["year"], t["authority"], t["term"], t["schedule"], values)
    order = a.where("identifier <> ''").groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "identifier"))), lambda x: x["identifier"]).alias("order"))
    r = compare.answers(one.join(order, "q", "left").withColumn("order", F.coalesce("order", F.array().cast("array<string>"))), compare.matrix(found, values, "q", "place"), met, "q").first()
    return r.path, r.answer, r.confidence


LAWS = [("1", "2004", "Trust Law", "The Trust Law is administered by the Registrar. It has fees.", "2004-05-01"), ("2", "2005", "Data Law", "The Data Law is issued by the Board. See the Schedule.", "2005-06-01"), ("1", "2004", "Trust Law", "Fees of trusts: 'common terms'.", None)]
PAIR = [("law", "1", "2004", "Trust Law"), ("law", "2", "2005", "Data Law")]


@pytest.mark.parametrize(
    ("question", "kind", "named", "rows", "want"),
    [
        ("Was the Trust Law enacted earlier than the Data Law?", "boolean", PAIR, LAWS, ("boolean_earlier_than", "true", 0.92)),
        ("Which was enacted later than the other?", "date", PAIR, LAWS, ("date_extrema", "2005-06-01", 0.9)),
        ("Were both enacted on the same day?", "boolean", PAIR, LAWS, ("boolean_date_not_common", "false", 0.88)),
        ("Were both enacted on the same day?", "date", PAIR, LAWS, ("abstain_common_date_conflict", None, 0.0)),
        ("Which laws are administered by the registrar?", "names", [], LAWS, ("names_condition_matches", "Trust Law", 0.9)),
        ("Which laws have a schedule?", "name", [], LAWS, ("name_condition_first", "Data Law", 0.9)),
        ("Do they both mention 'common terms'?", "boolean", PAIR, LAWS, ("boolean_feature_common", "false", 0.9)),
        ("Compare the full title", "free_text", PAIR, LAWS, ("free_text_extractive_compare", "Trust Law: Trust Law; Data Law: Data Law.", 0.78)),
        ("Was it enacted earlier than the other?", "boolean", PAIR[:1], LAWS, ("abstain_missing_instrument_pair", None, 0.0)),
        ("Hello", "boolean", PAIR, LAWS, ("abstain_no_dimensions", None, 0.0)),
        ("Was it enacted earlier than the other?", "boolean", PAIR, LAWS[:1], ("abstain_timeline_missing", None, 0.0)),
    ],
)
def test_comparisons(spark, question, kind, named, rows, want):
    assert solve(spark, question, kind, named, rows) == want


def test_the_first_of_equal_anchors_wins(spark):
    named = [("law", "1", None, None), ("law", "1", None, "")]
    a = spark.createDataFrame([(1, k, *n, f"id{k}") for k, n in enumerate(named)], "q long, place int, kind string, number string, year string, title string, identifier string")
    c = spark.createDataFrame([(1, "law", "1", "2004", "T Law", None), (1, "memo", None, None, None, None), (2, "law", "3", None, "T", "x")], "q long, kind string, number string, year string, title string, text string")
    got = {tuple(r) for r in compare.annotate(c, a, "q").select("q", "points", "instrument", "label").collect()}
    assert got == {(1, 5, "id0", "id0"), (1, 0, "", ""), (2, 0, "law_no_3", "T")}


def test_lines_are_read_once_and_move_once_without_copies_of_anchors(spark):
    from lexloom.plans.registry import QUERIES

    for name in ("anchored_instruments", "instrument_comparisons"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet [l_orderkey") == 1 and "sequence" not in plan and "__salt" not in plan
        # a text is made above the window, after the lines have moved
        assert plan.index("Registrar") < plan.index("Window")


def test_one_pass_gathers_what_matrix_and_satisfying_find(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", "A", None, True, False), (1, 2, "a", "B", "x", False, True), (1, 3, "b", "C", "y", True, True), (1, 4, "", "D", "z", True, True), (1, 5, "c", "E", "w", False, True), (2, None, "", None, None, None, None)],
        "q long, place int, instrument string, label string, v string, t1 boolean, t2 boolean",
    )
    asked = F.struct(F.array(F.lit("title_full"), F.lit("schedule_presence")).alias("dimensions"), F.array(F.lit("b"), F.lit("a")).alias("order")).alias("asked")
    values = {"title_full": F.col("v"), "schedule_presence": F.lit("true")}
    got = {r.q: r for r in compare.gathered(rows.select("*", asked), "asked", values, [F.col("t1"), F.col("t2")], "q", "place").collect()}
    assert [tuple(c) for c in got[1].cells] == [(1, "C", "y"), (2, "B", "x")] and [tuple(m) for m in got[1].met] == [(1, "A"), (3, "C")]
    assert got[2].cells == [] and got[2].met == [] and got[2].order == ["b", "a"]
    found = {(r.instrument, r.label, r.value) for r in compare.matrix(rows.select("*", F.array(F.lit("title_full")).alias("dimensions")), {"title_full": F.col("v")}, "q", "place").collect()}
    assert found == {("a", "B", "x"), ("b", "C", "y"), ("c", "E", "w")}


def test_white_space_is_collapsed_as_before(spark):
    from lexloom.functions.text import SPACES, collapsed

    texts = ["a b", "  a", "a\tb", "a   b", "a b", " a ", "a\x1cb \x85", " ", "", "\n", "a  b c", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    before = F.btrim(F.regexp_replace(F.coalesce("t", F.lit("")), SPACES + "+", " "))
    assert all(r[0] == r[1] for r in frame.select(collapsed(F.col("t")), before).collect())


def test_best_matches_are_the_first_of_all_matches(spark, monkeypatch):
    monkeypatch.setattr("lexloom.operators.best.PARTS", 2)
    one = lambda c: F.array(c.cast("string"))
    chunks = spark.range(80).select("id", F.array("id", F.col("id") % 3).cast("array<string>").alias("a"), one(F.col("id") % 4).alias("b"), F.array(F.concat(F.lit("Fees of src"), F.col("id") % 12)).alias("t"), one(F.col("id") % 5).alias("y"))
    asked = spark.range(9).select(F.col("id").alias("q"), one(F.col("id") % 6).alias("a"), one(F.col("id") % 2).alias("b"), F.array(F.concat(F.lit("src"), F.col("id") % 3)).alias("t"), one(F.col("id") % 5).alias("y"))
    values = {"article": F.col("a"), "part": F.col("b"), "law_title": F.col("t"), "law_year": F.col("y")}
    every = identifiers.matches(identifiers.listed(asked, "q", values), identifiers.listed(chunks, "id", values), "q", "id")
    packed = lambda rows, key: rows.select(key, identifiers.gathered(values).alias("v"))
    some = identifiers.best_matches(packed(asked, "q"), packed(chunks, "id"), "q", "id", "v", 3)
    ranked = lambda rows: sorted((r.q, sorted((-bin(x.flags).count("1"), x.id, x.flags) for x in r.all)[:3]) for r in rows.groupBy("q").agg(F.collect_list(F.struct("flags", "id")).alias("all")).collect())
    assert ranked(some) == ranked(every)
    assert some.count() < every.count()
