import json

from pyspark.sql import functions as F

from lexloom.functions import references, routing
from lexloom.operators import answers, contracts
from lexloom.sources import readers, writers


def test_references_keep_order_and_ignore_case(spark):
    rows = spark.createDataFrame([("See Article 5 and article 5, ст. 7.1. Law No. 10 of 2004; USD 155,5 due 2021-02-03 by 3/4/2020. Статья 12", 1), (None, 2)], "t string, id int")
    one, none = rows.select("id", *(c.alias(n) for n, c in references.references(F.col("t")).items())).orderBy("id").collect()
    assert one.article_refs == ["Article 5", "ст. 7.1", "Статья 12"] and one.dates == ["2004", "2021-02-03", "3/4/2020"] and one.money_mentions == ["USD 155,5"]
    assert all(none[c] == [] for c in references.REFERENCES)


def test_all_references_of_a_text_are_kept(spark, tmp_path):
    from lexloom.plans.registry import QUERIES

    word = lambda i: "B" + chr(97 + i // 26) + chr(97 + i % 26)
    makers = {
        "article_refs": lambda i: f"Article {i}",
        "law_refs": lambda i: f"law no. {i}",
        "case_refs": lambda i: f"case no. {i}",
        "dates": lambda i: f"{1900 + i}",
        "money_mentions": lambda i: f"USD {i}",
        "entities": word,
    }
    order = [(7 * i) % 60 for i in range(60)]
    texts = ["; ".join(make(i) for i in order) + "; " + "; ".join(make(i).upper() for i in reversed(order)) for make in makers.values()]
    spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["document_references"](spark, str(tmp_path)).orderBy("doc_id").collect()
    for row, (kind, make) in zip(got, makers.items()):
        assert row[kind] == [make(i) for i in order], kind
    assert all(got[6][kind] == [] for kind in makers)
    assert QUERIES["document_dates"](spark, str(tmp_path)).where("doc_id = 3").first().n_dates == 24


def test_many_values_of_a_text_are_told_apart_without_seeking_each_among_all(spark):
    frame = spark.createDataFrame([(["b", "B", "a\n a", None, "", "A a", "c", "C"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in frame.select(references.ordered_distinct(F.col("v"))).collect()] == [["b", "a a", "c"], [], None]
    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(119_999)), lambda i: F.concat(F.lit("v"), (i % 60_000).cast("string"))).alias("v"))
    got = many.select(references.ordered_distinct(F.col("v")).alias("v")).first().v
    assert got == [f"v{i}" for i in range(60_000)]


def test_document_types_and_dates(spark):
    rows = spark.createDataFrame([("law_no_5.pdf", "Law No. 5, effective from 1.2.2020"), ("x", "The court gave judgment; the order expired 2019-01-01 and 2021-05-06"), ("y", "enactment notice"), ("z", None)], "n string, t string")
    got = [tuple(r) for r in rows.select(references.document_type(F.col("n"), F.col("t"))["doc_type"], *(c.cast("string") for c in references.effective_dates(F.col("t")).values())).collect()]
    assert got == [("law", "2020-02-01", None), ("case", "2019-01-01", "2021-05-06"), ("enactment_notice", None, None), ("other", None, None)]
    group = references.version_group(F.col("k"), F.col("l"), F.col("c"), F.col("i"))
    rows = spark.createDataFrame([("law", "10 A", None, "d1"), ("case", None, "CFI 1/2020", "d2"), ("law", " ", None, "d3"), ("other", "9", "x", "d4")], "k string, l string, c string, i string")
    assert [r[0] for r in rows.select(group).collect()] == ["law:10_a", "case:cfi_1_2020", "d3", "d4"]
    titles = [("EMPLOYMENT LAW DIFC LAW NO. 2 of 2019 Consolidated Version No. 5", "law:employment:2"), ("COMMON_REPORTING STANDARD LAW DIFC LAW NO. 2 OF 2018", "law:common_reporting_standard:2"), ("Law No. 2", "law:2"), (None, "law:2")]
    rows = spark.createDataFrame([("law", "2", None, "d", t) for t, _ in titles] + [("case", None, "Claim 7", "weak", None), ("case", None, "dec - 1-2025 ", "d", None)], "k string, l string, c string, i string, s string")
    found = rows.select(references.version_group(F.col("k"), F.col("l"), F.col("c"), F.col("i"), F.col("s"))).collect()
    assert [r[0] for r in found] == [*(want for _, want in titles), "weak", "case:dec-1-2025"]


def test_subroutes(spark):
    rows = spark.createDataFrame([("Who is the respondent in the appeal?", "name"), ("What was awarded in the appeal?", "number"), ("What is its purpose?", "free_text"), (None, None)], "q string, a string")
    route = routing.decide(F.col("q"))["route"]
    assert [r[0] for r in rows.select(routing.subroute(route, routing.signals(F.col("q")), F.coalesce("a", F.lit("")))).collect()] == ["case_entity_lookup", "case_outcome_or_value", "law_scope_or_definition", "law_scope_or_definition"]


def test_answer_contract(spark):
    schema = "id int, t string, n double, f boolean, l array<string>, k string, ab boolean"
    rows = [(1, None, None, True, None, "boolean", False), (2, "yes", None, None, None, "boolean", False), (3, None, None, None, None, "number", False), (4, None, None, None, None, "number", True), (5, "x", None, None, None, "name", True), (6, None, None, None, ["a", " "], "names", False), (7, "", None, None, None, "free_text", True), (8, "x", None, None, None, "odd", False)]
    issues = contracts.answer_issues(*(F.col(c) for c in ("t", "n", "f", "l", "k", "ab")))
    got = [r[0] for r in spark.createDataFrame(rows, schema).orderBy("id").select(issues).collect()]
    assert got == [[], ["boolean_answer_must_be_bool"], ["non_abstained_answer_must_not_be_null"], [], ["abstain_answer_must_be_null_for_non_free_text"], ["names_answer_items_must_be_non_empty_text"], ["free_text_abstain_answer_must_be_non_empty_text_or_null"], ["unsupported_answer_type"]]


def test_used_pages_and_preflight(spark):
    rows = spark.createDataFrame([(1, [("d_1", "d", 1, True), ("d_1", "d", 1, True), ("bad", "d", 2, True), ("d_3", "d", 3, False)]), (2, None)], "id int, s array<struct<source_page_id: string, pdf_id: string, page_num: int, used: boolean>>")
    got = rows.orderBy("id").select(contracts.used_pages(F.col("s")), contracts.source_issues(F.col("s")).alias("i"))
    assert [tuple(r) for r in got.collect()] == [(["d_1"], ["sources[2].source_page_id_pattern_invalid"]), ([], [])]
    assert tuple(contracts.preflight(got, "i").first()) == (2, 1, 0.5, False)
    assert tuple(contracts.preflight(got.limit(0), "i").first()) == (0, 0, 0.0, True)


def test_evidence_cover_prefers_new_keywords(spark):
    rows = [(1, "a", 0.9, ["x", "y"], False), (1, "b", 0.8, ["x", "y"], False), (1, "c", 0.5, ["z", "w"], False), (1, None, 1.0, ["q"], True), (2, "d", 0.1, [], True)]
    refs = spark.createDataFrame(rows, "q int, p string, s double, k array<string>, e boolean")
    got = [tuple(r) for r in answers.evidence_cover(refs, "q", "p", "s", "k", "e", 2).orderBy("q", "place").collect()]
    assert [g[:3] for g in got] == [(1, "a", 1), (1, "c", 2), (2, "d", 1)] and abs(got[1][3] - 1.0) < 1e-9


def test_votes_and_reasons(spark):
    rows = spark.createDataFrame([(1, "shall pay"), (1, None), (2, "shall"), (2, "shall not"), (3, "none")], "q int, t string")
    assert [tuple(r)[:3] for r in answers.boolean_vote(rows, "q", "t", "shall", "not").orderBy("q").collect()] == [(1, True, False), (2, None, True), (3, None, True)]
    reason = answers.abstain_reason(F.col("ab"), F.col("k"), F.col("top"), F.lit(0.01), F.lit(3), F.lit(0), F.lit(1))
    rows = spark.createDataFrame([(True, "name", 0.0), (True, "name", 0.5), (False, "free_text", 0.2), (False, "name", 0.2)], "ab boolean, k string, top double")
    assert [r[0] for r in rows.select(reason).collect()] == ["no_corpus_support", "conflicting_evidence", "low_retrieval_quality", None]


def test_question_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "1", "question": "Why?", "answer_type": "name"}) + "\n\n" + json.dumps({"id": "", "question": "x"}) + "\n{broken\n" + json.dumps({"id": "2", "question": "How?"}) + "\n")
    good, bad = readers.questions(spark, str(tmp_path / "q.jsonl"))
    assert sorted((r.id, r.answer_type) for r in good.collect()) == [("1", "name"), ("2", "free_text")]
    assert sorted(r.reason for r in bad.collect()) == ["id_missing", "not_json"]


def test_binary_documents(spark, tmp_path):
    for name, data in (("A one.pdf", b"x"), ("b.PDF", b"x"), ("c.pdf", b"y"), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r.member: (r.document_id, r.duplicate_group_id) for r in readers.binary_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"A one.pdf", "b.PDF", "c.pdf"} and got["b.PDF"][1] == "A_one" and got["A one.pdf"][1] is None


def test_keyed_writes_and_submissions(spark, tmp_path):
    old = writers.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), None, str(tmp_path / "t"), ["id"])
    new = writers.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), old, str(tmp_path / "t"), ["id"])
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "c"), (3, "d")] and old.count() == 2
    rows = spark.createDataFrame([("q1", "x", ["p_1", "p_1"])], "q string, a string, p array<string>")
    writers.submission(rows, str(tmp_path / "s"), "q", "a", "p")
    assert spark.read.json(str(tmp_path / "s")).first().pages == ["p_1"]


def test_the_best_page_is_sought_once_a_turn(spark):
    from lexloom.operators.answers import evidence_cover

    rows = [(1, "a", 0.5, ["x", "y"], False), (1, "b", 0.5, ["x", "y"], False), (1, "c", 0.1, ["z"], True), (2, "a", 0.2, [], False)]
    found = evidence_cover(spark.createDataFrame(rows, "q int, page string, s double, k array<string>, e boolean"), "q", "page", "s", "k", "e")
    assert {(r.q, r.page, r.place, round(r.gain, 6)) for r in found.collect()} == {(1, "a", 1, 1.0), (1, "c", 2, 0.8), (2, "a", 1, 0.2)}
    assert found._jdf.queryExecution().analyzed().toString().count("array_min(") == 1
