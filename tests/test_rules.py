from pyspark.sql import functions as F

from lexloom.functions import clauses
from lexloom.operators import registry_rules as rules


def test_clauses(spark):
    text = "Subject to Article 5, the buyer shall pay USD 155,879.50 within 14 days and interest at 9% per annum, unless waived; except as agreed. If late, 1,000 AED."
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    t = F.col("t")
    got = rows.orderBy("id").select(clauses.conditions(t).alias("c"), clauses.exceptions(t).alias("e"), clauses.money(t).alias("m"), clauses.rates(t).alias("r"), clauses.deadline_days(t).alias("d"), clauses.modality(t).alias("mod")).collect()
    assert got[0].c == ["Subject to Article 5, the buyer shall pay USD 155,879.", "If late, 1,000 AED."]
    assert got[0].e == ["unless waived;", "except as agreed."]
    assert [(m.text, m.value) for m in got[0].m] == [("USD 155,879.50", 155879.5), ("1,000 AED", 1000.0)]
    assert got[0].r == [9.0] and got[0].d == 14 and got[0].mod == "obligation"
    assert all(not r.c and not r.m and not r.r and r.d is None and r.mod == "procedure" for r in got[1:])


def test_section_kinds_and_effects(spark):
    rows = spark.createDataFrame([(1, "BETWEEN A Claimant and B Defendant"), (2, "It is hereby ordered that"), (3, "Upon reading the file"), (4, "The appeal is dismissed"), (5, "ORDER WITH REASONS"), (6, None)], "id int, t string")
    t = F.col("t")
    kind = clauses.case_chunk_type(t, F.lit(None).cast("string"))
    got = [tuple(r) for r in rows.orderBy("id").select(clauses.case_section_kind(t), kind, clauses.order_effect(t, kind)).collect()]
    assert got == [("parties", "other", None), ("order", "other", None), ("procedural_history", "recital_paragraph", None), ("disposition", "order_item", "application_dismissed"), ("reasoning", "heading", None), ("reasoning", "other", None)]
    denied = rows.select(clauses.target_reasons(F.lit("shall"), F.lit("heading")).alias("d"), clauses.target_reasons(F.lit("void unless"), F.lit("x")).alias("s")).first()
    assert denied.d == [] and denied.s == ["contains_negation_or_exception", "contains_invalidity_rule"]


def test_provision_reading(spark):
    rows = spark.createDataFrame([("Under Article 12(2)(A) of Law No. 5 of 2004?",), ("section 3A",), ("Schedule 2",), ("law no. 7",), (None,)], "q string")
    p = clauses.provision(F.col("q"))
    assert [tuple(r) for r in rows.select(*(p[k] for k in ("article", "subarticle", "law_identifier", "confidence"))).collect()] == [("12", "2.a", "law_no_5_of_2004", 0.99), ("3a", None, None, 0.5), (None, None, None, 0.5), (None, None, "law_no_7", 0.2), (None, None, None, 0.0)]


def test_fallback_takes_the_first_level_with_rows(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    levels = [spark.createDataFrame(x, "q int, v string") for x in ([(1, "a")], [(1, "b"), (2, "c")], [(2, "d")])]
    assert sorted((r.q, r.v, r.level) for r in rules.fallback_levels(q, "q", levels).collect()) == [(1, "a", 1), (2, "c", 2)]


def test_direct_answers(spark):
    rows = [(1, 0.9, "x", False), (1, 0.3, "y", False), (2, 0.4, "x", False), (3, 0.9, "x", False), (3, 0.85, "x", False), (4, 0.9, "x", True), (5, 0.9, "x", False), (5, 0.5, "y", False)]
    out = rules.direct_answers(spark.createDataFrame(rows, "q int, s double, v string, b boolean"), "q", "s", "v", "b", ["v"])
    assert sorted(map(tuple, out.collect())) == [(1, "x", "answered"), (2, None, "weak"), (3, None, "close"), (4, None, "conditional"), (5, None, "contradicted")]


def test_agreement_and_pages(spark):
    rows = [(1, "x", True, False), (2, "x", False, False), (2, "x", False, True), (3, "x", False, True), (4, "x", False, False), (4, "y", False, False)]
    out = rules.agreement(spark.createDataFrame(rows, "q int, a string, ab boolean, g boolean"), "q", "a", "ab", "g")
    assert sorted(map(tuple, out.collect())) == [(1, "all_abstain"), (2, "consensus"), (3, "single_grounded"), (4, "disagreement")]
    pages = [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (3, 1, 0), (3, 2, 0), (5, 1, None)]
    bad = rules.page_violations(spark.createDataFrame(pages, "q int, i int, p int"), "q", "p", ["i"])
    assert sorted(map(tuple, bad.collect())) == [(2, "pages_not_ascending"), (3, "page_below_one"), (3, "page_repeated")]


def test_earlier_of(spark):
    rows = spark.createDataFrame([(1, "a", "2001-01-01"), (1, "b", "2002-01-01"), (2, "a", "2001-01-01"), (2, "b", "2001-01-01"), (3, "a", "2001-01-01"), (3, "b", None), (4, "a", "2001-01-01")], "q int, i string, d string")
    assert sorted(map(tuple, rules.earlier_of(rows, "q", "i", "d").collect())) == [(1, "a", False), (2, None, True), (3, None, True), (4, None, True)]


def test_all_amounts_of_a_text_are_found(spark):
    many = spark.createDataFrame([(" and ".join(f"USD {k}" for k in range(1, 101)) + " and USD 7",)], "t string")
    assert [m.value for m in many.select(clauses.money(F.col("t")).alias("m")).first().m] == [float(k) for k in range(1, 101)]


def test_fingerprints_don_t_depend_on_the_order(spark):
    from lexloom.operators import versions

    rows = [("a", "x"), ("a", "y"), ("a", None), ("b", None), ("a", "x")]
    made = [sorted(map(tuple, versions.fingerprint(spark.createDataFrame(r, "g string, t string"), "g", "t").collect())) for r in (rows, rows[::-1])]
    assert made[0] == made[1] and [(g, n, k) for g, n, k, _ in made[0]] == [("a", 4, 3), ("b", 1, None)]
    other = versions.fingerprint(spark.createDataFrame(rows[:4], "g string, t string"), "g", "t").where("g = 'a'").first()
    assert other.fingerprint != made[0][0][3]


def test_notices_of_each_target(spark):
    rows = spark.createDataFrame([(1, 5, "2020"), (1, 6, None), (2, 7, "2019"), (1, 8, "2020"), (1, 4, "2019")], "t int, k int, d string")
    assert [(r.t, r.k) for r in rules.notices(rows, "t", "d", "k").orderBy("t", "place").collect()] == [(1, 6), (1, 4), (1, 5), (1, 8), (2, 7)]


def test_quality_score_of_empty_noisy_and_legal_texts(spark):
    from lexloom.functions import text

    words = " ".join(f"The court{chr(97 + i % 26)}{chr(97 + i // 26)} heard matter" for i in range(60))
    legal = "In case no 5 the court gave judgment under article 7 of the law. " + words
    rows = [(1, None), (2, ""), (3, "short text"), (4, legal), (5, legal + " " + "=" * 11), (6, "/Type /Font /Length " * 30), (7, "word " * 30)]
    score, low = text.quality_score(F.col("t"))
    got = {r["i"]: r for r in spark.createDataFrame(rows, "i int, t string").select("i", score.alias("score"), low.alias("low"), *(c.alias(n) for n, c in text.noise_features(F.col("t")).items())).collect()}
    assert [got[i]["score"] for i in (1, 2, 3)] == [0, 0, 0] and all(got[i]["low"] for i in (1, 2, 3, 5, 6, 7))
    assert got[4]["score"] > 0.58 and not got[4]["low"] and got[4]["legal_hits"] == 5
    assert got[5]["repeated_chars"] and got[6]["pdf_operator_hits"] == 90 and got[6]["score"] == 0


def test_triage_of_a_sound_and_a_failed_question(spark):
    from lexloom.functions import triage

    schema = "route string, fits boolean, success boolean, valid boolean, model string, pages int, abstained boolean, negative boolean, old boolean, crossing boolean, of_case boolean, typed boolean"
    rows = [
        ("law", None, True, None, "m", 2, False, False, True, True, True, True),
        (None, None, False, False, None, None, True, False, True, True, True, True),
        ("law", True, True, True, "m", 0, True, True, False, False, False, False),
        ("law", True, True, True, "m", 1, True, True, False, False, False, False),
    ]
    c = [F.col(x.split()[0]) for x in schema.split(", ")]
    found = triage.failure_buckets(*c[:11])
    score = triage.severity(found, F.col("crossing"), F.col("typed"))
    got = [tuple(r) for r in spark.createDataFrame(rows, schema).select(found, score, triage.severity_label(score), triage.status(score, F.col("negative"))).collect()]
    assert got[0] == ([], 5, "low", "review")
    assert got[1] == (["route_error", "contract_or_telemetry_error", "retrieval_error", "answerable_vs_abstain_conflict", "history_or_version_conflict", "compare_dimension_conflict", "case_identity_conflict"], 100 + 90 + 80 + 70 + 65 + 60 + 55 + 10, "critical", "review_high")
    assert got[2] == ([], 0, "low", "expected_negative")
    assert got[3] == (["wrong_sources"], 85, "medium", "review")


def test_a_quality_struct_reads_its_text_once(spark):
    from lexloom.functions import text

    frame = spark.createDataFrame([(" x y ",)], "t string")
    plan = frame.select(text.quality(F.col("t")).alias("q"))._jdf.queryExecution().analyzed().toString()
    # the trim at the ends, and the patterns of words, stand in it once or twice, not once for every feature
    assert plan.count("regexp_replace(coalesce(t") == 1 and plan.count("FlateDecode") == 1
    r = frame.select(text.quality(F.col("t")).alias("q")).select("q.*").first()
    assert (r.score, r.low_quality, r.single_letter_ratio) == (0.0, True, 1.0)


def test_page_violations_are_dealt_by_the_input(spark):
    rows = spark.range(0, 4000, numPartitions=7).selectExpr("id % 900 AS q", "id AS i", "id AS p")
    bad = rules.page_violations(rows, "q", "p", ["i"])
    assert [tuple(r) for r in bad.collect()] == [(0, "page_below_one")]
    assert "hashpartitioning(q#" in (plan := bad._jdf.queryExecution().executedPlan().toString()) and f", {7 * rules.PARTS}), REPARTITION" in plan
