from pyspark.sql import functions as F

from lexloom.functions import scores, text
from lexloom.operators import chunking, evaluation, review, search, versions


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_overlap_of_empty_sides(spark):
    rows = spark.createDataFrame([(1, [], []), (2, ["a"], []), (3, None, ["a"]), (4, ["a", "b", "b"], ["b", "c"])], "id int, p array<string>, g array<string>")
    out = values(rows.select("id", *(c.alias(n) for n, c in scores.overlap(F.col("p"), F.col("g")).items())), "id")
    assert out[:3] == [(1, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)]
    assert out[3][1:3] == (0.5, 0.5) and abs(out[3][3] - 0.5) < 1e-12


def test_latency_factor_is_clamped(spark):
    rows = spark.createDataFrame([(0.0,), (1000.0,), (3000.0,), (5000.0,), (9000.0,)], "ms double")
    assert [round(r[0], 6) for r in rows.select(scores.latency_factor(F.col("ms"))).collect()] == [1.05, 1.05, 0.95, 0.85, 0.85]


def test_list_answers(spark):
    rows = spark.createDataFrame([(1, ["a"], None, True), (2, None, ["a"], True), (3, ["b", "a"], ["a", "b"], False), (4, ["a"], ["a", "b"], False), (5, ["a"], [], False)], "id int, a array<string>, e array<string>, ab boolean")
    assert [r[1] for r in values(rows.select("id", scores.list_answer_score(F.col("a"), F.col("e"), F.col("ab"))), "id")] == [1.0, 0.0, 1.0, 0.5, 0.0]


def test_lexical_scores_are_substrings_with_repeats(spark):
    q = spark.createDataFrame([(1, "art Art law"), (2, "   "), (3, None)], "q long, t string")
    d = spark.createDataFrame([(10, "the PARTY"), (11, None), (12, "law art")], "d long, x string")
    assert values(search.lexical_scores(q, d, "q", "t", "d", "x"), "d") == [(1, 10, 2 / 3), (1, 12, 1.0)]


def test_lexical_best_are_the_first_of_all_scores(spark, monkeypatch):
    monkeypatch.setattr("lexloom.operators.best.QUESTIONS", 3)
    monkeypatch.setattr("lexloom.operators.best.PARTS", 2)
    words = "art law état a aa aaa party\u00a0x of 法律".split(" ")
    q = spark.createDataFrame([(i, " ".join(words[(i * j) % 9] for j in range(1, 2 + i % 5))) for i in range(20)] + [(20, "  "), (21, None)], "q long, t string")
    d = spark.createDataFrame([(i, " ".join(words[(i + j * j) % 9].upper() + "s" * (j % 2) for j in range(i % 7))) for i in range(60)] + [(60, None)], "d long, x string")
    for boost in (0.0, 0.3):
        order = [F.least(F.lit(1.0), F.col("score") + boost).desc(), F.col("d").asc()]
        every, some = search.lexical_scores(q, d, "q", "t", "d", "x"), search.lexical_best(q, d, "q", "t", "d", "x", 4, boost)
        assert values(search.top_k(some, ["q"], order, 4), "q", "rank") == values(search.top_k(every, ["q"], order, 4), "q", "rank")
    assert some.count() < every.count()


def test_filters_ignore_null_values_and_fail_null_columns(spark):
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, None, ["x"]), (3, "a", None)], "id int, k string, t array<string>")
    assert [r[0] for r in values(search.matching(rows, {"k": "a", "t": "x"}), "id")] == [1]
    assert search.matching(rows, {"k": None}).count() == 3


def test_tokens_of_answers(spark):
    rows = spark.createDataFrame([("USD 1,250.50 due", "Yes ", "13/02/2021"), ("none", "maybe", "01/02/2021"), (None, "0", "2019"), ("-3", None, "2020-02-30")], "n string, b string, d string")
    got = [tuple(r) for r in rows.select(text.number_token(F.col("n")), text.boolean_token(F.col("b")), text.iso_date(F.col("d")).cast("string")).collect()]
    assert got == [(1250.5, True, "2021-02-13"), (None, None, None), (None, False, "2019-01-01"), (-3.0, None, None)]


def test_versions_and_chains(spark):
    rows = spark.createDataFrame([("a", "g", "2019", False), ("b", "g", "2021", None), ("c", "g", "2021", True), ("d", None, None, None)], "id string, grp string, start string, cur boolean")
    order = [F.coalesce("start", F.lit("")), F.col("id")]
    assert [r[-1] for r in values(versions.version_sequence(rows, "grp", order), "id")] == [1, 2, 3, None]
    assert [r[0] for r in versions.current_version(rows.where("grp IS NOT NULL"), "grp", F.col("cur"), [F.col("start").desc(), F.col("id").desc()]).collect()] == ["c"]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, None), (5, 9)], "n long, s long")
    assert values(versions.supersession(links, "n", "s"), "node") == [(1, 3, 2, False), (2, 3, 1, False), (3, 3, 0, False), (4, 4, 0, False), (5, 9, 1, False)]


def test_long_chains_end_and_cycles_stop_before_they_repeat(spark):
    chain = [(k, k + 1 if k < 299 else None) for k in range(300)]
    cycles = [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (1004, 1004), (1005, 1003), (10, 11), (2000, 2001), (2001, 2000), (2002, 2000)]
    links = {n: s for n, s in chain} | {n: s for n, s in cycles if n >= 1000}

    def walk(node):
        seen = [node]
        while links.get(seen[-1]) is not None and links[seen[-1]] not in seen:
            seen.append(links[seen[-1]])
        return node, seen[-1], len(seen) - 1, links.get(seen[-1]) is not None

    frame = spark.createDataFrame(list(links.items()), "n long, s long")
    assert values(versions.supersession(frame, "n", "s"), "node") == sorted(map(walk, links))
    only = versions.supersession(frame.where("n >= 2000"), "n", "s")
    assert values(only, "node") == [(2000, 2001, 1, True), (2001, 2000, 1, True), (2002, 2001, 2, True)]
    assert versions.supersession(frame.where("n < 0"), "n", "s").count() == 0


def test_no_text_is_lost_at_unicode_white_space(spark):
    texts = ["first half\u2028second half", "a\u0085b", "x\x1cy\u00a0z\u3000w", "one\u2029\n\ntwo " + "word\u2003" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in chunking.sized(rows, "id", "t").orderBy("id", "ordinal").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert ["".join("".join(got[k]).split()) for k in range(4)] == ["".join(t.split()) for t in texts]
    assert got[0] == ["first half second half"] and got[1] == ["a b"] and got[2] == ["x y z w"]


def test_words_of_cyrillic_texts_count(spark):
    rows = spark.createDataFrame([("Суд вынес решение по делу и " * 15,)], "t string")
    f = text.quality_features(F.col("t"))
    assert rows.select(f["word_count"], f["diversity"]).first()[0] == 75


def test_duplicate_anchor_keeps_a_null(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, t string")
    assert [(r.id, r.duplicate_of) for r in versions.duplicate_anchor(rows, "t", "id").orderBy("id").collect()] == [(1, None), (2, 1), (3, None)]


def test_sized_chunks_cover_the_text(spark):
    body = " ".join(f"word{i}" for i in range(700))
    rows = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "x" * 2000), (5, "a b")], "id long, t string")
    out = chunking.sized(rows, "id", "t").orderBy("id", "ordinal").collect()
    one = [r.chunk for r in out if r.id == 1]
    assert " ".join(one) == body and all(len(c) <= 900 for c in one)
    assert "".join(r.chunk for r in out if r.id == 4) == "x" * 2000
    assert not [r for r in out if r.id in (2, 3)] and [r.chunk for r in out if r.id == 5] == ["a b"]


def test_sized_chunks_end_at_empty_lines_and_before_the_limit(spark):
    at_limit, beyond = "a" * 899 + " " + "b" * 300, "a" * 900 + " " + "b" * 300
    early = "a" * 150 + " " + "b" * 1000
    rows = spark.createDataFrame([(1, "one  line\nof two\n\n \n\nnext"), (2, at_limit), (3, beyond), (4, early), (5, "\n\n\n")], "id long, t string")
    got = {}
    for r in chunking.sized(rows, "id", "t").orderBy("id", "ordinal").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert got == {1: ["one line of two", "next"], 2: ["a" * 899, "b" * 300], 3: ["a" * 900, "b" * 300], 4: [early[:900], early[900:]]}


def test_stratified_sample_is_round_robin(spark):
    rows = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(7)], "id long, s string")
    assert [r.id for r in review.stratified_sample(rows, F.col("s"), "id", 5).collect()] == [0, 5, 1, 6, 2]
    assert [review.proxy_size(n) for n in (0, 10, 100, 1000, 10_000)] == [0, 10, 50, 250, 300]


def test_percentile_places(spark):
    rows = spark.createDataFrame([("k", float(i), 1.0) for i in range(1, 11)], "k string, ms double, one double")
    r = evaluation.run_metrics(rows, "one", "one", "one", "ms", ["k"]).first()
    assert (r.p50, r.p95) == (6.0, 9.0)


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "id long, k string, v double, tags array<string>")
    assert evaluation.value_report(rows, "k", "v", "tags").count() == 0
    assert evaluation.compare_runs(rows, rows, "id", "v").count() == 0
    assert chunking.sized(rows.withColumnRenamed("k", "t"), "id", "t").count() == 0


def test_values_are_searched_once_however_many_there_are(spark):
    from lexloom.functions.references import ordered_distinct

    frame = spark.createDataFrame([(["B", "a  b", "", "b", "A B", "c"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in frame.select(ordered_distinct(F.col("v"), 2)).collect()] == [["B", "a b"], [], None]
    found = F.regexp_extract_all(F.lit("x"), F.lit("(y)"), 1)
    plan = frame.select(ordered_distinct(F.concat("v", found), 9).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1
