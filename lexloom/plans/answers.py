"""Routing, contract and answer queries; question texts are made from orders by a template, line items are candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import references, routing
from ..operators import answers, contracts
from .registry import query, table

TEMPLATES = (
    "Compare Law No. 5 of 2004 with Law No. 6 of 2005",
    "What does article 12 of the law say?",
    "Which judge heard CFI 10/2019 and CFI 11/2020?",
    "Was a plea bargain offered to the claimant?",
    "Was Law No. 5 of 2004 amended by a later law?",
    "Who is the respondent in the appeal?",
    "What is the modified schedule?",
    "What is the purpose of the regulations?",
    "Does the clause apply?",
)


#: What joins a question's two halves, by the customer.
JOINTS = (" ", " and ", ", or under article 7: ", "; earlier than ", " between the claimant: ")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions of two halves, by three of their columns."""
    half = lambda k: reduce(lambda w, kv: w.when(k == kv[0], kv[1]), enumerate(TEMPLATES), F.when(F.lit(False), ""))
    joint = F.get(F.array(*map(F.lit, JOINTS)), (F.col("o_custkey") % 5).cast("int"))
    text = F.concat(half(F.col("o_orderkey") % 9), F.when(F.col("o_custkey") % 3 > 0, F.concat(joint, half(F.col("o_custkey") % 9))).otherwise(""))
    kind = F.when(F.col("o_orderstatus") == "F", "name").when(F.col("o_orderstatus") == "O", "boolean").otherwise("free_text")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("question"), kind.alias("answer_type"), F.when(F.col("o_orderkey") % 50 == 0, "no_answer").alias("hint"))


_HALVES = "['" + "', '".join(TEMPLATES) + "']"


def _any(kind: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in routing.WORDS[kind]) + ")"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


_LAW_REF = "[ (]law no[.]? *[0-9]+ of [0-9]{4}|^law no[.]? *[0-9]+ of [0-9]{4}"
# signals and rules over the questions' texts
_QUESTIONS = f"""q AS (SELECT o_orderkey, o_orderstatus, lower({_HALVES}[o_orderkey % 9 + 1] || CASE WHEN o_custkey % 3 > 0 THEN ['{"', '".join(JOINTS)}'][o_custkey % 5 + 1] || {_HALVES}[o_custkey % 9 + 1] ELSE '' END) AS t, o_orderkey % 50 = 0 AS hinted FROM orders)"""
_ROUTED = rf"""{_QUESTIONS},
  w AS (SELECT *, {", ".join(f"{_any(k)} AS {'w_' + k}" for k in routing.WORDS)}, {_n(_LAW_REF)} AS law_refs, {_n("(^|[^a-z])laws?([^a-z]|$)")} AS laws,
      {_n("(^|[^a-z])regulations?([^a-z]|$)")} AS rules, {_n("(cfi|ca|arb|tcd|enf|dec|sct) *[0-9]{1,3}/[0-9]{4}")} AS cases, regexp_matches(t, '(article|section|paragraph|clause|schedule) [0-9]') AS provided FROM q),
  v AS (SELECT *, law_refs >= 2 OR laws >= 2 OR rules >= 2 AS many, provided OR w_provision AS prov, cases > 0 OR w_case AS about_case, w_history AND NOT w_temporal AS past FROM w),
  u AS (SELECT *, w_law_compare OR w_compare OR (contains(t, 'administer') AND NOT prov AND (many OR w_law_plural OR contains(t, 'same entity') OR contains(t, 'same authority'))) OR (w_law_plural AND (w_law_filter OR w_temporal OR many)) AS framed FROM v),
  r AS (SELECT *, CASE WHEN about_case AND cases >= 2 AND (w_compare OR w_case_compare OR contains(t, ' and ') OR contains(t, ' or ') OR contains(t, 'between ')) THEN 1
      WHEN (laws > 0 OR rules > 0) AND (many OR w_law_plural) AND framed AND NOT (past AND NOT w_compare AND NOT w_law_compare) THEN 2 WHEN w_negative THEN 3 WHEN past AND w_lineage AND NOT w_compare THEN 4 WHEN prov THEN 5 WHEN w_history THEN 6
      WHEN w_article THEN 7 WHEN about_case THEN 8 ELSE 9 END AS rule FROM u),
  routed AS (SELECT *, CASE WHEN hinted THEN 'no_answer' ELSE ['cross_case_compare', 'cross_law_compare', 'no_answer', 'history_lineage', 'article_lookup', 'history_lineage', 'article_lookup', 'single_case_extraction', 'article_lookup'][rule] END AS route,
      CASE WHEN hinted THEN 0.99 ELSE [0.93, 0.92, 0.94, 0.9, 0.9, 0.85, 0.85, 0.8, 0.6][rule] END::DOUBLE AS confidence FROM r)"""


@query(f"WITH {_ROUTED} SELECT o_orderkey, route, confidence FROM routed")
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = routing.decide(F.col("question"), F.col("hint"))
    return questions(spark, sf_dir).select("o_orderkey", d["route"].alias("route"), d["confidence"].cast("double").alias("confidence"))


@query(f"""WITH {_ROUTED}, p AS (SELECT *, o_orderkey % 12 + 1 AS pages FROM routed), m AS (SELECT *, CASE route WHEN 'article_lookup' THEN 2.0 WHEN 'single_case_extraction' THEN 1.5 WHEN 'no_answer' THEN 0 WHEN 'cross_law_compare' THEN 2.5 ELSE 2.0 END AS k,
    CASE route WHEN 'article_lookup' THEN 16 WHEN 'single_case_extraction' THEN 12 WHEN 'history_lineage' THEN 20 WHEN 'cross_case_compare' THEN 18 WHEN 'cross_law_compare' THEN 24 ELSE 0 END AS cap,
    CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND route <> 'single_case_extraction') THEN CASE route WHEN 'article_lookup' THEN 2 WHEN 'single_case_extraction' THEN 2 WHEN 'history_lineage' THEN 4 WHEN 'cross_case_compare' THEN 3 WHEN 'cross_law_compare' THEN 4 ELSE 0 END
    ELSE CASE route WHEN 'article_lookup' THEN 3 WHEN 'single_case_extraction' THEN 3 WHEN 'history_lineage' THEN 5 WHEN 'cross_case_compare' THEN 4 WHEN 'cross_law_compare' THEN 5 ELSE 0 END END AS used FROM p)
  SELECT o_orderkey, least(cap, greatest(pages, round_even(pages * k, 0)::INT)) AS candidate_pages, least(used, cap, greatest(pages, round_even(pages * k, 0)::INT)) AS used_pages FROM m""")
def retrieval_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir).withColumn("route", routing.decide(F.col("question"), F.col("hint"))["route"])
    b = routing.budget(F.col("route"), (F.col("o_orderkey") % 12 + 1).cast("int"), F.col("answer_type"))
    return rows.select("o_orderkey", b["candidate_pages"].cast("long").alias("candidate_pages"), b["used_pages"].cast("long").alias("used_pages"))


@query(f"WITH {_ROUTED} SELECT o_orderkey, CASE WHEN laws >= 2 THEN 'cross' WHEN laws = 1 THEN 'one' ELSE 'none' END AS law_words, w_compare AS compares, about_case FROM routed")
def route_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = routing.signals(F.col("question"))
    many = F.regexp_count(F.lower("question"), F.lit(routing.PATTERNS["law_word"])) >= 2
    return questions(spark, sf_dir).select("o_orderkey", F.when(many, "cross").when(s["law"], "one").otherwise("none").alias("law_words"), s["compare"].alias("compares"), s["case"].alias("about_case"))


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(text, '\\b(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|(?:19|20)[0-9]{2})\\b'), lambda x: x <> '') AS v FROM documents)
  SELECT doc_id, len(u) AS n_dates, coalesce(u[1], '') AS first_date FROM (SELECT doc_id, list_filter(v, lambda x, i: list_position(v, x) = i)[1:24] AS u FROM d)""")
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", references.references(F.col("text"), 24)["dates"].alias("d"))
    return found.select("doc_id", F.size("d").cast("long").alias("n_dates"), F.coalesce(F.get("d", F.lit(0)), F.lit("")).alias("first_date"))


@query()
def document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in references.references(F.col("text")).items()))


def _hints(kind: str) -> str:
    """The number of a kind's hints in a text: phrases wherever they stand, words as words."""
    phrase = lambda h: f"(length(t) - length(replace(t, '{h}', ''))) // {len(h)}"
    word = lambda h: f"len(list_filter(words, lambda w: w = '{h}'))"
    return " + ".join(phrase(h) if " " in h else word(h) for h in references.HINTS[kind])


_STRONG = {
    "case": "claim no([^a-z]|$)|judgment|court of|(^|[^a-z])v [a-z]",
    "enactment_notice": "enactment notice",
    "regulation": "(^|[^a-z])regulations?([^a-z]|$)",
    "law": "(^|[^a-z])law no",
}


@query(f"""WITH {_QUESTIONS}, k AS (SELECT o_orderkey, t, string_split_regex(t, '[^\\p{{L}}\\p{{N}}_]+') AS words FROM (SELECT o_orderkey, regexp_replace(regexp_replace(t, '[_-]+', ' ', 'g'), '[ \\t]+', ' ', 'g') AS t FROM q)),
  n AS (SELECT o_orderkey, {", ".join(f"{_hints(kind)} + CASE WHEN regexp_matches(t, '{_STRONG[kind]}') THEN 4 ELSE 0 END AS n_{kind}" for kind in references.HINTS)} FROM k),
  b AS (SELECT o_orderkey, list_max([[n_case, 1], [n_regulation, 2], [n_law, 3], [n_enactment_notice, 4]]) AS best FROM n)
  SELECT o_orderkey, CASE WHEN best[1] = 0 THEN 'other' ELSE ['case', 'regulation', 'law', 'enactment_notice'][best[2]] END AS doc_type, CASE WHEN best[1] = 0 THEN 0.2 ELSE round(least(0.95, 0.30 + best[1] * 0.12), 9) END::DOUBLE AS confidence FROM b""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = references.document_type(F.lit(""), F.col("question"))
    return questions(spark, sf_dir).select("o_orderkey", found["doc_type"].alias("doc_type"), F.round(found["confidence"], 9).cast("double").alias("confidence"))


@query("""SELECT l_orderkey AS question_id, CASE WHEN min(l_tax) = max(l_tax) THEN min(l_tax) END AS answer, min(l_tax) <> max(l_tax) AS abstained, count(l_tax) AS considered FROM lineitem GROUP BY 1""")
def number_unanimity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.unanimous(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "question_id"), "question_id", "l_tax")


@query("""WITH v AS (SELECT conv_id, count(*) FILTER (WHERE text LIKE '%ing%' AND NOT text LIKE '%ou%') AS yes, count(*) FILTER (WHERE text LIKE '%ou%') AS no FROM conversations GROUP BY 1), a AS (SELECT *, CASE WHEN yes > 0 AND no = 0 THEN TRUE WHEN no > 0 AND yes = 0 THEN FALSE END AS answer FROM v)
  SELECT conv_id, answer, answer IS NULL AS abstained, yes, no FROM a""")
def boolean_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.boolean_vote(table(spark, sf_dir, "conversations"), "conv_id", "text", "ing", "ou")


@query("""SELECT question_id, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS names, count(DISTINCT p_brand) = 0 AS abstained FROM (SELECT l_orderkey AS question_id, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1""")
def name_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("question_id"), F.array("p_brand").alias("names"))
    return answers.name_union(rows, "question_id", "names").select("question_id", F.array_join("answer", ",").alias("names"), "abstained")


@query("""WITH b AS (SELECT l_orderkey AS question_id, l_suppkey AS page, l_linenumber, l_discount + CASE WHEN l_returnflag = 'A' THEN 0.35 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 0.06 ELSE 0 END + CASE WHEN l_quantity > 40 THEN 0.2 ELSE 0 END AS s FROM lineitem),
  o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY question_id, page ORDER BY s DESC, l_linenumber) = 1)
  SELECT question_id, page, s AS boosted_score, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, l_linenumber, page) AS place FROM o""")
def reranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("question_id"), F.col("l_suppkey").alias("page"), "l_linenumber", F.col("l_discount").alias("score"), (F.col("l_returnflag") == "A").alias("hit"), (F.col("l_linestatus") == "O").alias("current"), (F.col("l_quantity") > 40).alias("art"))
    return answers.rerank(rows, "question_id", "page", "score", {"exact_identifier": "hit", "current_version": "current", "article": "art"}, ("l_linenumber",)).select("question_id", "page", "boosted_score", "place")


@query("""WITH r AS (SELECT l_orderkey AS question_id, 'p' || l_suppkey % 7 AS page, l_discount AS score, unnest([l_returnflag, l_linestatus, l_linenumber::VARCHAR]) AS word, l_quantity > 45 AS exact FROM lineitem),
  p AS (SELECT question_id, page, max(score) AS best, list(DISTINCT word) AS words, max(exact::INT) AS exact FROM r GROUP BY 1, 2),
  a AS (SELECT *, best + 0.25 * len(words) + 0.45 * exact AS gain, row_number() OVER (PARTITION BY question_id ORDER BY best + 0.25 * len(words) + 0.45 * exact DESC, best DESC, page) AS place FROM p),
  b AS (SELECT x.question_id, x.page, x.best, x.best + 0.25 * (len(x.words) - len(list_intersect(x.words, f.words))) + 0.45 * x.exact AS gain FROM a x JOIN a f ON f.question_id = x.question_id AND f.place = 1 WHERE x.place > 1),
  c AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY gain DESC, best DESC, page) AS turn FROM b)
  SELECT question_id, page, 1 AS place, round(gain, 9) AS gain FROM a WHERE place = 1 UNION ALL SELECT question_id, page, 2, round(gain, 9) FROM c WHERE turn = 1""")
def evidence_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.concat(F.lit("p"), F.col("l_suppkey") % 7).alias("page"), F.col("l_discount").alias("score"), F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("keywords"), (F.col("l_quantity") > 45).alias("exact"))
    return answers.evidence_cover(refs, "question_id", "page", "score", "keywords", "exact", 2).withColumn("gain", F.round("gain", 9))


_LINES = "src AS (SELECT l_orderkey AS question_id, l_linenumber AS i, CASE WHEN l_linenumber = 3 THEN '' WHEN l_linenumber = 4 THEN 'bad id' WHEN l_linenumber = 5 THEN 'doc_9' ELSE 'doc_' || l_linenumber END AS source_page_id, CASE WHEN l_linenumber = 6 THEN NULL ELSE 'doc' END AS pdf_id, l_linenumber AS page_num, l_returnflag <> 'N' AS used FROM lineitem)"


@query(f"""WITH {_LINES}, w AS (SELECT question_id, CASE WHEN NOT used THEN NULL WHEN i = 3 THEN 'source_page_id_missing' WHEN i = 4 THEN 'source_page_id_pattern_invalid' WHEN i = 6 THEN 'pdf_id_missing' WHEN i = 5 THEN 'source_page_id_not_canonical' END AS what FROM src)
  SELECT question_id, count(what) AS n_issues, coalesce(array_to_string(list_sort(list(DISTINCT what) FILTER (WHERE what IS NOT NULL)), ','), '') AS kinds FROM w GROUP BY 1""")
def source_page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_linenumber")
    source = F.struct(F.when(i == 3, "").when(i == 4, "bad id").when(i == 5, "doc_9").otherwise(F.concat(F.lit("doc_"), i)).alias("source_page_id"), F.when(i != 6, "doc").alias("pdf_id"), i.alias("page_num"), (F.col("l_returnflag") != "N").alias("used"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.explode_outer(contracts.source_issues(F.array(source))).alias("issue"))
    kind = F.substring_index("issue", ".", -1)  # a source at a time, so that no question's sources are gathered
    return found.groupBy("question_id").agg(F.count("issue").alias("n_issues"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS invalid, 1 - count(*) FILTER (WHERE bad) / count(*) AS pass_rate, count(*) FILTER (WHERE bad) = 0 AS gate_passed FROM (SELECT event_id % 11 = 0 OR value < 1 AS bad FROM events)""")
def submission_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.struct((F.col("event_id") % 11 != 0).alias("telemetry_complete"), *(F.lit("x").alias(c) for c in ("trace_id", "model_name", "route_name", "search_profile")), F.lit(1.0).alias("ttft_ms"), F.col("value").alias("total_response_ms"))
    return contracts.preflight(table(spark, sf_dir, "events").select(contracts.telemetry_issues(t).alias("issues")), "issues")


_ASKED = """asked AS (SELECT o_orderkey AS question_id, *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'free_text' ELSE 'number' END AS answer_type FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*) AS pages, count(*) FILTER (WHERE l_returnflag = 'R') AS exact, count(*) FILTER (WHERE l_linestatus = 'O') AS agreeing, bool_or(l_returnflag = 'A') AS used FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions, with their line items as sources."""
    kind = lambda c, v: F.count_if(F.col(c) == v)
    source = F.struct((F.col("l_returnflag") == "A").alias("used"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("pages"),
        kind("l_returnflag", "R").alias("exact"),
        kind("l_linestatus", "O").alias("agreeing"),
        F.collect_set(source).alias("sources"),  # two values at most
    )
    rows = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.withColumns({"question_id": F.col("o_orderkey"), "answer_type": F.when(F.col("o_orderpriority") == "1-URGENT", "free_text").otherwise("number")})


@query(f"""WITH {_ASKED}, n AS (SELECT question_id, (o_totalprice - 100000) / 400000 AS top, (o_custkey % 10) / 100 AS gap, coalesce(pages, 0) AS pages, coalesce(exact, 0) AS exact, coalesce(agreeing, 0) AS agreeing,
    o_orderstatus = 'F' AS abstained, answer_type FROM asked)
  SELECT question_id, CASE WHEN abstained AND top <= 0 THEN 'no_corpus_support' WHEN abstained AND agreeing <= 0 THEN 'insufficient_uniqueness' WHEN abstained THEN 'conflicting_evidence'
    WHEN answer_type = 'free_text' AND top < 0.35 AND gap < 0.05 AND pages >= 3 AND exact = 0 THEN 'low_retrieval_quality' END AS reason FROM n""")
def abstain_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each question stays unanswered; null where it is answered."""
    count = lambda c: F.coalesce(c, F.lit(0))
    top, gap = (F.col("o_totalprice") - 100000) / 400000, (F.col("o_custkey") % 10) / 100
    reason = answers.abstain_reason(F.col("o_orderstatus") == "F", F.col("answer_type"), top, gap, count("pages"), count("exact"), count("agreeing"))
    return asked(spark, sf_dir).select("question_id", reason.alias("reason"))


@query(f"""WITH {_ASKED}, a AS (SELECT question_id, answer_type, coalesce(used, FALSE) AS used, o_orderkey % 3 = 0 AS no_answer, o_orderkey % 5 = 0 AS blank, o_custkey % 2 = 1 AS sure FROM asked WHERE o_orderstatus <> 'O')
  SELECT question_id, concat_ws(',', CASE WHEN used THEN 'no_answer:abstained_response_must_not_have_used_sources' END, CASE WHEN sure THEN 'no_answer:abstained_response_confidence_must_be_zero' END,
    CASE WHEN answer_type = 'free_text' AND NOT no_answer AND blank THEN 'no_answer:free_text_abstain_answer_must_be_non_empty_text_or_null' END,
    CASE WHEN answer_type <> 'free_text' AND NOT no_answer THEN 'no_answer:abstained_non_free_text_answer_must_be_null' END) AS issues FROM a
  UNION ALL SELECT question_id, '' FROM asked WHERE o_orderstatus = 'O'""")
def no_answer_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the form of every answer that abstains."""
    key = F.col("question_id")
    text, confidence = F.when(key % 5 == 0, " ").otherwise(F.col("o_orderpriority")), F.when(F.col("o_custkey") % 2 == 1, 0.4).otherwise(0.0)
    issues = contracts.no_answer_issues(key % 3 == 0, text, F.col("answer_type"), F.col("o_orderstatus") != "O", confidence, F.col("sources"))
    return asked(spark, sf_dir).select("question_id", F.array_join(contracts.merged(no_answer=issues), ",").alias("issues"))


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'law' WHEN 1 THEN 'regulation' WHEN 2 THEN 'case' ELSE 'other' END AS doc_type, o_orderpriority, o_custkey FROM orders),
  g AS (SELECT *, CASE WHEN doc_type IN ('law', 'regulation') AND o_custkey % 7 > 0 THEN concat_ws(':', doc_type,
      CASE WHEN o_orderkey % 3 > 0 THEN nullif(array_to_string(list_filter(string_split_regex(lower(substr(o_orderpriority, 3)), '[^a-z]+'), lambda w: length(w) > 1), '_'), '') END, (o_custkey % 9) || '_a')
    WHEN doc_type = 'case' AND o_custkey % 5 > 0 THEN 'case:cfi' || CASE WHEN o_custkey % 2 = 0 THEN '_' || (o_custkey % 90) || '_2020' ELSE '-' || (o_custkey % 90) || '-2019' END ELSE 'doc' || o_orderkey END AS version_group FROM d)
  SELECT version_group, count(*) AS versions, min(o_orderkey) AS first_document, max(o_orderkey) AS last_document FROM g GROUP BY 1""")
def version_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are versions of one law, regulation or case."""
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "law").when(key % 4 == 1, "regulation").when(key % 4 == 2, "case").otherwise("other")
    holder = F.col("o_custkey")
    number = F.when(holder % 7 > 0, F.concat(holder % 9, F.lit(" A")))
    title = F.concat(F.lit("The "), F.expr("substring(o_orderpriority, 3)"), F.lit(" Law\nLAW NO. "), holder % 9, F.lit(" of 2019"))
    strong = F.when(holder % 2 == 0, F.concat(F.lit(" cfi  "), holder % 90, F.lit(" / 2020"))).otherwise(F.concat(F.lit("CFI - "), holder % 90, F.lit("-2019")))
    case = F.when(holder % 5 > 0, strong).otherwise(F.concat(F.lit("Case "), holder))
    group = references.version_group(kind, number, case, F.concat(F.lit("doc"), key), F.when(key % 3 > 0, title).otherwise("Act without a number"))
    return table(spark, sf_dir, "orders").select(group.alias("version_group"), "o_orderkey").groupBy("version_group").agg(F.count("*").alias("versions"), F.min("o_orderkey").alias("first_document"), F.max("o_orderkey").alias("last_document"))
