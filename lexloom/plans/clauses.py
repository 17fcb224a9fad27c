"""Clause queries; sentences are made from orders by a template with the order's own figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clauses
from ..operators.review import conflicts
from .registry import query, table

TEMPLATES = (
    "The employer shall not charge a fee unless the Court agrees.",
    "The company must file its return within {n} days.",
    "The buyer shall pay USD {n},500.50 and interest at 9% per annum.",
    "A person may appeal if permission is granted; otherwise not.",
    "Employee means a person who works for a wage.",
    "A fine of {n} AED is payable, subject to review.",
    "Nothing is said here.",
)


#: What stands before and behind a sentence, by the order's customer and priority.
OPENINGS = ("", "Subject to review, nothing in this Law precludes an agreement: ", "If costs are not paid, ", "Except on a holiday; ", "Upon the application between the Claimant and the Defendant, ")
CLOSINGS = {
    "1-URGENT": " Interest accrues at 4.5% on AED 1,200.",
    "2-HIGH": " The application is dismissed within 14 days.",
    "3-MEDIUM": "",
    "4-NOT SPECIFIED": " It is void unless notified in the Gazette.",
    "5-LOW": " The schedule of reasons is stayed.",
}


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts of up to three sentences, by three of their columns."""
    n = (F.col("o_orderkey") % 90 + 1).cast("string")
    parts = lambda t: F.concat(F.lit(t.split("{n}")[0]), n, F.lit(t.split("{n}")[1])) if "{n}" in t else F.lit(t)
    body = reduce(lambda w, kv: w.when(F.col("o_orderkey") % 7 == kv[0], parts(kv[1])), enumerate(TEMPLATES), F.when(F.lit(False), ""))
    opening = F.get(F.array(*map(F.lit, OPENINGS)), (F.col("o_custkey") % 5).cast("int"))
    closing = F.element_at(F.create_map(*(F.lit(x) for pair in CLOSINGS.items() for x in pair)), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.concat(opening, body, closing).alias("text"))


_BODIES = " ".join(f"WHEN {k} THEN '" + t.replace("{n}", "' || (o_orderkey % 90 + 1) || '") + "'" for k, t in enumerate(TEMPLATES))
_CLOSED = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in CLOSINGS.items())
_TEXTS = f"""s AS (SELECT o_orderkey, o_orderstatus, ['{"', '".join(OPENINGS)}'][o_custkey % 5 + 1] || CASE o_orderkey % 7 {_BODIES} END || CASE o_orderpriority {_CLOSED} END AS text FROM orders),
  low AS (SELECT *, lower(text) AS t FROM s)"""
_MODALITY = r"""CASE WHEN regexp_matches(t, '\b(shall|must) +not\b|\b(prohibited|forbidden)\b') THEN 'prohibition' WHEN regexp_matches(t, '\b(shall|must|is required to|obliged)\b') THEN 'obligation'
    WHEN regexp_matches(t, '\b(may|permitted|authorized)\b') THEN 'permission' WHEN regexp_matches(t, '\b(penalty|penalties|fine|imprisonment|sanction)\b') THEN 'penalty'
    WHEN regexp_matches(t, '\b(unless|except|provided that)\b') THEN 'exception' WHEN regexp_matches(t, '\b(procedure|submit|file|within|application)\b') THEN 'procedure'
    WHEN regexp_matches(t, '\b(minister|authority|court) may\b|\bpower to\b') THEN 'power' WHEN regexp_matches(t, '\b(means|refers to|is defined as)\b') THEN 'definition' ELSE 'procedure' END"""
_LAW_KIND = """CASE WHEN contains(t, 'means') THEN 'definition' WHEN contains(t, 'unless') OR contains(t, 'except') OR contains(t, 'provided that') THEN 'exception'
    WHEN contains(t, 'fine') OR contains(t, 'penalty') OR contains(t, 'liable to') THEN 'penalty' WHEN contains(t, 'apply') OR contains(t, 'file') OR contains(t, 'submit') OR contains(t, 'procedure') THEN 'procedure' ELSE 'operative_provision' END"""
_CUES = [("conditions", clauses.CONDITIONS, 8), ("exceptions", clauses.EXCEPTIONS, 6)]


def _windows(cues: tuple[str, ...], most: int) -> str:
    found = ", ".join(rf"regexp_extract_all(text, '(?i)\b{c}\b[^.;:]{{0,220}}[.;:]?')[1:2]" for c in cues)
    flat = f"list_transform(flatten([{found}]), lambda x: left(trim(x), 220))"
    low = f"list_transform({flat}, lambda x: lower(x))"
    return f"array_to_string(list_filter({flat}, lambda x, i: list_position({low}, lower(x)) = i)[1:{most}], '|')"


@query(f"""WITH {_TEXTS}, m AS (SELECT o_orderkey, {_MODALITY} AS modality FROM low)
  SELECT o_orderkey, modality, CASE modality WHEN 'prohibition' THEN 'prohibits' WHEN 'permission' THEN 'permits' WHEN 'definition' THEN 'defines' WHEN 'penalty' THEN 'penalizes' WHEN 'procedure' THEN 'governs' WHEN 'exception' THEN 'excepts'
    WHEN 'power' THEN 'empowers' ELSE 'requires' END AS relation FROM m""")
def modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("o_orderkey", clauses.modality(F.col("text")).alias("modality")).withColumn("relation", clauses.relation(F.col("modality")))


@query(rf"""WITH {_TEXTS}, m AS (SELECT o_orderkey, t, regexp_extract(t, '\b(?:usd|us\$|aed|eur|gbp) *[0-9][0-9,]*(?:\.[0-9]+)?\b|\b[0-9][0-9,]*(?:\.[0-9]+)? *(?:usd|aed|eur|gbp|dirhams?)\b') AS money FROM low)
  SELECT o_orderkey, try_cast(replace(regexp_extract(money, '[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS DOUBLE) AS amount, nullif(regexp_extract(t, 'interest[^.]{{0,120}}?([0-9]{{1,3}}(?:\.[0-9]+)?) *%', 1), '')::DOUBLE AS rate,
    nullif(regexp_extract(t, '\bwithin +([0-9]{{1,3}}) +days?\b', 1), '')::BIGINT AS days FROM m""")
def amounts_and_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return sentences(spark, sf_dir).select("o_orderkey", F.get(clauses.money(t), F.lit(0))["value"].alias("amount"), F.get(clauses.rates(t), F.lit(0)).alias("rate"), clauses.deadline_days(t).cast("long").alias("days"))


@query(f"WITH {_TEXTS} SELECT o_orderkey, {', '.join(f'{_windows(cues, most)} AS {name}' for name, cues, most in _CUES)} FROM low")
def clause_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return sentences(spark, sf_dir).select("o_orderkey", F.array_join(clauses.conditions(t), "|").alias("conditions"), F.array_join(clauses.exceptions(t), "|").alias("exceptions"))


@query(f"""WITH {_TEXTS} SELECT o_orderkey, {_LAW_KIND} AS law_kind,
    CASE WHEN contains(t, 'between') AND contains(t, 'claimant') AND contains(t, 'defendant') THEN 'parties' WHEN contains(t, 'shall pay') OR contains(t, 'costs are not paid') THEN 'order' WHEN contains(t, 'schedule of reasons') THEN 'reasoning'
      WHEN regexp_matches(t, 'dismissed|granted|stayed|disposed of') THEN 'disposition' WHEN starts_with(t, 'upon ') OR contains(t, 'application') THEN 'procedural_history' ELSE 'reasoning' END AS case_kind,
    CASE WHEN starts_with(t, 'upon ') THEN 'recital_paragraph' WHEN regexp_matches(t, '(^|[^a-z])(is granted|is dismissed|is stayed|shall|must)([^a-z]|$)') THEN 'order_item' WHEN regexp_matches(t, '(^|[^a-z])reasons([^a-z]|$)') THEN 'summary_paragraph' ELSE 'other' END AS chunk_type FROM low""")
def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return sentences(spark, sf_dir).select("o_orderkey", clauses.law_section_kind(t, F.lit("")).alias("law_kind"), clauses.case_section_kind(t).alias("case_kind"), clauses.case_chunk_type(t, F.lit("")).alias("chunk_type"))


@query(rf"""WITH {_TEXTS}, k AS (SELECT t FROM low WHERE {_LAW_KIND} <> 'definition'),
  r AS (SELECT unnest([CASE WHEN regexp_matches(t, '\b(subject to|unless|except|provided that|if|only if|nothing in this law precludes)\b') THEN 'contains_negation_or_exception' END, CASE WHEN regexp_matches(t, '\b(void|invalid|unenforceable|null and void)\b') THEN 'contains_invalidity_rule' END,
      CASE WHEN regexp_matches(t, '\b(fine|penalty|liable to|punishable)\b') THEN 'contains_penalty_language' END,
      CASE WHEN regexp_matches(t, '\b(comes? into force|commences?|commencement|takes effect|effective from|notice|notified|gazette)\b') THEN 'contains_notice_commencement' END,
      CASE WHEN regexp_matches(t, '\b(shall|must|may|is required to|is entitled to|liable to)\b') THEN 'contains_normative_operational_language' END]) AS reason FROM k)
  SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def semantic_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    reasons = clauses.target_reasons(t, clauses.law_section_kind(t, F.lit("")))
    return sentences(spark, sf_dir).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(r"""WITH q AS (SELECT l_orderkey, l_linenumber, 'What must be filed under Article ' || l_linenumber || CASE WHEN l_suppkey % 2 = 0 THEN '(2)(a)' ELSE '' END || CASE l_suppkey % 3 WHEN 0 THEN ' of Law No. ' || l_suppkey || ' of 2004?' WHEN 1 THEN ' of law no ' || l_suppkey || '?' ELSE '?' END AS q FROM lineitem),
  r AS (SELECT *, regexp_extract(q, '(?i)\b(?:article|section) +([0-9]+)', 1) AS a, regexp_extract(q, '(?i)\b(?:article|section) +[0-9]+((?:\([0-9a-z]+\))*)', 1) AS p, nullif(regexp_extract(q, '(?i)\blaw +no\.? *([0-9]+)', 1), '') AS n, nullif(regexp_extract(q, '(?i)\blaw +no\.? *[0-9]+ +of +([0-9]{4})', 1), '') AS y FROM q)
  SELECT l_orderkey, l_linenumber, a AS article, nullif(replace(trim(p, '()'), ')(', '.'), '') AS subarticle, 'law_no_' || n || coalesce('_of_' || y, '') AS law_identifier,
    round(least(0.99, 0.5 + 0.2 + CASE WHEN n IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN p <> '' THEN 0.1 ELSE 0 END), 2)::DOUBLE AS confidence FROM r""")
def provision_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("l_suppkey") % 2 == 0, "(2)(a)").otherwise("")
    law = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit(" of Law No. "), F.col("l_suppkey"), F.lit(" of 2004?"))).when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit(" of law no "), F.col("l_suppkey"), F.lit("?"))).otherwise("?")
    asked = F.concat(F.lit("What must be filed under Article "), F.col("l_linenumber"), part, law)
    p = clauses.provision(asked)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(p[k].alias(k) for k in ("article", "subarticle", "law_identifier")), p["confidence"].cast("double").alias("confidence"))


@query(f"""WITH {_TEXTS}, m AS (SELECT DISTINCT o_orderstatus AS status, {_MODALITY} AS m FROM low)
  SELECT status, string_agg(m, ',' ORDER BY m) AS modalities, TRUE AS conflicting FROM m GROUP BY 1 HAVING count(*) > 1""")
def ontology_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences(spark, sf_dir).select(F.col("o_orderstatus").alias("status"), clauses.modality(F.col("text")).alias("m"))
    return conflicts(rows, ["status"], "m").select("status", F.array_join("values", ",").alias("modalities"), F.lit(True).alias("conflicting"))
