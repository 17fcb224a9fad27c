"""Propositions, courts, dates near an anchor, repaired scans and selections over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import references, repair
from ..operators import courts, propositions, selection
from .instruments import questions
from .registry import ORACLE_SQL, query, table

_STOP = "', '".join(propositions.STOPWORDS)
_TOKENS = "list_distinct(list_transform(regexp_extract_all({c}, '[A-Za-z0-9][A-Za-z0-9_.()/:-]+'), lambda x: lower(x)))"


@query(f"""WITH q AS (SELECT item_id, list_filter({_TOKENS.format(c="text")}, lambda x: NOT list_contains(['{_STOP}'], x)) AS asked, 'Article ' || item_id % 9 AS article, 'CFI ' || length(text) % 7 || '/2020' AS case_no FROM benchmark),
  a AS (SELECT conv_id, turn, {_TOKENS.format(c="role || ' ' || coalesce(text, '')")} AS held, 'article ' || turn % 9 AS c1, 'cfi ' || length(coalesce(text, '')) % 7 || '/2020' AS c2, role = 'assistant' AS eligible FROM conversations),
  pairs AS (SELECT DISTINCT b.item_id, c.conv_id FROM conversations c JOIN benchmark b ON b.item_id % 40 = c.conv_id % 40),
  s AS (SELECT item_id, conv_id, turn, len(asked) AS n, len(list_intersect(asked, held))::DOUBLE / greatest(len(asked), 1) + CASE WHEN lower(article) = c1 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN case_no = upper(c2) THEN 0.2 ELSE 0 END::DOUBLE
      + CASE WHEN eligible THEN 0.05 ELSE 0 END::DOUBLE AS score FROM pairs JOIN q USING (item_id) JOIN a USING (conv_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id, conv_id ORDER BY score DESC, turn) AS rank FROM s),
  b AS (SELECT item_id, conv_id, max(CASE WHEN rank = 1 THEN turn END) AS top_place, max(CASE WHEN rank = 1 THEN score END) AS top, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS second, any_value(n) AS n FROM r WHERE rank <= 2 GROUP BY 1, 2)
  SELECT item_id, conv_id, top_place, round(least(0.45, top * 0.45), 9) AS boost, round_even(top * n, 0)::INT AS terms_hit, round(top, 4) AS top_score, round(second, 4) AS second_score FROM b""")
def proposition_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two turns of each conversation that best answer the questions it is a candidate for."""
    items, talks = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations")
    pairs = talks.select("conv_id").distinct().join(items.select("item_id"), F.col("item_id") % 40 == F.col("conv_id") % 40).select("item_id", "conv_id")
    article = F.concat(F.lit("Article "), F.col("item_id") % 9)
    asked = items.select("item_id", "text", F.array(article).alias("article_refs"), F.array(F.concat(F.lit("CFI "), F.length("text") % 7, F.lit("/2020"))).alias("case_numbers"))
    cited = F.array(F.concat(F.lit("article "), F.col("turn") % 9), F.concat(F.lit("cfi "), F.length(F.coalesce("text", F.lit(""))) % 7, F.lit("/2020")))
    said = talks.select("conv_id", F.col("turn").alias("place"), F.concat_ws(" ", "role", "text").alias("words"), cited.alias("citations"), (F.col("role") == "assistant").alias("eligible"))
    found = propositions.match_features(pairs, asked, said, "item_id", "conv_id")
    return found.withColumn("boost", F.round("boost", 9))


#: What stands before a document's text, by its length modulo 8, as the head of a case.
HEADS = (
    "In the Court of Appeal - Orders. ", "SMALL  CLAIMS\nTRIBUNAL judgment ", "Enforcement orders of the Technology & Construction Division ", "s ct - judgments and orders ",
    "DIFC Courts: Digital Economy Court ", "Order with reasons ", "",  "court of first instance and court of appeal ",
)
PREFIXES = ("CFI", "DEC", "S CT", "XX", "tcd")


def _sql_court_rank(alias: str) -> str:
    ranked = courts.ordered_courts(courts.COURTS)
    named = lambda e: " OR ".join(f"contains({alias}, '{courts.plain(a)}')" for a in e.aliases)
    coded = lambda e: " OR ".join(f"prefix = '{p}'" for p in e.prefixes)
    return "CASE " + " ".join(f"WHEN {named(e)} OR {coded(e)} THEN '{e.key}'" for e in ranked) + " END"


@query(f"""WITH d AS (SELECT doc_id, ['{"', '".join(h.replace("'", "''") for h in HEADS)}'][length(text) % 8 + 1] || text AS context, ['{"', '".join(PREFIXES)}'][n_chars % 5 + 1] || ' ' || doc_id % 1000 || '/2020' AS number, source FROM documents),
  u AS (SELECT doc_id, source, regexp_replace(upper(trim(regexp_replace(context, '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ')), '\\bS *CT\\b', 'SCT', 'g') AS s,
      nullif(regexp_extract(regexp_replace(upper(number), '\\bS *CT\\b', 'SCT', 'g'), '\\b([A-Z]{{2,4}}) [0-9]{{1,5}}/[0-9]{{4}}\\b', 1), '') AS prefix FROM d),
  c AS (SELECT *, {_sql_court_rank("s")} AS court_key,
      CASE WHEN contains(s, '- ORDERS') OR contains(s, 'ORDERS') THEN 'orders' WHEN contains(s, 'JUDGMENTS') THEN 'judgments' WHEN contains(s, 'ORDER WITH REASONS') OR contains(s, 'REASONS FOR THE ORDER') THEN 'order_with_reasons' END AS stream_key FROM u)
  SELECT doc_id, court_key, CASE court_key WHEN 'difc_court_of_appeal' THEN 'Court of Appeal' WHEN 'difc_small_claims_tribunal' THEN 'Small Claims Tribunal' WHEN NULL THEN NULL ELSE CASE WHEN court_key IS NOT NULL THEN 'Court of First Instance' END END AS court_level,
    stream_key, prefix IS NOT NULL AS coded FROM c""")
def court_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The court and the stream of documents that the head of every text names, or its number's prefix."""
    pick = lambda words, k: F.get(F.array(*map(F.lit, words)), k.cast("int"))
    number = F.concat_ws(" ", pick(PREFIXES, F.col("n_chars") % 5), F.concat(F.col("doc_id") % 1000, F.lit("/2020")))
    docs = table(spark, sf_dir, "documents")
    cases = docs.select("doc_id", number.alias("number"), F.concat(pick(HEADS, F.length("text") % 8), "text").alias("context"), F.lit("").alias("name"), F.lit("unknown").alias("level"))
    found = courts.court_structure(cases, "number", "context", "name", "level")
    coded = F.regexp_extract(courts.source_text(F.col("number")), courts.CASE_PREFIX, 1) != ""
    level = F.when(F.col("court_key").isNotNull(), F.col("court_level"))
    return found.select("doc_id", "court_key", level.alias("court_level"), "stream_key", coded.alias("coded"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, l_quantity::INT AS q, strftime(l_shipdate, '%Y-%m-%d') AS a, strftime(l_shipdate + INTERVAL 40 DAY, '%Y-%m-%d') AS b FROM lineitem),
  t AS (SELECT *, 'Due ' || a || repeat(' x', q) || CASE l_returnflag WHEN 'A' THEN ' new account' WHEN 'R' THEN ' pre existing account' ELSE '' END || repeat(' y', l_linenumber::INT * 6) || ' then ' || b AS text FROM d),
  p AS (SELECT *, strpos(text, CASE l_returnflag WHEN 'A' THEN 'new account' ELSE 'pre existing account' END) AS at_, strpos(text, ' then ') + 6 AS second FROM t)
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_returnflag IN ('A', 'R') THEN CASE WHEN abs(second - at_) < abs(5 - at_) THEN b ELSE a END END AS day FROM p""")
def scoped_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date nearest to the kind of account that a text names, of every line item's text with two dates in different spellings."""
    kind = F.when(F.col("l_returnflag") == "A", " new account").when(F.col("l_returnflag") == "R", " pre existing account").otherwise("")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    text = F.concat(
        F.lit("Due "), day("l_shipdate"), F.repeat(F.lit(" x"), F.col("l_quantity").cast("int")), kind, F.repeat(F.lit(" y"), (F.col("l_linenumber") * 6).cast("int")),
        F.lit(" then "), day(F.date_add("l_shipdate", 40)),
    )
    asked = F.when(F.col("l_returnflag") == "A", "From when is a New Account due?").otherwise("And a pre-existing account?")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", references.scoped_date(text, asked).cast("string").alias("day"))


#: Scanned lines that are set before a document's lines, by the line's length modulo 7.
SCANNED = ("THE DU BAI INTERNATIONAL FINANCIAL CENTRE COU RTS", "ORDER W ITH REAS ONS", "CHIEF J U S TICE W AYNE M ARTIN", "OR DER OF THE COU RT", "12 0 obj /Type /Page", "A PPEAL U PON", "")
_SMALL = "abcdefghijklmnopqrstuvwxyz"
_PAIRS = [f"{a} {b}" for a, b in repair._halves(range(2, 7))]
_LETTERS = [f"{a} {b}" for a, b in repair._halves(range(1, 2))]


@query(rf"""WITH l AS (SELECT doc_id, i, ['{"', '".join(SCANNED)}'][length(x) % 7 + 1] || chr(10) || CASE WHEN length(x) % 3 = 0 THEN translate(x, '{_SMALL}', '{_SMALL.upper()}') ELSE x END AS two
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  b AS (SELECT doc_id, regexp_replace(regexp_replace(string_agg(two, chr(10) ORDER BY i), '/[A-Za-z][A-Za-z0-9_-]*', ' ', 'g'), '(?i)\b[0-9]+[\t-\r ]+[0-9]+[\t-\r ]+obj\b', ' ', 'g') AS t FROM l GROUP BY 1),
  n AS (SELECT doc_id, j, trim(regexp_replace(x, '[\x09-\x0D\x1C-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ') AS x
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS j FROM b)),
  s AS (SELECT doc_id, j, list_reduce(list_prepend(x, regexp_extract_all(x, '(?:^|[^\p{{L}}\p{{N}}_])((?:[A-Z] ){{2,}}[A-Z]{{2,6}})(?:$|[^\p{{L}}\p{{N}}_])', 1)), lambda acc, r: replace(acc, r, replace(r, ' ', ''))) AS x FROM n WHERE x <> ''),
  o AS (SELECT doc_id, j, list_reduce(list_prepend(x, ['{"', '".join(_LETTERS)}']), lambda acc, r: CASE WHEN contains(acc, r) THEN regexp_replace(acc, '(^|[^\p{{L}}\p{{N}}_])' || r || '($|[^\p{{L}}\p{{N}}_])', '\1' || replace(r, ' ', '') || '\2', 'g') ELSE acc END) AS x FROM s),
  p AS (SELECT doc_id, j, list_reduce(list_prepend(x, ['{"', '".join(_PAIRS)}']), lambda acc, r: CASE WHEN contains(acc, r) THEN regexp_replace(acc, '(^| )' || r || '( |$)', '\1' || replace(r, ' ', '') || '\2', 'g') ELSE acc END) AS x FROM o),
  k AS (SELECT *, length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) AS n, length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) AS c, lower(regexp_replace(x, '[^A-Za-z0-9]+', '', 'g')) AS key FROM p),
  h AS (SELECT *, n >= 12 AND c >= n * 0.78 AND length(key) >= 16 AS head FROM k),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key, head ORDER BY j) AS turn FROM h)
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS preview FROM f WHERE NOT head OR turn = 1 GROUP BY 1""")
def preview_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as if it had been scanned, repaired."""
    opening = lambda x: F.get(F.array(*map(F.lit, SCANNED)), F.length(x) % 7)
    scanned = F.transform(F.split("text", "\n"), lambda x: F.concat(opening(x), F.lit("\n"), F.when(F.length(x) % 3 == 0, F.translate(x, _SMALL, _SMALL.upper())).otherwise(x)))
    return table(spark, sf_dir, "documents").select("doc_id", repair.preview_text(F.array_join(scanned, "\n")).alias("preview"))


ROUTES = ("law_article_lookup", "law_relation_or_history", "law_scope_or_definition", "case_outcome_or_value", "negative_or_unanswerable", "case_entity_lookup", "law_article_lookup")
_QUESTIONS = ORACLE_SQL["compare_intents"].split("d AS (SELECT")[0].rstrip().rstrip(",")


@query(f"""{_QUESTIONS},
  r AS (SELECT question_id, q, ['{"', '".join(ROUTES)}'][o_custkey % 7 + 1] AS route, ['boolean', 'date', 'name', 'names', 'number', 'free_text'][o_custkey % 6 + 1] AS kind, floor(o_totalprice / 5000)::INT AS severity, o_orderkey % 9 = 0 AS on_case FROM q JOIN orders ON o_orderkey = question_id),
  f AS (SELECT *, CASE WHEN route = 'negative_or_unanswerable' THEN route WHEN route IN ('case_entity_lookup', 'case_outcome_or_value') OR (on_case AND route = 'law_article_lookup') THEN 'case_family'
      WHEN regexp_matches(q, 'effective date|enacted|published|consolidated version') OR route = 'law_relation_or_history' THEN 'law_relation_or_history' WHEN route = 'law_scope_or_definition' THEN route ELSE 'law_article_lookup' END AS family,
      CASE WHEN regexp_matches(q, 'effective date|enacted|published|amended|consolidated version') THEN 'history_or_version' WHEN regexp_matches(q, 'days|months|years|hours') THEN 'numeric_requirement'
        WHEN regexp_matches(q, 'earlier|higher|common|both') THEN 'compare_dimension' ELSE kind END AS theme FROM r),
  g AS (SELECT *, CASE WHEN kind IN ('number', 'boolean', 'name', 'date') THEN 0 ELSE 1 END AS typed, CASE WHEN family = 'case_family' THEN CASE WHEN route LIKE 'case%' THEN route END ELSE theme END AS grp FROM f),
  h AS (SELECT *, grp IS NOT NULL AND row_number() OVER (PARTITION BY family, grp ORDER BY severity DESC, typed, question_id) = 1 AS lead FROM g),
  i AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN NOT lead THEN 3 WHEN family = 'case_family' THEN list_position(['case_entity_lookup', 'case_outcome_or_value', 'case_cross_compare'], route) - 1 ELSE 0 END, severity DESC, typed, question_id) AS rank,
      CASE family WHEN 'law_article_lookup' THEN 8 WHEN 'law_relation_or_history' THEN 5 WHEN 'case_family' THEN 3 WHEN 'negative_or_unanswerable' THEN 4 ELSE 0 END AS quota FROM h),
  c AS (SELECT * FROM i WHERE rank <= quota OR (family = 'law_scope_or_definition' AND rank <= 25 - (SELECT count(*) FROM i WHERE rank <= quota)))
  SELECT question_id, family, theme, family = 'law_scope_or_definition' AS substitute, row_number() OVER (ORDER BY list_position(['law_article_lookup', 'law_relation_or_history', 'cross_law_compare', 'law_scope_or_definition', 'case_family',
    'negative_or_unanswerable'], family), severity DESC, typed, question_id)::INT AS place FROM c""")
def pilot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five orders as questions, by quotas of their families."""
    orders = table(spark, sf_dir, "orders").withColumn("severity", F.floor(F.col("o_totalprice") / 5000).cast("int"))
    route = F.get(F.array(*map(F.lit, ROUTES)), (F.col("o_custkey") % 7).cast("int"))
    rows = questions(spark, sf_dir).join(orders.select(F.col("o_orderkey").alias("question_id"), "severity", route.alias("route")), "question_id")
    types = F.array(F.when(F.col("question_id") % 9 == 0, "case").otherwise("law"))
    rows = rows.withColumn("family", selection.family(F.col("question"), F.col("route"), types)).withColumn("theme", selection.theme(F.col("question"), F.col("answer_type")))
    return selection.build_selection(rows, "question_id")


