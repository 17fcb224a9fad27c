"""Queries of runs, datasets and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry_rules as rules
from .registry import query, table


@query("""WITH a AS (SELECT user_id, event_id, 1 AS level FROM events WHERE event_type = 'purchase' AND value > 100), b AS (SELECT user_id, event_id, 2 AS level FROM events WHERE event_type = 'purchase' AND value > 20), c AS (SELECT user_id, event_id, 3 AS level FROM events WHERE value > 150),
  t AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), f AS (SELECT user_id, min(level) AS level FROM t GROUP BY 1) SELECT user_id, event_id, level FROM t JOIN f USING (user_id, level)""")
def fallback_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda c: e.where(c).select("user_id", "event_id")
    return rules.fallback_levels(e.select("user_id").distinct(), "user_id", [pick("event_type = 'purchase' AND value > 100"), pick("event_type = 'purchase' AND value > 20"), pick("value > 150")]).select("user_id", "event_id", "level")


@query("SELECT c_custkey, ('0x' || substr(sha1(c_custkey::VARCHAR), 1, 8))::BIGINT % 100 < 30 AS in_canary FROM customer")
def canary_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", rules.canary(F.col("c_custkey"), 30).alias("in_canary"))


@query("SELECT p_partkey, sha256(p_name || chr(31) || p_brand || chr(31) || coalesce(CASE WHEN p_size > 10 THEN p_type END, '<none>') || chr(31)) AS key FROM part")
def stage_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rules.cache_key(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_size") > 10, F.col("p_type"))).alias("key"))


@query("SELECT event_id, CASE WHEN user_id % 5 > 0 THEN greatest(0, (value - user_id) / (user_id % 5)) ELSE 0 END AS tpot FROM events")
def token_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", rules.milliseconds_per_token(F.col("value"), F.col("user_id").cast("double"), F.col("user_id") % 5).alias("tpot"))


@query("""WITH r AS (SELECT l_orderkey AS q, l_linenumber, l_quantity / 50 AS s, l_returnflag AS v, l_linestatus = 'O' AS blocked, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
  b AS (SELECT q, max(s) FILTER (WHERE r = 1) AS top, coalesce(max(s) FILTER (WHERE r = 2), 0) AS second, max(v) FILTER (WHERE r = 1) AS v, bool_or(blocked) FILTER (WHERE r = 1) AS blocked, count(DISTINCT v) FILTER (WHERE s >= 0.35) AS rivals FROM r GROUP BY 1),
  o AS (SELECT q, v, CASE WHEN top < 0.45 THEN 'weak' WHEN top - second < 0.12 THEN 'close' WHEN blocked THEN 'conditional' WHEN rivals > 1 THEN 'contradicted' ELSE 'answered' END AS outcome FROM b)
  SELECT q, CASE WHEN outcome = 'answered' THEN v END AS answer, outcome FROM o""")
def direct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50).alias("s"), F.col("l_returnflag").alias("v"), (F.col("l_linestatus") == "O").alias("blocked"))
    return rules.direct_answers(rows, "q", "s", "v", "blocked", ["l_linenumber", "l_partkey", "l_suppkey"])


@query("""WITH a AS (SELECT l_orderkey AS q, count(*) FILTER (WHERE l_returnflag <> 'N') AS given, count(DISTINCT l_returnflag) FILTER (WHERE l_returnflag <> 'N') AS different, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_linestatus = 'O') AS grounded FROM lineitem GROUP BY 1)
  SELECT q, CASE WHEN given = 0 THEN 'all_abstain' WHEN different = 1 AND given > 1 THEN 'consensus' WHEN grounded = 1 THEN 'single_grounded' ELSE 'disagreement' END AS state FROM a""")
def agreement_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_returnflag").alias("answer"), (F.col("l_returnflag") == "N").alias("abstained"), (F.col("l_linestatus") == "O").alias("grounded"))
    return rules.agreement(rows, "q", "answer", "abstained", "grounded")


@query("SELECT count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS imported, count(*) AS upserted FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en')")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.import_counts(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@query("""WITH p AS (SELECT l_orderkey AS q, list(l_linenumber - 1 ORDER BY l_partkey, l_linenumber) AS v FROM lineitem GROUP BY 1)
  SELECT q, 'page_below_one' AS issue FROM p WHERE list_min(v) < 1 UNION ALL SELECT q, 'page_repeated' FROM p WHERE len(list_distinct(v)) < len(v) UNION ALL SELECT q, 'pages_not_ascending' FROM p WHERE list_sort(v) <> v""")
def page_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") - 1).alias("page"), "l_partkey", "l_linenumber")
    return rules.page_violations(rows, "q", "page", ["l_partkey", "l_linenumber"])


@query("""WITH d AS (SELECT o_custkey AS q, o_orderpriority AS i, min(o_orderdate) AS d FROM orders GROUP BY 1, 2), a AS (SELECT q, count(*) AS n, count(d) AS known, min(d) AS lo FROM d GROUP BY 1),
  w AS (SELECT a.q, n, known, count(*) AS ties, min(i) AS i FROM a JOIN d ON d.q = a.q AND d.d = a.lo GROUP BY ALL)
  SELECT q, CASE WHEN n >= 2 AND known = n AND ties = 1 THEN i END AS answer, NOT (n >= 2 AND known = n AND ties = 1) AS abstained FROM w""")
def earlier_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderpriority").alias("i"), "o_orderdate")
    return rules.earlier_of(rows, "q", "i", "o_orderdate")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS place
  FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS o_orderdate FROM orders WHERE o_orderstatus = 'O')""")
def commencement_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as notices of their customer, which is the target; an order in ten has no date and goes first."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate")).alias("o_orderdate"))
    return rules.notices(rows, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("""SELECT bucket, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS bucket
  FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY bucket""")
def failure_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    buckets = F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "foreign")))
    return rows.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def enriched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))
