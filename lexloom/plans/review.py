"""Review queries: samples, triage, contracts and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import review
from .registry import query, table


@query("""SELECT doc_id, stratum, turn FROM (SELECT doc_id, lang || '::' || source AS stratum, row_number() OVER (PARTITION BY lang || '::' || source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, stratum LIMIT 120""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), F.concat_ws("::", "lang", "source"), "doc_id", 120).select("doc_id", "stratum", "turn")


@query("""SELECT item_id, severity, rank, rank <= 20 AS worst FROM (SELECT item_id, severity, row_number() OVER (ORDER BY severity DESC, item_id) AS rank FROM (
  SELECT item_id, (length(text) > 300)::INT * 2 + regexp_matches(text, '[0-9]')::INT AS severity FROM benchmark))""")
def triage_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = (F.length("text") > 300).cast("int") * 2 + F.col("text").rlike("[0-9]").cast("int")
    rank = F.row_number().over(Window.orderBy(F.col("severity").desc(), "item_id"))  # one row per question: a small table by nature
    return table(spark, sf_dir, "benchmark").select("item_id", severity.alias("severity")).withColumn("rank", rank).withColumn("worst", F.col("rank") <= 20)


@query("""SELECT s_suppkey, s_nationkey, is_first FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1 AS is_first FROM supplier) ORDER BY is_first DESC, s_acctbal DESC, s_suppkey LIMIT 25""")
def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.diverse(table(spark, sf_dir, "supplier"), "s_nationkey", [F.col("s_acctbal").desc(), F.col("s_suppkey")], 25).select("s_suppkey", "s_nationkey", "is_first")


_RESPONSES = "responses AS (SELECT conv_id, turn, text, turn % 5 = 1 AS abstained, CASE turn % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'number' WHEN 2 THEN 'name' ELSE 'free_text' END AS answer_type FROM conversations WHERE role <> 'system')"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("boolean"), F.lit("number"), F.lit("name"), F.lit("free_text")), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "text", (F.col("turn") % 5 == 1).alias("abstained"), kind.alias("answer_type"))


@query(f"""WITH {_RESPONSES} SELECT conv_id, turn, concat_ws(',', CASE WHEN abstained AND answer_type <> 'free_text' AND text IS NOT NULL THEN 'abstain_not_null' END, CASE WHEN NOT abstained AND answer_type = 'boolean' AND lower(text) NOT IN ('yes', 'no') THEN 'not_boolean' END,
    CASE WHEN NOT abstained AND answer_type = 'number' AND NOT regexp_full_match(text, '-?[0-9.]+') THEN 'not_number' END, CASE WHEN NOT abstained AND answer_type IN ('name', 'free_text') AND trim(text) = '' THEN 'empty_text' END) AS issues FROM responses""")
def answer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = ~F.col("abstained")
    checks = [
        F.when(F.col("abstained") & (F.col("answer_type") != "free_text") & F.col("text").isNotNull(), "abstain_not_null"),
        F.when(given & (F.col("answer_type") == "boolean") & ~F.lower("text").isin("yes", "no"), "not_boolean"),
        F.when(given & (F.col("answer_type") == "number") & ~F.col("text").rlike("^-?[0-9.]+$"), "not_number"),
        F.when(given & F.col("answer_type").isin("name", "free_text") & (F.trim("text") == ""), "empty_text"),
    ]
    return responses(spark, sf_dir).select("conv_id", "turn", F.concat_ws(",", *checks).alias("issues"))


@query(f"""WITH {_RESPONSES} SELECT answer_type, count(*) AS n, count(*) FILTER (WHERE abstained) AS abstained, round(avg(abstained::INT), 4) AS abstain_rate FROM responses GROUP BY answer_type""")
def abstain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).groupBy("answer_type").agg(F.count("*").alias("n"), F.count_if("abstained").alias("abstained"), F.round(F.avg(F.col("abstained").cast("int")), 4).alias("abstain_rate"))


@query("""SELECT conv_id, count(DISTINCT role) > 1 AS roles_differ, count(*) FILTER (WHERE trim(text) = '') > 0 AS has_empty, max(turn) - min(turn) + 1 <> count(*) AS has_gap,
  CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 'blocked' WHEN count(DISTINCT role) > 1 THEN 'review' ELSE 'ready' END AS status FROM conversations GROUP BY conv_id""")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.countDistinct("role")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((roles > 1).alias("roles_differ"), (F.count_if(F.trim("text") == "") > 0).alias("has_empty"), (F.max("turn") - F.min("turn") + 1 != F.count("*")).alias("has_gap"), F.when(F.count_if(F.col("role") == "assistant") == 0, "blocked").when(roles > 1, "review").otherwise("ready").alias("status"))


@query("""WITH q AS (SELECT doc_id AS id FROM documents), t AS (SELECT doc_id AS id FROM labels)
  SELECT 'missing' AS issue, count(*) AS n FROM q WHERE id NOT IN (SELECT id FROM t) UNION ALL SELECT 'unexpected', count(*) FROM t WHERE id NOT IN (SELECT id FROM q) UNION ALL SELECT 'duplicate', count(*) FROM (SELECT id FROM t GROUP BY id HAVING count(*) > 1)""")
def taxonomy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    issue = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
    return issue("missing", q.join(t, "id", "left_anti")).union(issue("unexpected", t.join(q, "id", "left_anti"))).union(issue("duplicate", t.groupBy("id").count().where("count > 1")))


@query("""SELECT u.conv_id, u.turn, length(u.text) AS question_chars, length(a.text) AS answer_chars FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def question_answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answer_chars"))
    return rows.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("question_chars")).join(answers, ["conv_id", "turn"], "left")


@query("""SELECT quality, toxic, count(*) AS n, avg(n_chars) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"))
