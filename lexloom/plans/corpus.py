"""Corpus queries: duplicates, versions, chains, chunks and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking, versions
from .registry import query, table


@query("""SELECT doc_id, sha256(text) AS content_hash, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.duplicate_anchor(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "content_hash", "duplicate_of")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_sequence FROM orders")
def version_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.version_sequence(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate").asc_nulls_first(), F.col("o_orderkey").asc()]).select("o_orderkey", "version_sequence")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O') DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.current_version(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "O", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH RECURSIVE link AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 17 <> 0 THEN lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS next FROM orders),
  walk AS (SELECT node, node AS tip, 0 AS steps FROM link UNION ALL SELECT w.node, l.next, w.steps + 1 FROM walk w JOIN link l ON l.node = w.tip WHERE l.next IS NOT NULL)
  SELECT node, arg_max(tip, steps) AS newest, max(steps)::BIGINT AS steps FROM walk GROUP BY node""")
def supersession_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    links = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 != 0, after).alias("next"))
    return versions.supersession(links, "o_orderkey", "next").drop("cyclic")


@query("""WITH h AS (SELECT source, length(text) AS k, sha256(text) AS h FROM documents),
  b AS (SELECT source, substr(h, 1, 4) AS bucket, count(*) AS n, sum(k) AS k, sha256(string_agg(h, '|' ORDER BY h)) AS h FROM h GROUP BY 1, 2)
  SELECT source, sum(n)::BIGINT AS n, sum(k)::BIGINT AS chars, sha256(string_agg(h, '|' ORDER BY bucket)) AS fingerprint FROM b GROUP BY source""")
def ingest_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.fingerprint(table(spark, sf_dir, "documents"), "source", "text")


_LINES = """lines AS (SELECT doc_id, u.pos AS ordinal, u.line FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u WHERE trim(u.line) <> '')"""


@query(f"""WITH {_LINES} SELECT doc_id, ordinal, length(line) AS n_chars, lag(ordinal) OVER w AS prev_ordinal, lead(ordinal) OVER w AS next_ordinal,
    max(CASE WHEN length(line) < 40 THEN ordinal END) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading_ordinal FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)""")
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.linked(chunking.lines(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", heading=F.length("chunk") < 40).select("doc_id", "ordinal", F.length("chunk").cast("long").alias("n_chars"), "prev_ordinal", "next_ordinal", "heading_ordinal")


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, count(*) AS chunks, sum(length(line)) AS chars, max(length(line)) AS longest FROM lines GROUP BY doc_id)
  SELECT lang, count(*) AS documents, sum(chunks)::BIGINT AS chunks, sum(chars)::BIGINT AS chars, max(longest) AS longest FROM c JOIN documents USING (doc_id) GROUP BY lang""")
def structural_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    per = chunking.lines(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.max(F.length("chunk")).alias("longest"))
    return per.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"), F.max("longest").alias("longest"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\n{2,}') AS parts FROM documents)),
  c(doc_id, place, step, chunk, rest) AS (
    SELECT doc_id, place, 0, '', trim(regexp_replace(part, '[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+', ' ', 'g')) FROM p
    UNION ALL
    SELECT doc_id, place, step + 1, trim(left(rest, k)), trim(substr(rest, k + 1)) FROM (
      SELECT *, CASE WHEN length(rest) > 900 AND back > 0 AND 900 - back >= 200 THEN 900 - back ELSE 900 END AS k FROM (
        SELECT *, strpos(reverse(left(rest, 900)), ' ') AS back FROM c WHERE rest <> '')))
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place, step) - 1)::INT AS ordinal, chunk FROM c WHERE chunk <> ''""")
def sized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sized(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT l_orderkey AS document_id, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS pages, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def pages_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return used.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("pages"), F.countDistinct("l_linenumber").alias("n"))


@query("""SELECT p_brand AS key, count(*) AS usage, array_to_string(list_sort(list(p_partkey ORDER BY p_partkey))[1:12], ',') AS samples FROM part GROUP BY p_brand""")
def registry_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= 12, F.col("p_partkey"))))
    return ranked.groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("usage"), F.array_join(first, ",").alias("samples"))


@query("""SELECT p_name AS subject, p_type AS relation, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS objects FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) > 1""")
def conflict_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.review import conflicts

    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("subject"), F.col("p_type").alias("relation"), "p_brand")
    return conflicts(rows, ["subject", "relation"], "p_brand").select("subject", "relation", F.array_join("values", ",").alias("objects"))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, upper(c_name), c_acctbal + 1 FROM customer WHERE c_custkey % 5 = 0""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 5 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return versions.merge_by_key(old, new, ["c_custkey"])


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.075)")
def missing_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_tax > 0.075").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return table(spark, sf_dir, "supplier").join(done, "s_suppkey", "left_anti").select("s_suppkey", "s_nationkey")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 50")
def scoped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(50)


@query("SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE n_chars < 80) AS short FROM documents GROUP BY lang")
def processing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 80).alias("short"))
