"""Versioned tables, payload checks and document updates over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas
from ..operators.versions import shared_folder
from ..sources.versioned import VersionedTable, activated
from .registry import query, table


@query("""WITH v AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderstatus = 'O' AS active FROM orders),
  w AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS chosen FROM v WHERE price > 300000 GROUP BY 1, 2)
  SELECT o_orderkey, round(price, 2) AS price, CASE WHEN chosen IS NULL THEN active ELSE o_orderkey = chosen END AS active FROM v LEFT JOIN w USING (o_custkey, o_orderpriority)""")
def activated_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a versioned table, the closed ones replaced by key, and then the dearest of each customer and priority made the active ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "O").alias("active"), "o_orderstatus")
    kept = VersionedTable(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}")
    kept.commit(orders, 0, "load")
    kept.upsert(orders.where("o_orderstatus = 'F'").withColumn("price", F.col("price") + 1), ["o_orderkey"], "closed")
    latest = kept.read()
    found = activated(latest, ["o_custkey", "o_orderpriority"], "o_orderkey", "active", latest.where("price > 300000").select("o_orderkey"))
    return found.select("o_orderkey", F.round("price", 2).alias("price"), "active")


#: What an event's payload must look like.
EVENT = {
    "type": "object",
    "required": ["id", "type", "props"],
    "properties": {
        "id": {"type": "integer"},
        "type": {"enum": ["view", "click", "purchase"]},
        "source": {"const": "web"},
        "day": {"type": ["string", "null"], "format": "date"},
        "value": {"type": "number"},
        "props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}},
        "tags": {"type": "array", "items": {"type": "string"}},
    },
}


def payloads() -> Column:
    """An event as JSON; its own values decide which fields are of a wrong type, missing or out of range."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    n, user, cents = F.col("event_id"), F.col("user_id"), F.col("value") * 100 % 10
    fields = [
        F.concat(F.lit('"id": '), F.when(user % 5 == 0, quoted(n.cast("string"))).when(user % 11 == 0, "2.5").otherwise(n.cast("string"))),
        F.when(user % 7 > 0, F.concat(F.lit('"type": '), quoted("event_type"))),
        F.concat(F.lit('"source": '), F.when(user % 3 == 0, '"app"').otherwise('"web"')),
        F.concat(F.lit('"day": '), F.when(user % 4 == 0, "null").when(user % 4 == 1, quoted(F.date_format("ts", "yyyy-MM-dd"))).when(user % 4 == 2, '"2024-02-30"').otherwise("7")),
        F.concat(F.lit('"value": '), F.when(cents < 2, "true").otherwise(F.format_string("%.2f", "value"))),
        F.when(user % 13 > 0, F.concat(F.lit('"props": '), F.when(user % 6 == 0, "{}").when(user % 6 == 1, '{"k": "x"}').otherwise(F.col("props")))),
        F.concat(F.lit('"tags": '), F.when(user % 8 == 0, '["a", 1, "b", null]').when(user % 8 == 1, '"a"').otherwise("[]")),
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


@query("""WITH j AS (SELECT event_id, ('{' || concat_ws(', ',
      '"id": ' || CASE WHEN user_id % 5 = 0 THEN '"' || event_id || '"' WHEN user_id % 11 = 0 THEN '2.5' ELSE event_id::VARCHAR END,
      CASE WHEN user_id % 7 > 0 THEN '"type": "' || event_type || '"' END, '"source": ' || CASE WHEN user_id % 3 = 0 THEN '"app"' ELSE '"web"' END,
      '"day": ' || CASE user_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"' || strftime(ts, '%Y-%m-%d') || '"' WHEN 2 THEN '"2024-02-30"' ELSE '7' END,
      '"value": ' || CASE WHEN value * 100 % 10 < 2 THEN 'true' ELSE printf('%.2f', value) END,
      CASE WHEN user_id % 13 > 0 THEN '"props": ' || CASE user_id % 6 WHEN 0 THEN '{}' WHEN 1 THEN '{"k": "x"}' ELSE props END END,
      '"tags": ' || CASE user_id % 8 WHEN 0 THEN '["a", 1, "b", null]' WHEN 1 THEN '"a"' ELSE '[]' END) || '}')::JSON AS j FROM events),
  t AS (SELECT *, json_type(j, '$.id') AS id_type, j->>'$.type' AS type, j->>'$.source' AS source, json_type(j, '$.day') AS day_type, j->>'$.day' AS day, json_type(j, '$.value') AS value_type, json_type(j, '$.props') AS props_type,
      json_type(j, '$.props.k') AS k_type, json_type(j, '$.tags') AS tags_type FROM j),
  e AS (SELECT event_id, list_filter([CASE WHEN id_type IS NULL THEN '$: required id' END, CASE WHEN type IS NULL THEN '$: required type' END, CASE WHEN props_type IS NULL THEN '$: required props' END,
      CASE WHEN id_type NOT IN ('BIGINT', 'UBIGINT') THEN '$.id: type' END, CASE WHEN type NOT IN ('view', 'click', 'purchase') THEN '$.type: enum' END, CASE WHEN source <> 'web' THEN '$.source: const' END,
      CASE WHEN day_type NOT IN ('VARCHAR', 'NULL') THEN '$.day: type' WHEN day_type = 'VARCHAR' AND try_strptime(day, '%Y-%m-%d') IS NULL THEN '$.day: format' END,
      CASE WHEN value_type NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN '$.value: type' END, CASE WHEN props_type = 'OBJECT' AND k_type IS NULL THEN '$.props: required k' END,
      CASE WHEN k_type NOT IN ('BIGINT', 'UBIGINT') THEN '$.props.k: type' END, CASE WHEN tags_type <> 'ARRAY' THEN '$.tags: type' END,
      CASE WHEN json_array_length(j, '$.tags') = 4 THEN '$.tags[1]: type' END, CASE WHEN json_array_length(j, '$.tags') = 4 THEN '$.tags[3]: type' END], lambda x: x IS NOT NULL) AS found FROM t)
  SELECT event_id, array_to_string(found, '; ') AS errors, len(found)::INT AS n FROM e""")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every event's payload breaks of its schema."""
    rows = table(spark, sf_dir, "events").select("event_id", schemas.variant(payloads()).alias("payload"))
    found = rows.select("event_id", schemas.errors(EVENT, F.col("payload")).alias("errors"))
    return found.select("event_id", F.array_join("errors", "; ").alias("errors"), F.size("errors").alias("n"))


@query("""WITH u AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'regulation' WHEN toxic = 1 THEN 'poem' END AS doc_type, CASE WHEN quality = 1 THEN 1990 + doc_id % 30 END AS year, CASE WHEN toxic = 0 THEN 'Title ' || doc_id ELSE ' ' END AS title FROM labels)
  SELECT d.doc_id, CASE WHEN u.doc_type = 'regulation' THEN 'regulation' ELSE d.lang END AS doc_type, coalesce(nullif(trim(u.title), ''), d.source) AS title, coalesce(u.year, d.n_chars)::INT AS year,
    CASE WHEN u.doc_id IS NULL THEN '{"parse":{"n":' || d.n_chars || ',"ok":true},"status":"new"}' ELSE '{"model":"m","parse":{"llm":' || d.doc_id || ',"n":' || d.n_chars || ',"ok":false},"status":"done"}' END AS processing
  FROM documents d LEFT JOIN u USING (doc_id)""")
def updated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a model's answers, which come as JSON: columns replaced where the answer says something, the processing record merged in depth."""
    labels = table(spark, sf_dir, "labels")
    kind = F.when(F.col("quality") == 1, " Regulation ").when(F.col("toxic") == 1, "poem")
    year = F.when(F.col("quality") == 1, (F.col("doc_id") % 30 + 1990).cast("string"))
    title = F.when(F.col("toxic") == 0, F.concat(F.lit("Title "), "doc_id")).otherwise(" ")
    answer = F.to_json(F.struct(kind.alias("doc_type"), year.alias("year"), title.alias("title")))
    status = F.to_json(F.struct(F.lit("done").alias("status"), F.lit("m").alias("model"), F.struct(F.lit(False).alias("ok"), F.col("doc_id").alias("llm")).alias("parse")))
    updates = labels.select("doc_id", schemas.variant(answer).alias("answer"), schemas.variant(status).alias("status"))
    own = F.to_json(F.struct(F.lit("new").alias("status"), F.struct(F.col("n_chars").alias("n"), F.lit(True).alias("ok")).alias("parse")))
    docs = table(spark, sf_dir, "documents").withColumn("own", schemas.variant(own)).join(updates, "doc_id", "left")
    columns = {"doc_type": F.col("lang"), "title": F.col("source"), "year": F.col("n_chars").cast("int")}
    new = schemas.updated(F.col("answer"), columns, ("law", "regulation", "enactment_notice", "case", "other"))
    return docs.select("doc_id", *(c.alias(k) for k, c in new.items()), schemas.merged(F.col("own"), F.col("status"), ("parse",)).alias("processing"))
