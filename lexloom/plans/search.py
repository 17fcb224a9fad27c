"""Retrieval queries: benchmark items as questions, documents as the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from .registry import query, table

_SCORES = """
    tok AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> '')) AS token FROM benchmark),
    cnt AS (SELECT item_id, token, count(*) AS k FROM tok GROUP BY ALL),
    tot AS (SELECT item_id, sum(k) AS n FROM cnt GROUP BY ALL),
    hit AS (SELECT v.token, d.doc_id FROM (SELECT DISTINCT token FROM cnt) v JOIN documents d ON contains(lower(d.text), v.token) WHERE {where}),
    score AS (SELECT c.item_id, h.doc_id, least(1.0, sum(c.k) / any_value(t.n))::DOUBLE AS score FROM hit h JOIN cnt c USING (token) JOIN tot t USING (item_id) GROUP BY ALL)
"""


def _best(spark: SparkSession, sf_dir: str, docs: DataFrame, k: int, boost: float = 0.0) -> DataFrame:
    return search.lexical_best(table(spark, sf_dir, "benchmark"), docs, "item_id", "text", "doc_id", "text", k, boost)


@query(f"WITH {_SCORES.format(where='TRUE')} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score QUALIFY rank <= 5")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_best(spark, sf_dir, table(spark, sf_dir, "documents"), 5), ["item_id"], [F.col("score").desc(), F.col("doc_id").asc()], 5)


@query(f"WITH {_SCORES.format(where=chr(39).join(['d.lang = ', 'en', ' AND d.source IN (', 'src1', ',', 'src2', ',', 'src3', ')']))} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score QUALIFY rank <= 3")
def lexical_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = search.in_scope(search.matching(table(spark, sf_dir, "documents"), {"lang": "en", "source": None}), "source", ["src1", "src2", "src3"])
    return search.top_k(_best(spark, sf_dir, docs, 3), ["item_id"], [F.col("score").desc(), F.col("doc_id").asc()], 3)


@query(f"""WITH {_SCORES.format(where="TRUE")}, boosted AS (
    SELECT s.*, least(1.0, score + CASE WHEN lang = 'en' THEN 0.06 ELSE 0.02 END) AS boosted, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS stage
    FROM score s JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr'))
  SELECT item_id, doc_id, boosted, stage, row_number() OVER (PARTITION BY item_id ORDER BY boosted DESC, stage, doc_id) AS rank FROM boosted QUALIFY rank <= 5""")
def union_passes_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    boosts = {"en": 0.06, "fr": 0.02}
    passes = [_best(spark, sf_dir, docs.where(F.col("lang") == lang), 5, boost) for lang, boost in boosts.items()]
    best = search.union_of_passes(passes, list(boosts.values()), ["item_id", "doc_id"])
    return search.top_k(best, ["item_id"], [F.col("boosted").desc(), F.col("stage").asc(), F.col("doc_id").asc()], 5).select("item_id", "doc_id", "boosted", "stage", "rank")


@query("""SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, length(t) AS n_chars, md5(t) AS text_md5 FROM (
    SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM pages)""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.visible_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("text_md5"))


@query("""WITH m AS (SELECT item_id, doc_id, rank FROM (
    WITH {s} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 3)
  SELECT lang, count(*) AS n, count(DISTINCT item_id) AS items, min(rank) AS best_rank FROM m JOIN documents USING (doc_id) GROUP BY lang""".replace("{s}", _SCORES.format(where="TRUE")))
def retrieval_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lexical_topk(spark, sf_dir).where("rank <= 3")
    return top.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"), F.min("rank").alias("best_rank"))


@query("""SELECT doc_id, token_count, word_count, CASE WHEN token_count = 0 THEN 0 ELSE word_count / token_count END AS alpha_ratio, CASE WHEN token_count = 0 THEN 0 ELSE slash / token_count END AS slash_ratio,
    CASE WHEN len(long) = 0 THEN 0 ELSE len(list_distinct(list_transform(long, lambda w: lower(w)))) / len(long) END AS diversity FROM (
    SELECT doc_id, len(tokens) AS token_count, len(words) AS word_count, len(list_filter(tokens, lambda t: starts_with(t, '/'))) AS slash, list_filter(words, lambda w: length(w) >= 3) AS long FROM (
      SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda t: t <> '') AS tokens, regexp_extract_all(text, '[A-Za-z\\x{410}-\\x{44F}][A-Za-z\\x{410}-\\x{44F}''-]+') AS words FROM documents))""")
def text_quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in text.quality_features(F.col("text")).items()))


@query("""SELECT item_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, text ILIKE '%the%' AS has_article, regexp_matches(text, '[0-9]') AS has_number, length(text) > 300 AS is_long FROM (
    SELECT item_id, text, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS t FROM benchmark)""")
def question_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.query_tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.lower("text").contains("the").alias("has_article"), F.col("text").rlike("[0-9]").alias("has_number"), (F.length("text") > 300).alias("is_long"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_size), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug,
    regexp_extract(p_brand, '[0-9]+')::DOUBLE AS number FROM part""")
def instrument_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")).alias("slug"), text.number_token(F.col("p_brand")).alias("number"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') END AS slash FROM orders""")
def date_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    day = lambda c: F.date_format(text.iso_date(c), "yyyy-MM-dd")
    return rows.select("o_orderkey", day(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("iso"), day(F.date_format("o_orderdate", "d/M/yyyy")).alias("slash"))


_W = r"[\p{L}\p{N}_]"
_N = r"[^\p{L}\p{N}_]"
_MARKERS = " + ".join(
    f"regexp_matches(low, '(^|{_N}){word}')::BIGINT"
    for word in [rf"case[ \t\r\n]+no({_N}|$)", rf"art(icle({_N}|$)|\.{_W})", *(f"{w}({_N}|$)" for w in "court judgment order claimant defendant law regulation section tribunal enforcement".split())]
)


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS t FROM documents),
  k AS (SELECT doc_id, t, lower(t) AS low, list_filter(string_split_regex(t, '[ \t\r\n]+'), lambda x: x <> '') AS tokens, regexp_extract_all(t, '[A-Za-z\x{{410}}-\x{{44F}}][A-Za-z\x{{410}}-\x{{44F}}''-]+') AS words,
    len(list_filter(string_split_regex(t, '{_N}+'), lambda x: regexp_full_match(x, '[A-Za-z]'))) AS singles FROM t),
  f AS (SELECT doc_id, t, len(tokens) AS n, len(words) AS w, greatest(len(tokens), 1) AS d, len(list_filter(tokens, lambda x: starts_with(x, '/'))) AS slashes, singles,
    list_transform(list_filter(words, lambda x: length(x) >= 3), lambda x: lower(x)) AS long,
    len(regexp_extract_all(t, '/(Type|Catalog|Pages|Font|Filter|FlateDecode|XObject|Subtype|Length|ColorSpace|DeviceRGB)({_N}|$)')) AS pdf, {_MARKERS} AS legal,
    (length(t) - length(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))) / greatest(length(t), 1) AS control,
    len(list_filter(list_distinct(string_split(t, '')), lambda c: c <> '' AND c <> chr(10) AND contains(t, repeat(c, 11)))) > 0 AS repeated FROM k),
  g AS (SELECT *, w / d AS alpha, slashes / d AS slash, CASE WHEN len(long) = 0 THEN 0 ELSE len(list_distinct(long)) / len(long) END AS diversity FROM f),
  s AS (SELECT *, CASE WHEN n < 20 THEN 0 ELSE greatest(0, least(1, 0.30 * alpha + 0.20 * least(1, greatest(0, (diversity - 0.08) / 0.25)) + 0.25 * least(1, legal / 4) + 0.15 * least(1, n / 900)
      + 0.10 * greatest(0, least(1, 1 - singles / d / 0.35)) - least(0.85, 1.8 * slash + 8 * control + pdf / 40 + CASE WHEN repeated THEN 0.2 ELSE 0 END))) END AS score FROM g)
  SELECT doc_id, legal AS legal_hits, pdf AS pdf_operator_hits, singles / d AS single_letter_ratio, repeated AS repeated_chars, round(score, 9) AS score,
    length(t) < 80 OR n < 40 OR w < 25 OR repeated OR (pdf >= 8 AND legal < 1) OR (alpha < 0.22 AND slash > 0.08) OR score < 0.58 AS low_quality FROM s""")
def text_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, with its noise features."""
    found = table(spark, sf_dir, "documents").select("doc_id", text.quality(F.col("text")).alias("q")).select("doc_id", "q.*")
    return found.withColumn("score", F.round("score", 9))
