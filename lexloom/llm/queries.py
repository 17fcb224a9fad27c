"""The queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, html_blocks, jaccard_join, lattice_dedup, line_dedup, mpegts, packing, pii, rule_ensemble, sentencepiece_codec, token_counts, toxicity, windowed_search
from .common import rest_bucket, table
from .tokens import vocabulary_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", rest_bucket() != 0)
    return toxicity.score(docs, model).select("doc_id", (rest_bucket() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), listed.alias("removed"), "text_deduped")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"), "quality", rest_bucket() != 0)
    scored = rule_ensemble.statistics(docs).withColumn("score", model.score())
    return scored.select("doc_id", (rest_bucket() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op6_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.link(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.train(pii.labelled(spark)))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.digests(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_windowed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_search.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"), html_blocks.train(html_blocks.labelled(spark)))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_lattice_dedup": op6_lattice_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_pii_crf": op8_pii_crf,
    "op9_media_columns": op9_media_columns,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_windowed_search": op11_windowed_search,
    "op12_html_blocks": op12_html_blocks,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH cut AS (
          SELECT doc_id, u.line, u.pos
          FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u
        ), lines AS (
          SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
            string_split(regexp_replace(line, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS parts
          FROM cut
        ), sentences AS (
          SELECT doc_id, pos, len(parts) AS n, start AS line_start, line, s.part, s.k,
            (start + coalesce(sum(length(s.part) + 1) OVER (PARTITION BY doc_id, pos ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
          FROM lines, LATERAL (SELECT unnest(parts) AS part, generate_subscripts(parts, 1) AS k) s
        ), place AS (
          SELECT doc_id, pos, 0 AS k, start, line AS unit FROM lines
          UNION ALL SELECT doc_id, pos, k, start, part FROM sentences WHERE n > 1
        ), norm AS (
          SELECT *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS norm FROM place
        ), ranked AS (
          SELECT *, len(string_split(norm, ' ')) >= 8 AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS gone FROM norm
        ), whole AS (
          SELECT doc_id, pos, start, unit, gone FROM ranked WHERE k = 0
        ), inner_parts AS (
          SELECT r.doc_id, r.pos, count(*) FILTER (r.gone) AS n_gone, string_agg(r.unit, ' ' ORDER BY r.k) FILTER (NOT r.gone) AS kept,
            string_agg(r.start || ':' || (r.start + length(r.unit)), ',' ORDER BY r.k) FILTER (r.gone) AS spans
          FROM ranked r WHERE k > 0 GROUP BY ALL
        ), per_line AS (
          SELECT w.doc_id, w.pos, CASE WHEN w.gone THEN 1 ELSE coalesce(i.n_gone, 0) END AS n_gone,
            CASE WHEN w.gone THEN w.start || ':' || (w.start + length(w.unit)) ELSE i.spans END AS spans,
            CASE WHEN w.gone THEN NULL WHEN i.doc_id IS NULL THEN w.unit ELSE i.kept END AS kept
          FROM whole w LEFT JOIN inner_parts i USING (doc_id, pos)
        )
        SELECT doc_id, sum(n_gone)::BIGINT AS n_removed, coalesce(string_agg(spans, ',' ORDER BY pos), '') AS removed, coalesce(string_agg(kept, chr(10) ORDER BY pos), '') AS text_deduped
        FROM per_line GROUP BY doc_id
    """,
    "op11_windowed_search": r"""
        WITH words AS (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM documents
        ), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
        ), size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL
        ), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size
        ), norm AS (SELECT doc_id, 100 - 50 + (50 * n * n_docs) // n_terms AS m FROM size, total
        ), weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term
        ), asked AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark
        ), scored AS (
          SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
          FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 50
    """,
}
