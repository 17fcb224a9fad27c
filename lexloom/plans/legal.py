"""Legal texts made from the lines of `documents`, and their structural chunks.

A text's type follows its language; headings and markers are set before a line by the line's own length, so that what the rules find depends on
every line. The SQL makes the same texts and finds the chunks by patterns without look-around, with its own windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.structure import structural_chunks
from .registry import query, table

TYPES = {"en": "law", "es": "regulation", "fr": "case"}
#: Before a line of a law, by the line's length modulo 7.
OPENINGS = {0: "PART {n}: Scope and duties ", 1: "CHAPTER {n} ", 2: "SECTION {n}: General rules (first) ", 3: "SCHEDULE {n}: Fees "}
CAPTION = ("IN THE COURT Claim No: CFI ", "/2020 BETWEEN ", " Claimant ORDER WITH REASONS UPON ", " IT IS HEREBY ORDERED THAT: ")


def text_type() -> Column:
    """The type of a document by its language."""
    return F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in TYPES.items()), F.lit("memo"))


def legal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, type, text)."""
    lines = F.split("text", "\n")
    number = lambda i: (i + 1).cast("string")

    def opening(line: Column, i: Column) -> Column:
        out = None
        for rest, words in OPENINGS.items():
            head, tail = words.split("{n}")
            hit = F.length(line) % 7 == rest
            out = (F.when(hit, F.concat(F.lit(head), number(i), F.lit(tail))) if out is None else out.when(hit, F.concat(F.lit(head), number(i), F.lit(tail))))
        return out.otherwise("")

    law = F.array_join(F.transform(lines, lambda x, i: F.concat(opening(x, i), number(i), F.lit(". "), x)), " ")
    reasons = lambda x, i: F.when((F.length(x) % 4 == 3) & (i > 0), "SCHEDULE OF REASONS ").otherwise("")
    items = F.array_join(F.transform(lines, lambda x, i: F.concat(reasons(x, i), number(i), F.lit(". "), x)), " ")
    first = F.get(lines, F.lit(0))
    caption = F.concat(F.lit(CAPTION[0]), "doc_id", F.lit(CAPTION[1]), first, F.lit(CAPTION[2]), first, F.lit(CAPTION[3]))
    case = F.concat(F.when(F.length("text") % 3 > 0, caption).otherwise(""), items)
    text = F.when(F.col("lang").isin("en", "es"), law).when(F.col("lang") == "fr", case).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text_type().alias("type"), text.alias("text"))


_TEXTS = """
    lines AS (SELECT doc_id, lang, text, string_split(text, chr(10)) AS ls FROM documents),
    law_line AS (SELECT doc_id, i, CASE length(l) % 7 WHEN 0 THEN 'PART ' || i || ': Scope and duties ' WHEN 1 THEN 'CHAPTER ' || i || ' '
        WHEN 2 THEN 'SECTION ' || i || ': General rules (first) ' WHEN 3 THEN 'SCHEDULE ' || i || ': Fees ' ELSE '' END || i || '. ' || l AS l
      FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM lines WHERE lang IN ('en', 'es'))),
    case_line AS (SELECT doc_id, i, CASE WHEN length(l) % 4 = 3 AND i > 1 THEN 'SCHEDULE OF REASONS ' ELSE '' END || i || '. ' || l AS l
      FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM lines WHERE lang = 'fr')),
    made AS (
      SELECT d.doc_id, CASE d.lang WHEN 'en' THEN 'law' WHEN 'es' THEN 'regulation' ELSE 'case' END AS type,
        CASE WHEN d.lang = 'fr' AND length(any_value(d.text)) % 3 > 0 THEN 'IN THE COURT Claim No: CFI ' || d.doc_id || '/2020 BETWEEN ' || any_value(d.ls)[1]
          || ' Claimant ORDER WITH REASONS UPON ' || any_value(d.ls)[1] || ' IT IS HEREBY ORDERED THAT: ' ELSE '' END || string_agg(x.l, ' ' ORDER BY x.i) AS text
      FROM lines d JOIN (SELECT * FROM law_line UNION ALL SELECT * FROM case_line) x USING (doc_id) GROUP BY d.doc_id, d.lang
      UNION ALL SELECT doc_id, 'memo', text FROM documents WHERE lang NOT IN ('en', 'es', 'fr')),
    flat AS (SELECT doc_id, type, trim(regexp_replace(coalesce(text, ''), '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\p{Z}]+', ' ', 'g'), ' ') AS t FROM made)
"""

_REF = r"(?:\d{1,3}|[IVXLCMivxlcm]{1,8}|[A-Za-z])"
_AHEAD = r"\d{1,3}\. [A-Za-z]|ARTICLE \d{1,3}"
_HEADS = [("part", 1, "heading", ["CHAPTER", "SECTION", "SCHEDULE"]), ("chapter", 2, "heading", ["SECTION", "SCHEDULE"]), ("section", 3, "heading", ["SCHEDULE"]), ("schedule", 2, "schedule_item", [])]


def _law_sql() -> str:
    heads = []
    for kind, level, section, after in _HEADS:
        ahead = "|".join([_AHEAD, *(f"{w} {_REF}" for w in after)])
        pattern = rf"(?i)\b({kind.upper()} {_REF}(?:: ?[A-Z][A-Za-z0-9 ,&()''/-]{{2,120}}?)?)( (?:{ahead}))"
        heads.append(f"""SELECT doc_id, '{kind}' AS kind, {level} AS level, '{section}' AS section, pos, string_split(p, chr(9))[1] AS head,
          coalesce(sum(length(p) - CASE WHEN pos > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
          FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (
            SELECT doc_id, string_split(regexp_replace(t, '{pattern}', chr(10) || '\\1' || chr(9) || '\\2', 'g'), chr(10)) AS ps FROM flat WHERE type IN ('law', 'regulation')))""")
    opened = ", ".join(
        f"(SELECT max_by({{'x': h.head, 'k': h.local_key}}, h.off) FROM heads h WHERE h.doc_id = a.doc_id AND h.kind = '{k}' AND h.off <= a.off) AS o_{k}" for k, *_ in _HEADS
    )
    ref = lambda k: f"nullif(regexp_extract(o_{k}.x, '(?i){k} +([A-Z0-9]+)', 1), '')"
    return rf"""
    heads AS (SELECT *, section || ':' || trim(regexp_replace(lower(string_split(head, ':')[1]), '[^a-z0-9]+', '_', 'g'), '_') AS local_key
      FROM ({" UNION ALL ".join(heads)}) WHERE pos > 1),
    cuts AS (SELECT doc_id, pos, trim(p, ' ') AS c, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (
        SELECT doc_id, string_split(regexp_replace(t, '(^|[^\p{{L}}\p{{N}}_(.])(\d{{1,3}}\. [A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS ps FROM flat WHERE type IN ('law', 'regulation')))),
    titled AS (SELECT *, regexp_extract(c, '^(\d+)\. ', 1) AS number,
        nullif(left(trim(regexp_replace(regexp_replace(c, '^\d+\. +', ''), '(?s)(?: +\(\d+\) +| +An? +[A-Z][a-z]+ shall\b| +The +[A-Z][a-z]+ +is\b).*$', ''), ' .;:'), 120), '') AS title FROM cuts WHERE pos > 1),
    arts AS (SELECT a.*, {opened} FROM titled a),
    law_rows AS (
      SELECT doc_id, 'heading' AS chunk_type, section AS section_kind, NULL::VARCHAR AS section_kind_case, level, off, head AS chunk, local_key, NULL::VARCHAR AS parent_key, NULL::VARCHAR AS part_ref,
        NULL::VARCHAR AS chapter_ref, NULL::VARCHAR AS section_ref, NULL::VARCHAR AS schedule_number, NULL::VARCHAR AS article_number, NULL::VARCHAR AS article_title, head AS path FROM heads
      UNION ALL SELECT doc_id, 'paragraph',
        CASE WHEN contains(lower(c), 'means') OR contains(lower(coalesce(title, '')), 'definition') THEN 'definition' WHEN regexp_matches(lower(c), 'unless|except|provided that') THEN 'exception'
          WHEN regexp_matches(lower(c), 'fine|penalty|liable to') THEN 'penalty' WHEN regexp_matches(lower(c), 'apply|file|submit|procedure') THEN 'procedure'
          WHEN contains(lower(coalesce(title, '')), 'schedule') THEN 'schedule_item' ELSE 'operative_provision' END,
        NULL, CASE WHEN coalesce(o_part.k, o_chapter.k, o_section.k, o_schedule.k) IS NULL THEN 1 ELSE 2 END, off, c, 'article:' || number, coalesce(o_section.k, o_chapter.k, o_part.k, o_schedule.k),
        {ref("part")}, {ref("chapter")}, {ref("section")}, {ref("schedule")}, number, title,
        concat_ws(' > ', o_part.x, o_chapter.x, o_section.x, o_schedule.x, concat_ws(' ', 'Article ' || number, title)) FROM arts)"""


_CASE_KIND = """CASE WHEN contains({t}, 'between') AND contains({t}, 'claimant') AND contains({t}, 'defendant') THEN 'parties'
      WHEN regexp_matches({t}, 'is hereby ordered|shall pay|interest will accrue|interest shall accrue|costs are not paid') THEN 'order'
      WHEN regexp_matches({t}, 'schedule of reasons|^1\\. |for these reasons') THEN 'reasoning' WHEN regexp_matches({t}, 'dismissed|granted|stayed|disposed of') THEN 'disposition'
      WHEN regexp_matches({t}, '^upon |application') THEN 'procedural_history' ELSE {default} END"""


def _case_sql() -> str:
    kind = lambda t, default="'reasoning'": _CASE_KIND.format(t=f"lower({t})", default=default)
    upto = lambda p: f"CASE WHEN regexp_matches(t, '{p}') THEN length(regexp_extract(t, '(?s)^(.*?){p}', 1)) END"
    number, heading, marker, why = (
        r"(?i:\b(?:Claim|Case|Appeal) No[:.]? ?)", r"(?i:\b(?:ORDER WITH REASONS|JUDGMENT|ORDER)\b)", r"(?i:\bIT IS HEREBY ORDERED THAT[: ])", r"(?i:\bSCHEDULE OF REASONS\b)"
    )
    item = r"(^|[^\p{L}\p{N}_])(\d{1,3}\. )"
    return rf"""
    ca AS (SELECT doc_id, t, regexp_matches(left(t, 450), '{number}') OR regexp_matches(' ' || upper(left(t, 450)) || ' ', ' BETWEEN | IN THE ') AS cap FROM flat WHERE type = 'case' AND t <> ''),
    cb AS (SELECT *, CASE WHEN cap THEN {upto(heading)} END AS h_at, regexp_extract(t, '{heading}') AS h, CASE WHEN cap THEN {upto(number)} END AS n_at, {upto(marker)} AS m_at,
      length(regexp_extract(t, '{marker}')) AS m_len, {upto(why)} AS r_at, regexp_extract(t, '{why}') AS r FROM ca),
    cc AS (SELECT *, coalesce(h_at + length(h), 0) AS body, least(n_at, h_at) AS cap_end, coalesce(r_at, length(t)) AS stop, m_at + m_len AS m_end, r_at + length(r) AS r_end FROM cb),
    cd AS (SELECT *, left(t, stop) AS opening, t[m_end + 1:stop] AS orders, t[r_end + 1:] AS reasons, t[body + 1:m_at] AS between_ FROM cc),
    ce AS (SELECT *, {kind("opening")} AS opening_kind, NOT cap AND regexp_matches(t, '^\d+\. ') AND regexp_matches(t, '^\d{{1,3}}\. ') AS continued FROM cd),
    regions AS (
      SELECT doc_id, 'continued' AS kind, 0 AS base, opening AS region, CASE WHEN opening_kind IN ('order', 'disposition') THEN 'case:continuation_order' ELSE 'case:continuation_reasoning' END AS parent_key,
        opening_kind AS own, 'Continuation' AS path FROM ce WHERE continued
      UNION ALL SELECT doc_id, 'ordered', m_end, orders, 'case:operative_order', 'order', 'IT IS HEREBY ORDERED THAT' FROM ce WHERE m_at IS NOT NULL
      UNION ALL SELECT doc_id, 'reasoned', r_end, reasons, 'case:reasons_heading', NULL, r FROM ce WHERE r_at IS NOT NULL),
    items AS (SELECT doc_id, kind, parent_key, own, path, base + coalesce(sum(length(p)) OVER (PARTITION BY doc_id, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, trim(p, ' ') AS c, pos
      FROM (SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (SELECT *, string_split(regexp_replace(region, '{item}', '\1' || chr(10) || '\2', 'g'), chr(10)) AS ps FROM regions))),
    case_items AS (SELECT *, CASE kind WHEN 'ordered' THEN 'order' WHEN 'continued' THEN {kind("c", "own")} ELSE {kind("c")} END AS inner_kind FROM items WHERE pos > 1 AND c <> ''),
    case_rows AS (
      SELECT doc_id, 'list_item' AS chunk_type, CASE kind WHEN 'ordered' THEN 'order' WHEN 'continued' THEN CASE inner_kind WHEN 'order' THEN 'order' ELSE 'reasoning' END
          ELSE CASE inner_kind WHEN 'disposition' THEN 'disposition' ELSE 'reasoning' END END AS section_kind,
        inner_kind AS section_kind_case, 2 AS level, off, c AS chunk, NULL::VARCHAR AS local_key, parent_key, path || ' > ' || left(c, 80) AS path FROM case_items
      UNION ALL SELECT doc_id, 'heading', 'parties', 'parties', 1, 0, trim(left(t, cap_end), ' '), 'case:caption', NULL, left(trim(left(t, cap_end), ' '), 120) FROM ce WHERE cap_end > 20
      UNION ALL SELECT doc_id, 'heading', CASE opening_kind WHEN 'order' THEN 'order' ELSE 'reasoning' END, opening_kind, 1, 0, 'Continuation',
        CASE WHEN opening_kind IN ('order', 'disposition') THEN 'case:continuation_order' ELSE 'case:continuation_reasoning' END, NULL, 'Continuation' FROM ce SEMI JOIN (SELECT * FROM case_items WHERE kind = 'continued') USING (doc_id)
      UNION ALL SELECT doc_id, 'heading', 'order', 'order', 1, h_at, h, 'case:order_heading', NULL, h FROM ce WHERE h_at IS NOT NULL
      UNION ALL SELECT doc_id, 'paragraph', 'procedural_history', 'procedural_history', 2, body + length(between_) - length(ltrim(between_, ' ')), trim(between_, ' '), NULL,
        CASE WHEN h_at IS NOT NULL THEN 'case:order_heading' END, 'Order context' FROM ce WHERE m_at >= body AND trim(between_, ' ') <> ''
      UNION ALL SELECT doc_id, 'heading', 'order', 'order', 1, m_at, 'IT IS HEREBY ORDERED THAT', 'case:operative_order', CASE WHEN h_at IS NOT NULL THEN 'case:order_heading' END, 'IT IS HEREBY ORDERED THAT'
        FROM ce SEMI JOIN (SELECT * FROM case_items WHERE kind = 'ordered') USING (doc_id)
      UNION ALL SELECT doc_id, 'heading', 'reasoning', 'reasoning', 1, r_at, r, 'case:reasons_heading', NULL, r FROM ce WHERE r_at IS NOT NULL)"""


# texts without an article, an order or a caption are cut by size: the rest of the text is carried through a recursion
_SIZED = r"""
    sized AS (
      SELECT doc_id, type, 0 AS off, t, CASE WHEN length(t) <= 900 THEN length(t) WHEN length(left(t, 900)) - length(regexp_extract(left(t, 900), '[^ ]*$')) - 1 >= 200
        THEN length(left(t, 900)) - length(regexp_extract(left(t, 900), '[^ ]*$')) - 1 ELSE 900 END AS cut
      FROM (SELECT doc_id, type, t FROM flat WHERE t <> '' AND (type = 'memo' OR doc_id NOT IN (SELECT doc_id FROM cuts WHERE pos > 1 UNION ALL SELECT doc_id FROM case_rows)))
      UNION ALL
      SELECT doc_id, type, off + cut + length(t[cut + 1:]) - length(ltrim(t[cut + 1:], ' ')), n, CASE WHEN length(n) <= 900 THEN length(n)
        WHEN length(left(n, 900)) - length(regexp_extract(left(n, 900), '[^ ]*$')) - 1 >= 200 THEN length(left(n, 900)) - length(regexp_extract(left(n, 900), '[^ ]*$')) - 1 ELSE 900 END
      FROM (SELECT *, ltrim(t[cut + 1:], ' ') AS n FROM sized) WHERE n <> '')"""


@query(f"""WITH RECURSIVE {_TEXTS}, {_law_sql()}, {_case_sql()}, {_SIZED}, every AS (
    SELECT doc_id, chunk_type, section_kind, section_kind_case, level, off, chunk, local_key, parent_key, part_ref, chapter_ref, section_ref, schedule_number, article_number, article_title, path FROM law_rows
    UNION ALL SELECT doc_id, chunk_type, section_kind, section_kind_case, level, off, chunk, local_key, parent_key, NULL, NULL, NULL, NULL, NULL, NULL, path FROM case_rows
    UNION ALL SELECT doc_id, 'paragraph', CASE type WHEN 'memo' THEN 'heading' WHEN 'case' THEN 'reasoning' ELSE 'operative_provision' END, NULL, 1, off, trim(left(t, cut), ' '), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '' FROM sized),
  placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY off, level, chunk_type <> 'heading', off + length(chunk), chunk) - 1 AS ordinal FROM every)
  SELECT p.doc_id, p.ordinal, p.chunk_type, p.section_kind, p.section_kind_case, p.level::INT AS structural_level, p.off::INT AS char_start, (p.off + length(p.chunk))::INT AS char_end, p.local_key, p.parent_key,
    (SELECT max(q.ordinal) FROM placed q WHERE q.doc_id = p.doc_id AND q.local_key = p.parent_key) AS parent_ordinal, p.part_ref, p.chapter_ref, p.section_ref, p.schedule_number, p.article_number, p.article_title,
    p.path AS heading_path, p.chunk FROM placed p""")
def legal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural chunks of every legal text."""
    rows = structural_chunks(legal_texts(spark, sf_dir), "doc_id", "text", "type")
    return rows.drop("prev_ordinal", "next_ordinal", "paragraph_class", "schedule_title").withColumn("heading_path", F.array_join("heading_path", " > "))
