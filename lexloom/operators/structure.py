"""Structural chunks: laws cut at parts, chapters, sections, schedules and articles; cases at captions, orders and reasons; other texts by size.

A text is cut where a pattern matches: a line break is set before each match (white space was collapsed before, so none is left) and the text is split
there. The pieces' lengths, summed along the text, are the offsets. Pieces of all kinds are exploded once and dealt by text; headings that are open at an
article are then carried along by window functions.

Null and blank texts have no chunks. Repeated keys are cut as texts of their own only if `key` tells them apart. Offsets count characters of the text
with white space collapsed (`flat`). White space is what Unicode says, and the separators 0x1C to 0x1F.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clauses
from ..functions.text import collapsed

# --- fixed values: types of texts, patterns of headings and markers, levels and names of chunks ---------------------------------------
LAWS, CASES = ("law", "regulation", "enactment_notice"), ("case",)
NUMBER = r"(?:\d{1,3}|[IVXLCM]{1,8}|[A-Z])"
ARTICLE_AHEAD, TITLE = r"\d{1,3}\. [A-Z]|ARTICLE \d{1,3}", r"(?:: ?[A-Z][A-Za-z0-9 ,&()'/-]{2,120}?)?"
#: kind: (word, level, section kind, headings that may follow)
HEADINGS = {
    "part": ("PART", 1, "heading", ("CHAPTER", "SECTION", "SCHEDULE")),
    "chapter": ("CHAPTER", 2, "heading", ("SECTION", "SCHEDULE")),
    "section": ("SECTION", 3, "heading", ("SCHEDULE",)),
    "schedule": ("SCHEDULE", 2, "schedule_item", ()),
}
# a pattern's first sign is looked for before what lies around it, which costs more at every place of a text
ARTICLE = r"(?=\d)(?<![\p{L}\p{N}_(.])\d{1,3}\. [A-Z]"
TITLE_END = r" +\(\d+\) +| +An? +[A-Z][a-z]+ shall\b| +The +[A-Z][a-z]+ +is\b"
ITEM = r"(?=\d)(?<!Article )(?<!Part )(?<!Schedule )(?<![\p{L}\p{N}_])\d{1,3}\. "
CASE_NUMBER = r"(?i)\b(?:Claim|Case|Appeal) No[:.]? ?"
ORDER_HEADING = r"(?i)\b(?:ORDER WITH REASONS|JUDGMENT|ORDER)\b"
ORDER_MARKER = r"(?i)\bIT IS HEREBY ORDERED THAT[: ]"
REASONS = r"(?i)\bSCHEDULE OF REASONS\b"
MARKER_TEXT, MARKER_KEY = "IT IS HEREBY ORDERED THAT", "case:operative_order"
LEADING, SHORTEST_CAPTION, PATH, CAPTION_PATH, TITLE_CHARS = 450, 20, 80, 120, 120
# ---------------------------------------------------------------------------------------------------------------------------------------

_PIECE = "array<struct<kind: string, place: int, length: int, text: string, shown: boolean, at: int, key: string, parent: string>>"


def heading_pattern(kind: str) -> str:
    word, _, _, after = HEADINGS[kind]
    ahead = "|".join([ARTICLE_AHEAD, *(f"{w} {NUMBER}" for w in after)])
    return rf"(?i)(?={word[:2]})\b({word} {NUMBER}{TITLE})(?= (?:{ahead}))"


def lineage_key(text: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", "root").otherwise(slug)


def _piece(kind: str, place: Column, length: Column, text: Column, shown: Column, at: Column, key: Column | None = None, parent: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    fields = {"kind": F.lit(kind), "place": place.cast("int"), "length": length.cast("int"), "text": text, "shown": shown, "at": at.cast("int")}
    return F.struct(*(c.alias(n) for n, c in fields.items()), (none if key is None else key).alias("key"), (none if parent is None else parent).alias("parent"))


def _cut_before(text: Column, pattern: str, kind: str, at: Column, parent: Column | None = None) -> Column:
    """The pieces that begin at each match and end before the next; what lies before the first match is not shown."""
    parts = F.split(F.regexp_replace(text, pattern, "\n$0"), "\n")
    return F.transform(parts, lambda x, i: _piece(kind, i, F.length(x), F.trim(x), (i > 0) & (F.trim(x) != ""), at, None, parent))


def _headings(text: Column, kind: str) -> Column:
    """The headings of a kind; a tab marks where a heading ends and what follows it begins."""
    parts = F.split(F.regexp_replace(text, heading_pattern(kind), "\n$1\t"), "\n")
    own = lambda x: F.substring_index(x, "\t", 1)
    name = HEADINGS[kind][2]
    key = lambda x: F.concat(F.lit(f"{name}:"), lineage_key(F.substring_index(own(x), ":", 1)))
    return F.transform(parts, lambda x, i: _piece(kind, i, F.length(x) - F.when(i > 0, 1).otherwise(0), F.when(i > 0, F.trim(own(x))), i > 0, F.lit(0), F.when(i > 0, key(x))))


def _sized(text: Column, kind: str = "sized", most: int = 900, least: int = 200) -> Column:
    """Pieces of at most `most` characters, cut at the last space that leaves `least`, else hard."""
    found = F.regexp_extract_all(text, F.lit(rf" ?(?:.{{1,{most}}}$|.{{{least},{most - 1}}}(?= )|.{{{most}}})"), F.lit(0))
    return F.transform(found, lambda x, i: _piece(kind, i, F.length(x), x, F.trim(x) != "", F.lit(0)))


def _upto(text: Column, pattern: str) -> Column:
    """Characters before the first match; null without one."""
    return F.when(text.rlike(pattern), F.length(F.get(F.split(text, pattern, 2), F.lit(0))))


def _from(text: Column, start: Column, end: Column | None = None) -> Column:
    return F.substring(text, start + 1, F.greatest(F.lit(0), (F.length(text) if end is None else end) - start))


def _case_pieces(docs: DataFrame, key: str) -> DataFrame:
    """Adds `pieces` of a case: caption, order heading, recital, marker, reasons, and the numbered items of each region."""
    t, none, c = F.col("flat"), F.lit(None).cast("string"), F.col
    lead = F.concat(F.lit(" "), F.upper(F.substring(t, 1, LEADING)), F.lit(" "))
    # one projection after the other, so that no pattern is looked for twice
    for layer in (
        {"captioned": F.substring(t, 1, LEADING).rlike(CASE_NUMBER) | lead.contains(" BETWEEN ") | lead.contains(" IN THE ")},
        {
            "heading_at": F.when(c("captioned"), _upto(t, ORDER_HEADING)),
            "number_at": F.when(c("captioned"), _upto(t, CASE_NUMBER)),
            "marker_at": _upto(t, ORDER_MARKER),
            "reasons_at": _upto(t, REASONS),
            "heading": F.regexp_extract(t, ORDER_HEADING, 0),
            "marker": F.regexp_extract(t, ORDER_MARKER, 0),
            "reasons": F.regexp_extract(t, REASONS, 0),
        },
        {
            "caption": F.trim(_from(t, F.lit(0), F.least("heading_at", "number_at"))),
            "caption_end": F.least("heading_at", "number_at"),
            "body": F.coalesce(c("heading_at") + F.length("heading"), F.lit(0)),
            "marker_end": c("marker_at") + F.length("marker"),
            "reasons_end": c("reasons_at") + F.length("reasons"),
            "stop": F.coalesce("reasons_at", F.length(t)),
            "ordered": F.when(c("heading_at").isNotNull(), "case:order_heading"),
            "continued": ~c("captioned") & t.rlike(r"^\d{1,3}\. "),
        },
        {
            "between": _from(t, c("body"), c("marker_at")),
            "orders": _from(t, c("marker_end"), c("stop")),
            "why": F.when(c("reasons_at").isNotNull(), _from(t, c("reasons_end"))),
            "opening": F.when(c("continued"), _from(t, F.lit(0), c("stop"))),
        },
        {"opening_kind": clauses.case_section_kind(c("opening"))},
        {
            "opening_key": F.when(c("opening_kind").isin("order", "disposition"), "case:continuation_order").otherwise("case:continuation_reasoning"),
            "opening_items": c("opening").rlike(ITEM),
            "order_items": c("orders").rlike(ITEM),
        },
    ):
        docs = docs.withColumns(layer)

    def one(kind: str, when: Column, at: Column, text: Column, key: Column = none, parent: Column = none) -> Column:
        return F.array(_piece(kind, F.lit(0), F.length(text), text, F.coalesce(when & (text != ""), F.lit(False)), at, key, parent))

    def some(kind: str, when: Column, region: str, at: Column, parent: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), _cut_before(c(region), ITEM, kind, at, parent)).otherwise(F.array().cast(_PIECE))

    recital_at = c("body") + F.length("between") - F.length(F.ltrim("between"))
    found = F.concat(
        one("caption", c("caption_end") > SHORTEST_CAPTION, F.lit(0), c("caption"), F.lit("case:caption")),
        one("continuation", c("opening_items"), F.lit(0), F.lit("Continuation"), c("opening_key")),
        some("continued", c("opening_items"), "opening", F.lit(0), c("opening_key")),
        one("order_heading", c("heading_at").isNotNull(), c("heading_at"), c("heading"), F.lit("case:order_heading")),
        one("recital", c("marker_at") >= c("body"), recital_at, F.trim("between"), none, c("ordered")),
        one("marker", c("order_items"), c("marker_at"), F.lit(MARKER_TEXT), F.lit(MARKER_KEY), c("ordered")),
        some("ordered", c("order_items"), "orders", c("marker_end"), F.lit(MARKER_KEY)),
        one("reasons", c("reasons_at").isNotNull(), c("reasons_at"), c("reasons"), F.lit("case:reasons_heading")),
        some("reasoned", c("why").rlike(ITEM), "why", c("reasons_end"), F.lit("case:reasons_heading")),
    )
    docs = docs.select(c(key), "flat", "opening_kind", found.alias("found"))
    return docs.withColumn("pieces", F.when(F.exists("found", lambda x: x["shown"]), c("found")).otherwise(_sized(t, "sized_case")))


#: What a case's pieces become: chunk type, level, section kind, kind within the case, first part of the path (null: by rule, see below).
CASE_KINDS = {
    "caption": ("heading", 1, "parties", "parties", None),
    "continuation": ("heading", 1, None, None, None),
    "continued": ("list_item", 2, None, None, "Continuation"),
    "order_heading": ("heading", 1, "order", "order", None),
    "recital": ("paragraph", 2, "procedural_history", "procedural_history", "Order context"),
    "marker": ("heading", 1, "order", "order", None),
    "ordered": ("list_item", 2, "order", "order", MARKER_TEXT),
    "reasons": ("heading", 1, "reasoning", "reasoning", None),
    "reasoned": ("list_item", 2, None, None, None),
}

COLUMNS = (
    "ordinal chunk_type section_kind section_kind_case paragraph_class structural_level char_start char_end local_key parent_key parent_ordinal "
    "prev_ordinal next_ordinal part_ref chapter_ref section_ref schedule_number article_number article_title schedule_title heading_path chunk"
).split()


def _placed(docs: DataFrame, key: str) -> DataFrame:
    """A row for each shown piece, with its offsets."""
    keep = [c for c in ("opening_kind",) if c in docs.columns]
    # outer: an inner explode would repeat all that makes the pieces as a filter below it; rows without a piece fall to "shown"
    rows = docs.select(key, *keep, F.explode_outer("pieces").alias("piece")).select(key, *keep, "piece.*").repartition(key)
    before = F.sum("length").over(Window.partitionBy(key, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("char_start", F.col("at") + F.coalesce(before, F.lit(0))).where("shown")
    led = F.col("text").startswith(" ")  # a sized piece may begin with the space that it was cut at
    rows = rows.withColumn("char_start", (F.col("char_start") + F.when(led, 1).otherwise(0)).cast("int")).withColumn("text", F.trim("text"))
    return rows.withColumn("char_end", F.col("char_start") + F.length("text"))


def _law_rows(docs: DataFrame, key: str) -> DataFrame:
    t = F.col("flat")
    kinds = list(HEADINGS)
    body = F.when(t.rlike(ARTICLE), _cut_before(t, ARTICLE, "article", F.lit(0))).otherwise(_sized(t, "sized"))
    rows = _placed(docs.withColumn("pieces", F.concat(*(_headings(t, k) for k in kinds), body)), key)
    # the last heading of each kind that begins at or before a piece
    open_until = Window.partitionBy(key).orderBy("char_start").rangeBetween(Window.unboundedPreceding, 0)
    is_article = F.col("kind") == "article"
    for k in kinds:
        own = F.last(F.when(F.col("kind") == k, F.struct("text", "key")), ignorenulls=True).over(open_until)
        rows = rows.withColumn(f"open_{k}", F.when(is_article, own))
    number = F.regexp_extract("text", r"^(\d{1,3})\. ", 1)
    rest = F.regexp_replace("text", r"^\d{1,3}\. +", "")
    title = F.btrim(F.get(F.split(rest, TITLE_END, 2), F.lit(0)), F.lit(" .;:"))
    title = F.nullif(F.substring(title, 1, TITLE_CHARS), F.lit(""))
    rows = rows.withColumn("article_number", F.when(is_article, number)).withColumn("article_title", F.when(is_article, title))
    ref = lambda k: F.nullif(F.regexp_extract(F.col(f"open_{k}.text"), rf"(?i){HEADINGS[k][0]} +([A-Z0-9]+)", 1), F.lit(""))
    parent = F.coalesce(*(F.col(f"open_{k}.key") for k in ("section", "chapter", "part", "schedule")))
    label = F.concat_ws(" ", F.concat(F.lit("Article "), "article_number"), "article_title")
    path = F.array_compact(F.array(*(F.col(f"open_{k}.text") for k in kinds), label))
    by_kind = lambda value: F.coalesce(*(F.when(F.col("kind") == k, F.lit(value(k))) for k in kinds))
    is_heading = F.col("kind").isin(kinds)
    return rows.select(
        key,
        F.when(is_heading, "heading").otherwise("paragraph").alias("chunk_type"),
        F.when(is_article, clauses.law_section_kind(F.col("text"), F.col("article_title"))).otherwise(F.coalesce(by_kind(lambda k: HEADINGS[k][2]), F.lit("operative_provision"))).alias("section_kind"),
        F.lit(None).cast("string").alias("section_kind_case"),
        F.when(is_heading, "heading").when(is_article, "article_clause").otherwise("body").alias("paragraph_class"),
        F.when(is_article, F.when(parent.isNotNull(), 2).otherwise(1)).otherwise(F.coalesce(by_kind(lambda k: HEADINGS[k][1]), F.lit(1))).alias("structural_level"),
        "char_start",
        "char_end",
        F.when(is_article, F.concat(F.lit("article:"), "article_number")).otherwise(F.col("key")).alias("local_key"),
        F.when(is_article, parent).alias("parent_key"),
        *(ref(k).alias(n) for k, n in zip(kinds, ("part_ref", "chapter_ref", "section_ref", "schedule_number"), strict=True)),
        "article_number",
        "article_title",
        F.col("open_schedule.text").alias("schedule_title"),
        F.when(is_heading, F.array("text")).when(is_article, path).otherwise(F.array().cast("array<string>")).alias("heading_path"),
        F.col("text").alias("chunk"),
    )


def _case_rows(docs: DataFrame, key: str) -> DataFrame:
    rows = _placed(_case_pieces(docs, key), key)
    is_ = lambda *k: F.col("kind").isin(*k)
    table = lambda i: F.coalesce(*(F.when(F.col("kind") == k, F.lit(v[i])) for k, v in CASE_KINDS.items() if v[i] is not None))
    within = F.when(is_("continuation"), F.col("opening_kind")).when(is_("continued"), clauses.case_section_kind(F.col("text"), F.col("opening_kind")))
    within = F.coalesce(within.when(is_("reasoned"), clauses.case_section_kind(F.col("text"))), table(3))
    kind = F.when(is_("continuation", "continued"), F.when(within == "order", "order").otherwise("reasoning"))
    kind = F.coalesce(kind.when(is_("reasoned"), F.when(within == "disposition", "disposition").otherwise("reasoning")), table(2), F.lit("reasoning"))
    begun = F.when(is_("reasoned"), F.max(F.when(is_("reasons"), F.col("text"))).over(Window.partitionBy(key))).otherwise(table(4))
    item = F.substring("text", 1, PATH)
    path = F.when(is_("continued", "ordered", "reasoned"), F.array(begun, item)).when(is_("recital"), F.array(begun))
    path = path.when(is_("caption"), F.array(F.substring("text", 1, CAPTION_PATH))).when(is_("sized_case"), F.array().cast("array<string>"))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    return rows.select(
        key,
        F.coalesce(table(0), F.lit("paragraph")).alias("chunk_type"),
        kind.alias("section_kind"),
        within.alias("section_kind_case"),
        F.lit("case_excerpt").alias("paragraph_class"),
        F.coalesce(table(1), F.lit(1)).alias("structural_level"),
        "char_start",
        "char_end",
        F.col("key").alias("local_key"),
        F.col("parent").alias("parent_key"),
        *none("part_ref", "chapter_ref", "section_ref", "schedule_number", "article_number", "article_title", "schedule_title"),
        path.otherwise(F.array("text")).alias("heading_path"),
        F.col("text").alias("chunk"),
    )


def _other_rows(docs: DataFrame, key: str) -> DataFrame:
    rows = _placed(docs.withColumn("pieces", _sized(F.col("flat"))), key)
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    fixed = [F.lit("paragraph").alias("chunk_type"), F.lit("heading").alias("section_kind"), *none("section_kind_case"), F.lit("body").alias("paragraph_class"), F.lit(1).alias("structural_level")]
    rest = none("local_key", "parent_key", "part_ref", "chapter_ref", "section_ref", "schedule_number", "article_number", "article_title", "schedule_title")
    return rows.select(key, *fixed, "char_start", "char_end", *rest, F.array().cast("array<string>").alias("heading_path"), F.col("text").alias("chunk"))


def structural_chunks(docs: DataFrame, key: str, text: str, kind: str, rest: bool = False) -> DataFrame:
    """(key, COLUMNS): every text's chunks in the order of their offsets, a heading before what begins with it.

    `kind` is the column of the text's type: laws, cases, and anything else (also null). A chunk's parent is the last chunk with the parent's key, as
    a heading that comes twice keeps its key. With `rest`, stretches that no chunk covers come too, as type "rest" without an ordinal, so that
    all chunks together hold the whole text.
    """
    typed = F.lower(F.trim(F.coalesce(F.col(kind), F.lit(""))))
    # blank texts fall away by having no piece: a filter on `flat` would make every text twice
    flat = docs.select(F.col(key), collapsed(F.col(text)).alias("flat"), typed.alias("type"))
    of = lambda types: F.col("type").isin(*types)
    rows = _law_rows(flat.where(of(LAWS)), key).unionByName(_case_rows(flat.where(of(CASES)), key)).unionByName(_other_rows(flat.where(~of(LAWS + CASES)), key))
    order = Window.partitionBy(key).orderBy("char_start", "structural_level", F.col("chunk_type") != "heading", "char_end", "chunk")
    rows = rows.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    rows = rows.withColumn("prev_ordinal", F.lag("ordinal").over(order)).withColumn("next_ordinal", F.lead("ordinal").over(order))
    # the parent's ordinal: rows meet under the key that one has and the other asks for, where the text's rows are already; a join with the rows
    # themselves would make all of them twice. Only the marker of orders has both a parent and rows below it
    link = Window.partitionBy(key, F.coalesce("parent_key", "local_key"))
    top = F.max(F.when(F.col("parent_key").isNull(), F.col("ordinal"))).over(link)
    marker = F.max(F.when(F.col("local_key") == MARKER_KEY, F.col("ordinal"))).over(Window.partitionBy(key))
    rows = rows.withColumn("marker", marker).withColumn("top", top)
    asks = F.col("parent_key").isNotNull() & F.col(key).isNotNull()
    out = rows.withColumn("parent_ordinal", F.when(asks, F.when(F.col("parent_key") == MARKER_KEY, F.col("marker")).otherwise(F.col("top")))).select(key, *COLUMNS)
    if not rest:
        return out
    spans = rows.select(key, "char_start", "char_end").unionByName(flat.select(key, F.length("flat").alias("char_start"), F.length("flat").alias("char_end")))
    upto = F.coalesce(F.max("char_end").over(Window.partitionBy(key).orderBy("char_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = spans.withColumn("from", upto).where("from < char_start").select(key, F.col("from"), F.col("char_start").alias("to"))
    kinds = dict(out.dtypes)
    found = gaps.join(flat.select(key, "flat"), key).withColumn("chunk", _from(F.col("flat"), F.col("from"), F.col("to"))).where(F.trim("chunk") != "")
    made = {"chunk_type": F.lit("rest"), "char_start": F.col("from"), "char_end": F.col("to"), "chunk": F.col("chunk")}
    return out.unionByName(found.select(key, *(made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS)))
