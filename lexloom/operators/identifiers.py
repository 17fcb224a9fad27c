"""Which chunks carry the identifiers that a question names: an index of (kind, value) on both sides, met by equality.

Flags are bits, one for each of KINDS; the pairs of all kinds are united by `bit_or`. Kinds that nearly every chunk shares (`weak`) make no
pairs of their own: they are looked up for the pairs that another kind has made.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed
from .best import Trie, best, flat
from .joins import spread_join
from .search import holding

# --- fixed values: kinds of identifiers in the order of their flags, edges and kinds of the derived features ---------------------------
KINDS = ("article", "section", "paragraph", "clause", "part", "schedule", "law_number", "law_year", "law_title", "doc_type", "case_number")
LINEAGE_EDGES = ("amends", "amended_by", "repeals", "restates", "supersedes")
ARTICLE_KINDS = ("article", "section", "paragraph", "clause", "schedule")
MENTION = r"(?i)\barticle\s+([0-9A-Za-z_]+)"
# ---------------------------------------------------------------------------------------------------------------------------------------

BIT = {kind: 1 << k for k, kind in enumerate(KINDS)}
WEAK = ("law_year", "doc_type")


def normal(value: Column, kind: str) -> Column:
    flat = collapsed(value)
    return F.upper(flat) if kind == "case_number" else F.lower(flat)


def gathered(values: dict[str, Column]) -> Column:
    """An array of (kind, value) of arrays of values by kind; blank values fall away, each is there once."""
    clean = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), normal(x, kind).alias("value")))
    every = F.flatten(F.array(*(F.coalesce(clean(k, c), F.array().cast("array<struct<kind: string, value: string>>")) for k, c in values.items())))
    return F.array_distinct(F.filter(every, lambda x: x["value"] != ""))


def listed(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """(key, kind, value) of arrays of values by kind; blank values fall away, each is listed once."""
    return rows.select(key, F.explode(gathered(values)).alias("x")).select(key, "x.kind", "x.value")


def chunk_values(article_number: Column, article_refs: Column, text: Column, heading_path: Column, own: dict[str, Column]) -> dict[str, Column]:
    """Values by kind of a chunk. `own` has the single values of the other kinds; articles are also those that the text mentions.

    A paragraph or clause may be written as an article; a chunk without a part takes the head of its heading path.
    """
    articles = F.array_compact(F.concat(F.array(article_number), F.coalesce(article_refs, F.array().cast("array<string>"))))
    one = lambda k: F.array_compact(F.array(own[k])) if k in own else F.array().cast("array<string>")
    part = F.coalesce(F.nullif(collapsed(own["part"]), F.lit("")) if "part" in own else F.lit(None).cast("string"), F.get(heading_path, F.lit(0)))
    out = {k: one(k) for k in KINDS}
    out["article"] = F.concat(articles, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MENTION), 1))
    out["paragraph"], out["clause"] = F.concat(one("paragraph"), articles), F.concat(one("clause"), articles)
    out["part"] = F.array_compact(F.array(part))
    return out


def matches(asked: DataFrame, held: DataFrame, question: str, chunk: str, weak: tuple[str, ...] = WEAK, salts: int = 16) -> DataFrame:
    """(question, chunk, flags) of every pair that shares an identifier of a kind that is not weak.

    asked: (question, kind, value), held: (chunk, kind, value), both from `listed`. A title counts where the chunk's title holds the question's:
    titles meet by their first characters, then chunks by equality of titles. Null keys match like any other.
    """
    bit = F.element_at(F.create_map(*(F.lit(x) for pair in BIT.items() for x in pair)), F.col("kind"))
    strong = [k for k in KINDS if k not in weak and k != "law_title"]
    met = spread_join(held.where(F.col("kind").isin(strong)), asked.where(F.col("kind").isin(strong)), ["kind", "value"], salts)
    pairs = met.select(question, chunk, bit.alias("bit"))
    if "law_title" not in weak:
        titles, wanted = (x.where("kind = 'law_title'") for x in (held, asked))
        found = holding(titles.select(F.col("value").alias("chunk")).distinct(), wanted.select(F.col("value").alias("token")).distinct())
        found = found.select(F.col("chunk").alias("__title"), F.col("token").alias("__asked"))
        sought = wanted.select(question, F.col("value").alias("__asked")).join(found, "__asked").select(question, F.col("__title").alias("value")).distinct()
        pairs = pairs.unionByName(spread_join(titles.select(chunk, "value"), sought, ["value"], salts).select(question, chunk, F.lit(BIT["law_title"]).alias("bit")))
    flags = pairs.groupBy(question, chunk).agg(F.bit_or("bit").alias("flags"))
    if not weak:
        return flags
    packed = lambda rows, key: rows.where(F.col("kind").isin(*weak)).groupBy(key).agg(F.collect_set(F.struct("kind", "value")).alias(f"__{key}"))
    # a row of the packed tables holds the few weak identifiers of one question or chunk
    both = flags.join(packed(held, chunk), chunk, "left").join(packed(asked, question), question, "left")
    shared = F.transform(F.array_intersect(f"__{chunk}", f"__{question}"), lambda x: x["kind"])
    more = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.array_contains(shared, k), BIT[k]).otherwise(0) for k in weak))
    return both.select(question, chunk, F.col("flags").bitwiseOR(F.coalesce(more, F.lit(0))).alias("flags"))


def best_matches(asked: DataFrame, held: DataFrame, question: str, chunk: str, values: str, k: int, weak: tuple[str, ...] = WEAK) -> DataFrame:
    """Those (question, chunk, flags) of `matches` that hold every question's k chunks with most flags, then by chunk; no pair of the others becomes a row.

    Both sides have `values` as arrays from `gathered`. A pair's flags are found kind by kind in a block's matrix; chunks are unique, titles are not weak.
    """
    strong = sum(BIT[x] for x in KINDS if x not in weak)

    def prepare(lists: pa.ListArray) -> tuple:
        words, word, row = flat(lists)
        counts = np.zeros((len(words), len(lists)), dtype=np.float32)
        counts[word, row] = 1
        kind, value = zip(*(w.split(":", 1) for w in words), strict=True) if words else ((), ())
        of = {x: np.flatnonzero(np.array(kind) == x) for x in dict.fromkeys(kind)}
        return {w: i for i, w in enumerate(words)}, counts, of, Trie([value[i] for i in of.get("law_title", ())])

    def measure(state: tuple, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        number, counts, of, titles = state
        words, word, row = flat(lists)
        own = np.zeros((len(words), len(number)), dtype=np.float32)  # the asked values that each distinct value stands for
        titled = [i for i, w in enumerate(words) if w.startswith("law_title:")]
        if titled and "law_title" in of:
            own[np.ix_(titled, of["law_title"])] = titles.held([words[i].split(":", 1)[1] for i in titled])
        for i, w in enumerate(words):
            if w in number and not w.startswith("law_title:"):
                own[i, number[w]] = 1
        have = np.zeros((len(lists), len(words)), dtype=np.float32)
        have[row, word] = 1
        have = have @ own
        flags = np.zeros((len(lists), counts.shape[1]), dtype=np.int64)
        for x, at in of.items():
            flags |= np.where(have[:, at] @ counts[at] > 0, BIT[x], 0)
        return np.where(flags & strong, np.bitwise_count(flags).astype(np.float64), -1.0), flags

    words = F.transform(values, lambda x: F.concat(x["kind"], F.lit(":"), x["value"])).alias("words")
    return best(held.select(chunk, words), asked.select(question, words), chunk, question, "words", "words", k, prepare, measure, "flags long").withColumn("flags", F.col("flags").cast("int"))


def flag(kind: str, flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(BIT[kind]) != 0


def features(route: Column, current: Column, relation: Column, edges: Column, flags: str = "flags") -> dict[str, Column]:
    """What a ranking asks of a pair: any identifier, an article question on its article, the current version, a sign of lineage."""
    lineage = (route == "history_lineage") | (F.coalesce(relation, F.lit("")) != "") | F.arrays_overlap(edges, F.array(*map(F.lit, LINEAGE_EDGES)))
    return {
        "exact_identifier_hit": F.col(flags) != 0,
        "law_article_intent_aligned": F.coalesce(route == "article_lookup", F.lit(False)) & reduce(lambda a, b: a | b, (flag(k, flags) for k in ARTICLE_KINDS)),
        "current_version_hit": F.coalesce(current, F.lit(False)),
        "lineage_signal": F.coalesce(lineage, F.lit(False)),
    }
