"""Substring dedup by line or paragraph hashing.

Texts are cut at line breaks (or blank lines), and units of several sentences also into their sentences (after . ! or ? and one space), so
that a passage inside a line is found as well. A unit is normalised (A-Z lower-cased, runs of white space as one space, trimmed) and hashed to
128 bits, and units of at least `min_words` words are grouped by digest over all documents. The occurrence with the lowest (document id,
start) stays and every other one is removed; a line whose sentences are all removed goes with its break. Removed spans keep their offsets in the original text.

With `runs`, lines of any length are units, and a sentence too short to be one is joined with the units after it, and with those before
it, until the run has `min_words` words (lines may be crossed). A repeated run goes with all of its sentences, so a repeated passage goes whole, while
a single short sentence inside a line that is not repeated stays.

Only digests move between machines: per task, a digest goes out once with its earliest place and its count, so a line that fills a third of
all rows costs one row per task; digests found once are then dropped, and only documents that hold a repeated digest get a list of
removed places. Offsets are in code points, ends exclusive.

Defined cases: a null text stays null and removes nothing; rows with a null id neither remove nor lose anything; rows that repeat an id are one document, so
equal rows lose the same spans; empty tables give no rows. Other columns pass through `dedup`; its own two are named by `out` and replace columns of those
names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, gives_back

_BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}
_SENTENCE = re.compile(r"(?<=[.!?]) ")

Span = tuple[int, int]


def pieces(text: str, breaks: re.Pattern, start: int = 0) -> list[Span]:
    """The spans between the breaks."""
    out, at = [], 0
    for m in breaks.finditer(text):
        out.append((start + at, start + m.start()))
        at = m.end()
    return [*out, (start + at, start + len(text))]


def units(text: str, unit: str, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit, and of each sentence of a unit that has several, with enough words."""
    out = []
    for start, end in pieces(text, _BREAKS[unit]):
        if end - start < 2 * min_words - 1:
            continue
        piece = text[start:end]
        words = piece.encode().lower().split()
        if len(words) < min_words:
            continue
        out.append((start, end, xxhash.xxh3_128_digest(b" ".join(words))))
        own = pieces(piece, _SENTENCE, start)
        for a, b in own if len(own) > 1 else ():
            words = text[a:b].encode().lower().split()
            if len(words) >= min_words:
                out.append((a, b, xxhash.xxh3_128_digest(b" ".join(words))))
    return out


def runs_of(text: str, unit: str, min_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit with words, and of its sentences if it has several: long ones alone, short ones in runs of enough words to either side."""
    out: dict[Span, bytes] = {}
    flat = []
    for start, end in pieces(text, _BREAKS[unit]):
        piece = text[start:end]
        words = piece.encode().lower().split()
        if not words:
            continue
        out[start, end] = xxhash.xxh3_128_digest(b" ".join(words))
        own = pieces(piece, _SENTENCE, start)
        if len(own) > 1:
            flat += [(a, b, w, True) for a, b in own if (w := text[a:b].encode().lower().split())]
        else:
            flat.append((start, end, words, False))
    for i, (_, _, _, inner) in enumerate(flat):
        for step in (1, -1) if inner else ():
            n, j = len(flat[i][2]), i
            while n < min_words and 0 <= j + step < len(flat):
                j += step
                n += len(flat[j][2])
            lo, hi = min(i, j), max(i, j)
            span = flat[lo][0], flat[hi][1]
            if n >= min_words and span not in out:
                out[span] = xxhash.xxh3_128_digest(b" ".join(w for u in flat[lo : hi + 1] for w in u[2]))
    return [(a, b, digest) for (a, b), digest in out.items()]


def inside(text: str, spans: set[Span], unit: str) -> set[Span]:
    """The units and sentences of the text that lie in one of the spans."""
    starts, ends = [], []
    for a, b in sorted(spans):
        starts.append(a)
        ends.append(max(b, ends[-1]) if ends else b)
    held = lambda a, b: a < b and (k := bisect_right(starts, a)) > 0 and ends[k - 1] >= b
    lines = pieces(text, _BREAKS[unit])
    return {s for start, end in lines for s in ((start, end), *pieces(text[start:end], _SENTENCE, start)) if held(*s)}


def _places(docs: DataFrame, unit: str, min_words: int, first_only: bool, runs: bool) -> DataFrame:
    """(digest, doc_id, start, end, n): per task and digest the earliest place with the number met; or else every place."""

    parts_of = runs_of if runs else units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list] = {}

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5))], names=["digest", "doc_id", "start", "end", "n"])

        for part in chunks(batches):
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                for start, end, digest in parts_of(text, unit, min_words):
                    if not first_only:
                        rows.append((digest, doc_id, start, end, 1))
                        continue
                    own = best.get(digest)
                    if own is None:
                        best[digest] = [digest, doc_id, start, end, 1]
                    else:
                        own[4] += 1
                        if (doc_id, start) < (own[1], own[2]):
                            own[1:4] = doc_id, start, end
            if rows:
                yield out(rows)
            if len(best) > 120_000:
                yield out(list(best.values()))
                best = {}
        if best:
            yield out(list(best.values()))

    return docs.mapInArrow(gives_back(run), "digest binary, doc_id long, start long, end long, n long")


def repeats(docs: DataFrame, unit: str = "line", min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """(doc_id, spans): per document, the rising (start, end) of the repeated units; a sentence may lie in a listed line, or several in a listed run."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    kept = _places(own, unit, min_words, True, runs).groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1").select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.start").alias("keep_start"))
    kept = cut(kept)  # with an exchange of its own, the join can split a digest that many rows hold
    every = _places(own, unit, min_words, False, runs)
    gone = every.join(kept, "digest").where((F.col("doc_id") != F.col("keep_id")) | (F.col("start") != F.col("keep_start")))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def without(text: str, spans: set[Span], unit: str = "line") -> tuple[str, list[Span]]:
    """The text without the spans, and those not inside another. Units left are joined by their breaks, sentences by a space."""
    out, gone = [], []
    places = pieces(text, _BREAKS[unit])
    for k, (start, end) in enumerate(places):
        if (start, end) in spans:
            gone.append((start, end))
            continue
        own = pieces(text[start:end], _SENTENCE, start)
        left = [s for s in own if s not in spans]
        gone += [s for s in own if s in spans]
        if left:
            if out:
                out.append(text[places[k - 1][1] : start])
            out.append(" ".join(text[a:b] for a, b in left))
    return "".join(out), gone


def dedup(docs: DataFrame, unit: str = "line", min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", runs: bool = False, out: tuple[str, str] = ("text_deduped", "removed")) -> DataFrame:
    """docs with the text left and the spans removed (array of (start, end) in the original text), named by `out`."""
    spans = repeats(docs, unit, min_words, id_col, text_col, runs).select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))

    @F.pandas_udf("text string, removed array<struct<start: long, end: long>>")
    def cut_out(text: pd.Series, removed: pd.Series) -> pd.DataFrame:
        held = [set() if t is None else {(x["start"], x["end"]) for x in r} for t, r in zip(text, removed, strict=True)]
        made = [(None, []) if t is None else without(t, inside(t, s, unit) if runs else s, unit) for t, s in zip(text, held, strict=True)]
        return pd.DataFrame({"text": pd.Series([t for t, _ in made], dtype=object), "removed": [[{"start": a, "end": b} for a, b in gone] for _, gone in made]})

    rest = docs.drop(*out)
    joined = rest.join(spans, rest[id_col].cast("long") == F.col("__id"), "left").drop("__id")
    some = F.when(F.col("__spans").isNotNull(), F.col(text_col))  # texts that stay as they are don't go through Python
    cleaned = joined.withColumn("__cut", cut_out(some, F.coalesce("__spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))))
    return cleaned.withColumn(out[1], F.col("__cut.removed")).withColumn(out[0], F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.col("__cut.text"))).drop("__cut", "__spans")
