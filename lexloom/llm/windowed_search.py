"""Ranked lexical search of a corpus for whole tables of items, scored in fixed windows of document ids.

1. Items are cut into blocks of about `block_terms` (item, term) rows; a block's distinct terms are what its tasks know (bounded by the parameter,
   and by one item's distinct terms). Each block is one pass over all documents.
2. `index`: a task finds a document's terms and keeps the block's terms with their frequencies; the table is written to the shared folder.
   From it come the number of documents with terms (N), of all terms (L), and of documents for each term.
3. Documents are dealt by ranges of (window, hash of the text, place in the table), so neither a full window nor a repeated row is one task's
   burden, and sorted by id. A task inverts one window of `WINDOW` documents at a time into postings, adds an item's postings into an array of
   64-bit sums that fits the cache, marks each run of 64 documents that it touches in an occupancy bitset, and harvests the marked runs into
   the item's heap.
4. The tasks' heaps are ranked in two levels, so an item's candidates do not all meet in one task.

Defined cases: a null text, or one without a term, is no document of N and is never ranked; an item whose text is null or has no terms has no
rows; repeated documents are ranked each by itself; a null id comes last among equal scores; rows that repeat an item's id count as one item with
the terms of all; texts are read whole, whatever their length; other columns are not read; empty tables give no rows. Where the product in a
length norm would pass 64 bits it is computed with Python integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, release

#: Documents of a window (a power of two): 64 KB of sums.
WINDOW = 8192

#: Fixed values of the score: what separates terms, the scale of a weight, of an impact and of a length norm.
_TERM = [c >= 128 or chr(c).isalnum() for c in range(256)]
_LOWER = bytes((c + 32 if 65 <= c <= 90 else c) if keep else 32 for c, keep in enumerate(_TERM))
WEIGHT, IMPACT, SATURATION, SLOPE = 1000, 1_000_000_000, 1000, 50


def terms(text: str) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case, in UTF-8."""
    return text.encode().translate(_LOWER).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * holding + 1)))


def norms(sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - SLOPE + (SLOPE * n * N) div L of each document length."""
    if len(sizes) and SLOPE * documents * int(sizes.max()) >= 2**63:
        return np.array([100 - SLOPE + SLOPE * int(n) * documents // total for n in sizes], dtype=np.int64)
    return 100 - SLOPE + (SLOPE * documents * sizes) // max(total, 1)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (IMPACT * tf) // (SATURATION * tf + 20 * norm)


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spread, n, terms, tf): the length of every document that has a term, and what it holds of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one block's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for part in chunks(batches):
            rows = []
            for doc_id, text, spread in zip(part["doc_id"], part["text"], part["spread"], strict=True):
                words = terms(text)
                if not words:
                    continue
                held = Counter(filter(number.__contains__, words))
                rows.append((doc_id, spread, len(words), np.fromiter(map(number.__getitem__, held), np.int32, len(held)), np.fromiter(held.values(), np.int64, len(held))))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "spread", "n", "terms", "tf"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("spread"))
    return own.mapInArrow(run, "doc_id long, spread long, n long, terms array<int>, tf array<long>")


class Heaps:
    """The best `most` (score, id) of each item. Ids come in rising order, so an equal score never displaces an earlier one."""

    def __init__(self, items: dict[int | None, tuple[list[int], list[int]]], most: int):
        self.items, self.most = items, most
        self.heaps: dict[int | None, list[tuple[int, int, int | None]]] = {i: [] for i in items}
        self.sums = np.zeros((WINDOW // 64, 64), dtype=np.int64)
        self.flat = self.sums.reshape(-1)
        self.occupied = np.zeros(WINDOW // 64, dtype=bool)
        self.arrived = 0

    def window(self, ids: list[int | None], sizes: np.ndarray, held: np.ndarray, impact: np.ndarray) -> None:
        """One window of at most WINDOW documents: document d holds sizes[d] terms, listed in `held` with their impacts."""
        if not len(held):
            return
        slot = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(held, kind="stable")
        held, slot, impact = held[order], slot[order], impact[order]
        starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        ends = np.append(starts[1:], len(held))
        postings = {int(held[a]): (slot[a:b], impact[a:b], np.unique(slot[a:b] >> 6)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}
        for item, (numbers, weights) in self.items.items():
            for t, w in zip(numbers, weights, strict=True):
                if t in postings:
                    slots, impact, runs = postings[t]
                    self.flat[slots] += w * impact
                    self.occupied[runs] = True
            self.harvest(item, ids)

    def harvest(self, item: int | None, ids: list[int | None]) -> None:
        """Moves what beats the heap out of the occupied runs, and empties them."""
        marked = np.flatnonzero(self.occupied)
        if not len(marked):
            return
        heap, own = self.heaps[item], self.sums[marked]
        run, place = np.nonzero(own > (heap[0][0] if len(heap) == self.most else 0))
        scores, slots = own[run, place], marked[run] * 64 + place
        if len(slots) > 2 * self.most:
            # a window's best `most`, with all that tie with the last of them
            best = scores >= np.partition(scores, -self.most)[-self.most]
            scores, slots = scores[best], slots[best]
        for score, slot in zip(scores.tolist(), slots.tolist(), strict=True):
            self.arrived += 1
            if len(heap) < self.most:
                heapq.heappush(heap, (score, -self.arrived, ids[slot]))
            elif score > heap[0][0]:
                heapq.heapreplace(heap, (score, -self.arrived, ids[slot]))
        self.sums[marked] = 0
        self.occupied[:] = False


def scan(batches: Iterator[pa.RecordBatch], items: dict, documents: int, total: int, most: int) -> Heaps:
    """Scores rows of `index` that come sorted by window and id."""
    heaps = Heaps(items, most)
    held: list[pa.RecordBatch] = []
    last = None

    def score() -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        for at in range(0, rows.num_rows, WINDOW):  # a window of repeated ids has more rows than ids
            part = rows.slice(at, WINDOW)
            lists = part.column("terms").combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            tf = part.column("tf").combine_chunks().flatten().to_numpy()
            norm = np.repeat(norms(part.column("n").to_numpy(), documents, total), sizes)
            heaps.window(part.column("doc_id").to_pylist(), sizes, lists.flatten().to_numpy(), impacts(tf, norm))
        held.clear()

    for batch in batches:
        window = batch.column(batch.schema.get_field_index("window")).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(window[1:] != window[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and window[a] != last:
                score()
            held.append(batch.slice(a, b - a))
            last = window[a]
    if held:
        score()
    return heaps


def score(index: DataFrame, items: dict, documents: int, total: int, most: int) -> DataFrame:
    """(item_id, doc_id, score, part): each task's best documents of each item."""
    sent = index.sparkSession.sparkContext.broadcast(items)  # one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, heap in scan(batches, sent.value, documents, total, most).heaps.items():
            if heap:
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(heap), pa.int64()), pa.array([x[2] for x in heap], pa.int64()), pa.array([x[0] for x in heap], pa.int64())], names=["item_id", "doc_id", "score"])

    # null ids share the last window, behind all others
    window = F.coalesce(F.shiftright("doc_id", WINDOW.bit_length() - 1), F.lit(2**62))
    placed = index.withColumn("window", window).repartitionByRange("window", "spread", F.monotonically_increasing_id())
    placed = placed.sortWithinPartitions("window", F.col("doc_id").asc_nulls_last()).drop("spread")
    return placed.mapInArrow(run, "item_id long, doc_id long, score long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): each distinct term of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = [(i, t) for i, text in zip(part["item_id"], part["text"], strict=True) for t in sorted(set(terms(text)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].decode() for r in rows], pa.string())], names=["item_id", "term"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id long, term string").distinct()


def rank(items: DataFrame, docs: DataFrame, most: int = 50, block_terms: int = 200_000, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` best documents of every item."""
    asked = cut(item_terms(items, item_id, item_text))
    blocks = max(1, math.ceil(asked.count() / block_terms))
    made = []
    for block in range(blocks):
        pairs = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about block_terms rows
        vocabulary = {t.encode(): k for k, t in enumerate(sorted({r["term"] for r in pairs}))}
        own = cut(index(docs, vocabulary, id_col, text_col))
        documents, total = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = dict(own.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the block's terms
        weights = {t: weight(documents, n) for t, n in holding.items()}
        wanted: dict[int | None, list[int]] = {}
        for r in pairs:
            t = vocabulary[r["term"].encode()]
            if weights.get(t, 0) > 0:
                wanted.setdefault(r["item_id"], []).append(t)
        by_item = {i: (ts, [weights[t] for t in ts]) for i, ts in wanted.items()}
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        best = score(own, by_item, documents, total, most)
        for keys in (["item_id", "part"], ["item_id"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
        made.append(cut(best.select("item_id", "rank", "doc_id", "score")))
        release(own)
    release(asked)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out
