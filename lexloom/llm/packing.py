"""Hierarchical multi-length packing of documents into training sequences.

Every document is tokenised and ends with an end id. Each task packs the documents of its own partition, a block of tokens at a time,
so nothing is shuffled and no task holds more than a block and the pieces still open. Within a block:

1. full windows of the longest context size are cut off long documents;
2. the remaining pieces are routed to the smallest context size (tier) that holds them;
3. from the longest tier down, each piece opens a window of its tier and the window's gap is filled from shorter pieces, the longest
   that fits first; if none fits, the shortest piece left is cut to measure, so that closed windows have no padding;
4. windows are dealt to step groups so that the groups' attention cost (the sum of squared lengths) is even.

Pieces left when the partition ends go into windows of falling powers of two. Ids of sequences and groups hold the partition's number
and are unique in the result. A null text is an empty document, which is its end id alone; a null document id stays null; repeated
rows are documents of their own; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, gives_back
from .tokens import WordBpe

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Pieces:
    """The pieces not yet packed, by length; the longest that fits and the shortest are found from a bit mask of lengths."""

    def __init__(self) -> None:
        self.by, self.mask = {}, 0

    def add(self, length: int, doc: int, start: int) -> None:
        self.by.setdefault(length, []).append((doc, start))
        self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        own = self.by[length]
        piece = own.pop()
        if not own:
            del self.by[length]
            self.mask ^= 1 << length
        return piece

    def longest(self, most: int) -> int:
        return (self.mask & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1


def fill(pieces: Pieces, size: int) -> list[tuple[int, int, int]]:
    """Takes (doc, start, length) pieces for one window of `size`; the window stays short only if the pieces run out."""
    window, gap = [], size
    while gap and pieces.mask:
        length = pieces.longest(gap)
        if length > 0:
            window.append((*pieces.take(length), length))
        else:
            whole = pieces.shortest()
            doc, start = pieces.take(whole)
            window.append((doc, start, length := gap))
            pieces.add(whole - gap, doc, start + gap)
        gap -= length
    return window


def pack_block(pieces: Pieces, tiers: tuple[int, ...], tokens: int, last: bool) -> tuple[list, int]:
    """Windows as (tier, pieces), and the tokens left in `pieces`; unless it is the last block, too few for a window stay for the next."""
    windows, top = [], tiers[-1]
    while pieces.mask and (last or tokens >= top):
        longest = pieces.longest(top)
        tier = next(t for t in tiers if t >= longest)
        if tokens < tier:  # the end of the partition
            tier = 1 << (tokens.bit_length() - 1)
        windows.append((tier, fill(pieces, tier)))
        tokens -= tier
    return windows, tokens


def balance(costs: list[int], groups: int) -> list[int]:
    """Each window's group, the costliest first to the group with the least cost so far."""
    heap, out = [(0, g) for g in range(groups)], [0] * len(costs)
    for k in sorted(range(len(costs)), key=lambda k: -costs[k]):
        cost, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (cost + costs[k], g))
    return out


def packer(path: str, tiers: tuple[int, ...], end_id: int, group_tokens: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the task's own: Spark's workers go on to other stages, and would keep some hundred megabytes of words
        encoder, top = WordBpe(path), tiers[-1]
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype=np.int32)
        docs: dict[int, tuple] = {}
        pieces, waiting, number, group = Pieces(), 0, 0, 0

        def flush(windows: list) -> pa.RecordBatch:
            nonlocal number, group
            groups = max(1, round(sum(t for t, _ in windows) / group_tokens))
            dealt, rows = balance([t * t for t, _ in windows], groups), []
            for (tier, window), g in zip(windows, dealt, strict=True):
                offset = 0
                for doc, start, length in window:
                    doc_id, ids = docs[doc]
                    rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), base + number, offset, tier, base + group + g))
                    offset += length
                number += 1
            group += groups
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 7, pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, full
            windows, waiting = pack_block(pieces, tiers, waiting, last)
            windows += full
            full = []
            if windows:
                yield flush(windows)
            open_docs = {doc for own in pieces.by.values() for doc, _ in own}
            for doc in [d for d in docs if d not in open_docs]:
                del docs[doc]

        key, held, full = 0, 0, []
        for part in chunks(batches):
            for doc_id, ids in zip(part["doc_id"], encoder.encode(part["text"]), strict=True):
                ids = np.concatenate([ids, end])
                docs[key] = (doc_id, ids)
                whole = len(ids) // top * top
                full += [(top, [(key, s, top)]) for s in range(0, whole, top)]
                if len(ids) > whole:
                    pieces.add(len(ids) - whole, key, whole)
                    waiting += len(ids) - whole
                key, held = key + 1, held + len(ids)
                if held >= block_tokens:
                    yield from packed(False)
                    held = 0
        encoder.close()
        yield from packed(True)

    return run


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, group_tokens: int = 16 * 2048, block_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, its ids' CRC-32, tier and step group. Tiers are rising powers of two."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers must be rising powers of two")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(gives_back(packer(path, tuple(tiers), end_id, group_tokens, block_tokens)), SCHEMA)
