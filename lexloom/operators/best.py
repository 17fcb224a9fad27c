"""The best rows of a table for every question of another, without a row for each pair.

Questions are arrays of words. They go in groups of about QUESTIONS to each of PARTS cells; rows are dealt over the cells and stream past
their group, a block of ROWS at a time, so that a pair is a number in a block's matrix. Only a block's k best rows of each question become rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, QUESTIONS, PARTS = 512, 512, 256


class Trie:
    """Which of the asked words lie in which texts, byte for byte: all places of a block go down the words' tree together, and most end after a few steps."""

    def __init__(self, asked: list[str]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, word in enumerate(asked):
            node = 0
            for x in word.encode():
                if x not in children[node]:
                    children[node][x] = len(children)
                    children.append({})
                node = children[node][x]
            ends[node] = i
        self.width = len(asked)
        self.next = np.zeros((len(children), 256), dtype=np.int32)  # 0: no way on
        for node, ways in enumerate(children):
            for x, to in ways.items():
                self.next[node, x] = to
        self.word = np.full(len(children), -1, dtype=np.int64)
        for node, i in ends.items():
            self.word[node] = i

    def held(self, texts: list[str]) -> np.ndarray:
        """A row for each text, with 1 at every word that it holds."""
        own = [x.encode() for x in texts]
        raw = np.frombuffer(b"\xff".join(own) + b"\xff", dtype=np.uint8)  # no text has this byte
        row = np.repeat(np.arange(len(own)), [len(x) + 1 for x in own])
        out = np.zeros((len(own), self.width), dtype=np.float32)
        at, node = np.arange(len(raw)), np.zeros(len(raw), dtype=np.int32)
        depth = 0
        while len(at):
            node = self.next[node, raw[at + depth]]
            go = node > 0
            at, node = at[go], node[go]
            word = self.word[node]
            end = word >= 0
            out[row[at[end]], word[end]] = 1
            depth += 1
        return out


def flat(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of lists, and the word and the list of each occurrence."""
    words = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)


def rising(ids: pa.Array) -> np.ndarray:
    """The places of ids (or structs, by their fields in order) in rising order, null first."""
    parts = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
    names = [str(i) for i in range(len(parts))]
    return pc.sort_indices(pa.table(parts, names=names), sort_keys=[(n, "ascending") for n in names], null_placement="at_start").to_numpy()


def best(rows: DataFrame, asked: DataFrame, row: str, question: str, held: str, words: str, k: int, prepare: Callable, measure: Callable, out: str) -> DataFrame:
    """(question, row, out) that hold every question's k best rows, a row's key breaking ties; more than those k come, so a ranking follows.

    `prepare` makes a state of a group's lists in `words`; `measure` gets it and what a block has in `held`, and returns two matrices (row, question): the order, highest first
    and negative where a pair doesn't count, and the values of `out` ("name type", a long or a double).
    """
    kinds = dict(rows.dtypes)[row], dict(asked.dtypes)[question]
    contents = dict(rows.dtypes)[held], dict(asked.dtypes)[words]
    groups = max(1, -(-asked.count() // QUESTIONS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    turn = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select(turn(question, groups).alias("g"), every(PARTS).alias("part"), F.lit(0).alias("side"), F.col(question).alias("q"), none(kinds[0], "r"), F.col(words).alias("words"), none(contents[0], "held"))
    right = rows.select(every(groups).alias("g"), turn(row, PARTS).alias("part"), F.lit(1).alias("side"), none(kinds[1], "q"), F.col(row).alias("r"), none(contents[1], "words"), F.col(held).alias("held"))
    cells = left.unionByName(right).repartition("g", "part").sortWithinPartitions("g", "part", "side")
    types = {"long": pa.int64(), "double": pa.float64()}
    value_type = types[out.split()[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, group, waiting, state, ids = None, None, [], None, None
        for batch in batches:
            g, part, side = (batch.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero((g[1:] != g[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(g)], strict=True):
                if a == b:
                    continue
                if cell != (g[a], part[a]):
                    cell, waiting = (g[a], part[a]), []
                if side[a] == 0:
                    if group != g[a]:
                        waiting.append(batch.slice(a, b - a))
                    continue
                if group != g[a]:  # a group's questions are the same in all its cells
                    if not waiting:
                        continue
                    every = pa.Table.from_batches(waiting).combine_chunks()
                    ids, state, group, waiting = every.column("q").chunk(0), prepare(every.column("words").chunk(0)), g[a], []
                for x in range(a, b, ROWS):
                    block = batch.slice(x, min(ROWS, b - x))
                    order, value = measure(state, block.column(6))
                    at = rising(block.column(4))
                    order = order[at]
                    top = np.argsort(-order, axis=0, kind="stable")[:k]
                    place, q = np.nonzero(np.take_along_axis(order, top, 0) >= 0)
                    r = at[top[place, q]]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), block.column(4).take(pa.array(r)), pa.array(value[r, q], value_type)], names=[question, row, out.split()[0]])

    return cells.mapInArrow(run, f"`{question}` {kinds[1]}, `{row}` {kinds[0]}, {out}")
