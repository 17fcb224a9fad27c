"""Embedding near-duplicates by lattice hashing.

A table projects unit vectors on BLOCKS random eight-dimensional subspaces and decodes each projection to the nearest point of the lattice E8
(the nearer of its two D8 cosets); the points of all blocks name the cell. A vector lies in its home cell and also looks into neighbouring ones: in turn,
each block's point is exchanged for the other coset's point and for the next nearest of either coset. Vectors that meet in a
cell of any table are compared by cosine in double precision.

Equal vectors are one representative with a multiplicity. A cell's members are compared in blocks, so no group is expanded into its pairs: a
block gives each representative its number of links, counted only in the first table where two vectors meet, and a spanning forest of the links for
the components. Cells where nobody can meet are dropped before vectors move.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different lengths are compared among
those of their own length; a null id has a null component; repeated rows are equal vectors and link with each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_groups
from .components import components
from .textkit import mix

TABLES, BLOCKS, CELL, MEMBERS = 10, 2, 0.35, 512
PROBES = 3  # of a block, besides its own point


def _coset(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest points of D8 (integers with an even sum) to each row."""
    near = np.rint(x)
    gap = x - near
    step = np.where(gap >= 0, 1.0, -1.0)
    order = np.argsort(-np.abs(gap), axis=1)
    row = np.arange(len(x))
    a, b = order[:, 0], order[:, 1]
    odd = near.sum(axis=1) % 2 != 0
    first, second = near.copy(), near.copy()
    first[row[odd], a[odd]] += step[row[odd], a[odd]]
    second[row[odd], b[odd]] += step[row[odd], b[odd]]
    even = row[~odd]
    second[even, a[~odd]] += step[even, a[~odd]]
    second[even, b[~odd]] += step[even, b[~odd]]
    return first, second


def e8(x: np.ndarray) -> np.ndarray:
    """Doubled integer coordinates of the nearest E8 point and of PROBES neighbours, nearest first: (rows, 1 + PROBES, 8)."""
    points = np.stack([*_coset(x), *(p + 0.5 for p in _coset(x - 0.5))], axis=1)
    far = ((points - x[:, None]) ** 2).sum(axis=2)
    return np.take_along_axis(points * 2, np.argsort(far, axis=1, kind="stable")[:, :, None], axis=1).astype(np.int64)


class Lattice:
    def __init__(self, size: int, tables: int = TABLES, blocks: int = BLOCKS, cell: float = CELL, seed: int = 5):
        r = np.random.RandomState(seed)
        blocks = max(1, min(blocks, size // 8))
        wide = max(size, 8)
        self.planes = [np.linalg.qr(r.standard_normal((wide, 8 * blocks)))[0][:size] / cell for _ in range(tables)]
        self.blocks, self.tables = blocks, tables
        self.odd = r.randint(0, 2**62, (blocks, 8)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + PROBES * blocks) cell names; the first is the home."""
        out = np.empty((len(unit), self.tables, 1 + PROBES * self.blocks), dtype=np.uint64)
        for t, plane in enumerate(self.planes):
            x = unit @ plane
            names = np.stack([mix((e8(x[:, 8 * b : 8 * b + 8]).astype(np.uint64) * self.odd[b]).sum(axis=2, dtype=np.uint64)) for b in range(self.blocks)], axis=1)
            home = names[:, :, 0].sum(axis=1, dtype=np.uint64)
            out[:, t, 0] = home
            for b in range(self.blocks):
                for p in range(PROBES):
                    out[:, t, 1 + b * PROBES + p] = home - names[:, b, 0] + names[:, b, 1 + p]
            out[:, t] = mix(out[:, t] + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # the largest component first, so that no square overflows or vanishes
    flat = flat / np.abs(flat).max(axis=1, keepdims=True, initial=0)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each row to the least row that it reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def compare(lattice: Lattice, threshold: float):
    """Of a partition's rows, sorted by (cell, l, r): (rep, links) counts and (a, b) edges."""

    def pairs_of(v: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, q = np.flatnonzero(right & home), np.flatnonzero(left)
        i, j = np.nonzero(v[r] @ v[q].T >= threshold)
        i, j = r[i], q[j]
        keep = (rep[i] != rep[j]) & (~home[j] | (rep[i] < rep[j]))
        return i[keep], j[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                rep, mult, v, a, b, t, looks = (np.concatenate(x) for x in zip(*held, strict=True))
                used, at = np.unique(rep, return_index=True)
                place = np.searchsorted(used, rep)
                a, b = place[a], place[b]
                cells = lattice.cells(v[at])
                weight = mult[at]
                first = np.full(len(a), lattice.tables)
                for k in range(lattice.tables - 1, -1, -1):
                    x, y = cells[a, k], cells[b, k]
                    met = (x[:, :1] == y).any(axis=1) | (y[:, :1] == x).any(axis=1)
                    first[met] = k
                # two vectors that look into each other's cells meet twice in a table
                mutual = looks & (cells[a, t, 1:] == cells[b, t, :1]).any(axis=1)
                own = (first == t) & (~mutual | (a < b))
                a, b = a[own], b[own]
                links = np.bincount(a, weights=weight[b], minlength=len(used)) + np.bincount(b, weights=weight[a], minlength=len(used))
                some = np.flatnonzero(links)
                x, y = _forest(a, b, len(used))
                n, m = len(some), len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([used[some], used[x]])), pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(m, np.int64)])), pa.array(np.concatenate([np.zeros(n, np.int64), used[y]]), mask=np.arange(n + m) < n)], names=["rep", "links", "other"]
                )
            held, size = [], 0

        for part, cuts in whole_groups(batches, ["cell", "l", "r"]):
            part = part.combine_chunks()
            rep, mult, t = (part.column(c).to_numpy() for c in ("rep", "mult", "t"))
            home, left, right = (part.column(c).to_numpy() for c in ("home", "asks", "holds"))
            v = _matrix(part.column("embedding").chunk(0) if isinstance(part.column("embedding"), pa.ChunkedArray) else part.column("embedding"))
            for x, y in zip(cuts, cuts[1:], strict=False):
                i, j = pairs_of(v[x:y], home[x:y], left[x:y], right[x:y], rep[x:y])
                if len(i):
                    used, both = np.unique(np.concatenate([i, j]), return_inverse=True)
                    off = size
                    held.append((rep[x:y][used], mult[x:y][used], v[x:y][used], both[: len(i)] + off, both[len(i) :] + off, t[x:y][i], ~home[x:y][j]))
                    size += len(used)
                    if len(i) > 200_000 or size > 20_000:
                        yield from flush()
        yield from flush()

    return run


def link(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row. Components keep their type (floats or doubles); cosines are in double precision."""
    kind = dict(vectors.dtypes)[vector_col]
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("embedding"))
    lengths = [r["size"] for r in own.where(F.size("embedding") > 0).select(F.size("embedding").alias("size")).distinct().orderBy("size").collect()]
    if not lengths:
        return _alone(own)
    parts = [_link(own.where(F.size("embedding") == size), Lattice(size), size, threshold) for size in lengths]
    return reduce(DataFrame.unionByName, [*parts, _alone(own.where(F.col("embedding").isNull() | (F.size("embedding") <= 0)))])


def _alone(own: DataFrame) -> DataFrame:
    return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))


def _link(own: DataFrame, lattice: Lattice, size: int, threshold: float) -> DataFrame:
    sound = F.coalesce((F.size("embedding") == size) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = own.where(F.col("vec_id").isNotNull() & sound)
    reps = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                cells = lattice.cells(_matrix(part.column(1)))
                n, tables, each = cells.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), tables * each)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), n)), pa.array(cells.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(each) == 0, n * tables))], names=["rep", "t", "cell", "home"]
                )

    cells = cut(reps.select("rep", "embedding").mapInArrow(locate, "rep long, t int, cell long, home boolean"))
    useful = cells.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("total")).where("homes > 0 AND total > 1")
    blocks = useful.select("cell", F.ceil(F.col("total") / MEMBERS).cast("int").alias("lefts"), F.ceil(F.col("homes") / MEMBERS).cast("int").alias("rights"))
    turn = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    rows = cells.join(blocks, "cell")
    asks = rows.select("cell", "t", "rep", "home", turn(F.col("lefts")).alias("l"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("r"), F.lit(True).alias("asks"), F.lit(False).alias("holds"))
    holds = rows.where("home").select("cell", "t", "rep", "home", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), turn(F.col("rights")).alias("r"), F.lit(False).alias("asks"), F.lit(True).alias("holds"))
    placed = asks.unionByName(holds).groupBy("cell", "l", "r", "t", "rep", "home").agg(F.max("asks").alias("asks"), F.max("holds").alias("holds"))
    full = placed.join(reps, "rep").repartition("cell", "l", "r").sortWithinPartitions("cell", "l", "r", "rep")
    found = cut(full.mapInArrow(compare(lattice, threshold), "rep long, links long, other long"))
    counts = found.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), "a", "b")
    per_rep = reps.join(counts, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left").select("embedding", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    marked = own.withColumn("sound", F.col("vec_id").isNotNull() & sound)
    joined = marked.where("sound").join(per_rep, "embedding").select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = marked.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
