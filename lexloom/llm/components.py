"""Connected components of an edge table by alternating large and small stars, with lineage cut every round.

A task first contracts its edges to forests by union-find, some hundred thousand nodes at a time. A round costs shuffles of the edges that
are left, which shrink to one per node; the number of rounds grows with the logarithm of the longest chain. Null ends and loops are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

FOREST = 500_000  # nodes of a task's forest in memory
TASK_ROWS = 20_000  # short rows that are worth a task


def tasks_for(rows: int) -> int:
    """Partitions of a table of so many short rows: they grow with it."""
    return 1 + rows // TASK_ROWS


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def out() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in root if find(x) != x]
        for i in range(0, len(nodes), 100_000):
            part = nodes[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
        if len(root) > FOREST:
            yield from out()
            root = {}
    yield from out()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): for every node with an edge to another, the smallest node that it reaches."""
    low, high = F.least(a, b), F.greatest(a, b)
    own = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.cast("long").alias("u"), low.cast("long").alias("v"))
    own = cut(own.mapInArrow(_forest, "u long, v long"))
    for _ in range(rounds):
        # done when every node has one parent and no parent has a parent
        ends = own.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("parent")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("parent")))).alias("end")).select("end.*")
        state = ends.groupBy("node").agg(F.min("parent").alias("lo"), F.max("parent").alias("hi"), F.max(F.col("parent").isNull()).alias("is_parent"))
        nodes, unsettled = state.agg(F.count("*"), F.count_if(F.expr("lo <> hi OR (lo IS NOT NULL AND is_parent)"))).first()
        if not unsettled:
            break
        tasks = tasks_for(nodes)
        # large star: a node's larger neighbours take its least neighbour, or itself, as their parent
        least = state.select(F.col("node").alias("v"), F.coalesce("lo", "node").alias("m"))
        large = own.join(least, "v").select("u", F.col("m").alias("v")).coalesce(tasks)
        # small star: a node's parents, at most one for each forest, take the least of them as theirs
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u"))).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("edge")).select("edge.*")
        before, own = own, cut(small.where("u <> v").coalesce(tasks).mapInArrow(_forest, "u long, v long"))
        release(before)
    else:
        raise RuntimeError("components did not settle")
    return own.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("of")).select("of.*").distinct()
