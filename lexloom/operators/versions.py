"""Exact duplicates, version sequences, current versions and supersession."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def duplicate_anchor(rows: DataFrame, content: str, order: str, out: str = "duplicate_of") -> DataFrame:
    """Rows of equal content point to the first by `order`; the first itself has null."""
    keyed = rows.withColumn("content_hash", F.sha2(F.col(content), 256))
    first = keyed.groupBy("content_hash").agg(F.min(order).alias("anchor"))
    return keyed.join(first, "content_hash").withColumn(out, F.when(F.col(order) != F.col("anchor"), F.col("anchor"))).drop("anchor")


def fingerprint(rows: DataFrame, group: str, content: str) -> DataFrame:
    """(group, n, chars, fingerprint): a digest of each group's contents whatever their order, in two levels: the sorted hashes of each of 65,536 buckets by their
    first digits, then the buckets' digests. A null content counts as a row only."""
    hashed = rows.select(group, F.length(content).alias("k"), F.sha2(content, 256).alias("h"))
    digest = lambda c: F.sha2(F.array_join(c, "|"), 256)
    buckets = hashed.groupBy(group, F.substring("h", 1, 4).alias("bucket")).agg(F.count("*").alias("n"), F.sum("k").alias("k"), digest(F.array_sort(F.collect_list("h"))).alias("h"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "h")))), lambda x: x["h"])
    return buckets.groupBy(group).agg(F.sum("n").alias("n"), F.sum("k").alias("chars"), digest(listed).alias("fingerprint"))


def version_sequence(rows: DataFrame, group: str, order: list[Column], out: str = "version_sequence") -> DataFrame:
    """1 to n within each group; rows without a group get null."""
    ranked = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn(out, F.when(F.col(group).isNotNull(), ranked))


def current_version(rows: DataFrame, group: str, flag: Column, rank: list[Column]) -> DataFrame:
    """One row per group: flagged rows before others, then by rank. A null flag is not set."""
    best = Window.partitionBy(group).orderBy(F.coalesce(flag, F.lit(False)).desc(), *rank)
    return rows.withColumn("__best", F.row_number().over(best)).where("__best = 1").drop("__best")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one where it is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _chains(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of chains by pointer doubling over (node, next): (node, newest, steps) of those that end, and (node, at) of those that don't.

    Each round follows twice as many links and joins only nodes that have not met their end; lineage is cut. A node with more links before it than
    there are in the table runs into a cycle: after so many steps it stands on the cycle.
    """
    own = cut(links.select("node", F.col("next").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("next").isNull().alias("done")))
    total = own.where("NOT done").count()
    ended, going, reach = own.where("done"), own.where("NOT done"), 1
    while reach <= total and not going.isEmpty():
        step = ended.union(going).select(F.col("node").alias("mid"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("done").alias("last"))
        further = F.col("next").isNotNull()
        met = going.join(step, F.col("at") == F.col("mid"), "left")
        moved = cut(met.select("node", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.when(further, F.col("more")).otherwise(0)).alias("steps"), (~further | F.col("last")).alias("done")))
        ended, going, reach = ended.union(moved.where("done")), moved.where("NOT done"), 2 * reach
    return ended.select("node", F.coalesce("at", "node").alias("newest"), "steps"), going.select("node", "at")


def _around(links: DataFrame, onto: DataFrame) -> DataFrame:
    """(node, newest, steps) of nodes whose walk meets a cycle: the last node before the first that comes again.

    The nodes that walks stand on are all nodes of the cycles. Their links are taken out, so that what leads to them ends at the node where it
    enters; a cycle's length is counted under its least node, which is passed round by doubling.
    """
    ring = cut(onto.select(F.col("at").alias("node")).distinct())
    inner = cut(links.join(ring, "node"))
    outer = links.select("node", "next").join(onto.select("node"), "node").join(ring, "node", "left_anti")
    entered, _ = _chains(outer.unionByName(ring.withColumn("next", F.lit(None).cast(dict(links.dtypes)["next"]))))
    size, reach = inner.count(), 1
    low = cut(inner.select("node", F.col("next").alias("at"), F.least("node", "next").alias("low")))
    while reach < size:
        step = low.select(F.col("node").alias("mid"), F.col("at").alias("next"), F.col("low").alias("lower"))
        low = cut(low.join(step, F.col("at") == F.col("mid")).select("node", F.col("next").alias("at"), F.least("low", "lower").alias("low")))
        reach *= 2
    lengths = low.join(low.groupBy("low").agg(F.count("*").alias("length")), "low").select(F.col("node").alias("newest"), "length")
    before = inner.select(F.col("next").alias("newest"), F.col("node").alias("last"))
    return entered.join(lengths, "newest").join(before, "newest").select("node", F.col("last").alias("newest"), (F.col("steps") + F.col("length") - 1).alias("steps"))


def supersession(links: DataFrame, node: str, successor: str) -> DataFrame:
    """(node, newest, steps, cyclic): the end of each node's chain of successors, however long.

    A chain that runs into a cycle ends before the first node that would come again, and is marked. A node without a successor is its own end;
    a successor that is no node of the table ends a chain.
    """
    own = cut(links.select(F.col(node).alias("node"), F.col(successor).alias("next")))
    ended, onto = _chains(own)
    out = ended.withColumn("cyclic", F.lit(False))
    if onto.isEmpty():
        return out
    return out.unionByName(_around(own, cut(onto)).withColumn("cyclic", F.lit(True)))


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: new rows replace the old rows of their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
