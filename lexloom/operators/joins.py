"""Joins that hold up where one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(large: DataFrame, small: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """large join small on equal keys; a key's rows of `large` are dealt over `salts` tasks, and the rows of `small` go to each of them.

    The salt is a hash of the whole row of `large`, so that a task that is run again deals alike. `how` is inner or left.
    """
    salted = large.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in large.columns)), F.lit(salts)).cast("int"))
    copied = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copied, [*on, "__salt"], how).drop("__salt")
