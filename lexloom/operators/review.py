"""Samples, triage order and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified_sample(rows: DataFrame, strata: Column, key: str, size: int) -> DataFrame:
    """Round robin over the strata in name order, ids in order within each, until `size` rows: exact and without chance."""
    placed = rows.withColumn("stratum", strata).withColumn("turn", F.row_number().over(Window.partitionBy("stratum").orderBy(key)))
    return placed.where(F.col("turn") <= size).orderBy("turn", "stratum").limit(size)


def proxy_size(n: int, share: float = 0.25, least: int = 50, most: int = 300) -> int:
    return min(n, max(least, min(most, -int(-n * share // 1)))) if n > 0 else 0


def diverse(rows: DataFrame, theme: str, order: list[Column], size: int) -> DataFrame:
    """The first row of every theme in the given order, then the others in that order, up to `size`."""
    first = F.row_number().over(Window.partitionBy(theme).orderBy(*order)) == 1
    return rows.withColumn("is_first", first).orderBy(F.col("is_first").desc(), *order).limit(size)


def conflicts(rows: DataFrame, subject: list[str], value: str) -> DataFrame:
    """Subjects with more than one distinct value, and the values in order."""
    return rows.groupBy(*subject).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1)
