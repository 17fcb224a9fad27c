"""Run metrics, slices, value reports, comparisons and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import latency_factor


def run_metrics(rows: DataFrame, answer: str, grounding: str, telemetry: str, ms: str, by: list[str] | None = None) -> DataFrame:
    """Means, and overall as the product of the means with the latency factor of the mean latency; upper median and index-defined p95."""
    by = by or []
    order = Window.partitionBy(*by).orderBy(ms) if by else None
    agg = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(answer).alias("answer_mean"), F.avg(grounding).alias("grounding_mean"), F.avg(telemetry).alias("telemetry_mean"), F.avg(ms).alias("ms_mean"))
    scored = agg.withColumn("latency", latency_factor(F.col("ms_mean"))).withColumn("overall", F.col("answer_mean") * F.col("grounding_mean") * F.col("telemetry_mean") * F.col("latency"))
    if not by:
        return scored
    # the values at 0-based places n // 2 and max(0, int(.95 n) - 1) of each group
    size = F.count("*").over(Window.partitionBy(*by))
    placed = rows.select(*by, F.col(ms).alias("v"), (F.row_number().over(order) - 1).alias("place"), size.alias("size"))
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("v")))
    points = placed.groupBy(*by).agg(at(F.floor(F.col("size") / 2)).alias("p50"), at(F.greatest(F.lit(0), F.floor(F.col("size") * 0.95) - 1)).alias("p95"))
    return scored.join(points, by)


def slices(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Count and means per value of each key in one pass: grouping sets of one key each; blank labels are 'unknown'."""
    named = rows.select(*(F.when(F.trim(F.col(k)) == "", None).otherwise(F.col(k)).alias(k) for k in keys), *measures)
    named = named.fillna("unknown", subset=keys)
    grouped = named.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(F.count("*").alias("n"), *(F.avg(m).alias(f"{m}_mean") for m in measures))
    dimension = F.coalesce(*(F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys))
    return grouped.select(dimension.alias("dimension"), F.coalesce(*keys).alias("label"), "n", *(f"{m}_mean" for m in measures))


def value_report(rows: DataFrame, key: str, overall: str, tags: str, strong: float = 0.75, mixed: float = 0.4, top: int = 3) -> DataFrame:
    """Per label: count, share, mean, weighted value, the most frequent tags (count, then name) and a verdict."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(overall).alias("mean"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    tag = rows.select(key, F.explode(tags).alias("__tag")).groupBy(key, "__tag").agg(F.count("*").alias("__n"))
    ranked = tag.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("__n").desc(), "__tag"))).where(F.col("__r") <= top)
    names = ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__tag"))), lambda x: x["__tag"]), ",").alias("top_tags"))
    verdict = F.when(F.col("mean") >= strong, "strong").when(F.col("mean") >= mixed, "mixed").otherwise("weak")
    return counts.crossJoin(F.broadcast(total)).join(names, key, "left").select(key, "n", (F.col("n") / F.col("total")).alias("share"), "mean", (F.col("n") * F.col("mean")).alias("weighted"), F.coalesce("top_tags", F.lit("")).alias("top_tags"), verdict.alias("verdict"))


def compare_runs(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer join of two runs; a missing side counts 0."""
    a, b = left.select(key, F.col(value).alias("left_value")), right.select(key, F.col(value).alias("right_value"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, key, "full").select(key, zero("left_value").alias("left_value"), zero("right_value").alias("right_value"), (zero("right_value") - zero("left_value")).alias("delta"))


def gate(candidate: DataFrame, baseline: DataFrame, key: str, measures: list[str], slack: float = 0.01) -> DataFrame:
    """Whether each measure is at least the baseline's less `slack`, and the failed ones by name."""
    old = baseline.select(key, *(F.col(m).alias(f"base_{m}") for m in measures))
    failed = F.array_compact(F.array(*(F.when(F.col(m) < F.col(f"base_{m}") - slack, F.lit(m)) for m in measures)))
    return candidate.select(key, *measures).join(old, key).select(key, F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("passed"))


def confusion(pairs: DataFrame, expected: str, predicted: str, classes: DataFrame, label: str) -> DataFrame:
    """Per class, zero ones too: tp, fp, fn, support, precision, recall and F1."""
    cells = pairs.groupBy(expected, predicted).agg(F.count("*").alias("k"))
    sides = cells.select(F.col(expected).alias(label), F.when(F.col(expected) == F.col(predicted), F.col("k")).otherwise(0).alias("tp"), F.col("k").alias("support"), F.lit(0).cast("long").alias("predicted")).unionByName(cells.select(F.col(predicted).alias(label), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("k").alias("predicted")))
    sums = classes.select(label).join(sides, label, "left").groupBy(label).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "support", "predicted")))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    rows = sums.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))


def histogram(rows: DataFrame, array: str, label: str = "label") -> DataFrame:
    """Counts of non-blank labels over an array column."""
    return rows.select(F.explode(array).alias(label)).where(F.trim(label) != "").groupBy(label).agg(F.count("*").alias("n"))


def nearest_rank(value: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
