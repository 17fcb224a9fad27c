"""Small rule operators of runs, datasets and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PARTS = 8


def fallback_levels(questions: DataFrame, key: str, levels: list[DataFrame]) -> DataFrame:
    """Rows of each question's first level that has any; a level is a table with the question's key."""
    tagged = None
    for i, rows in enumerate(levels):
        one = rows.withColumn("level", F.lit(i + 1))
        tagged = one if tagged is None else tagged.unionByName(one)
    first = tagged.groupBy(key).agg(F.min("level").alias("level"))
    return questions.select(key).join(first, key).join(tagged, [key, "level"])


def canary(key: Column, percent: int) -> Column:
    """Whether a key falls in the first `percent` of a hundred buckets, by its SHA-1."""
    return F.conv(F.substring(F.sha1(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100 < percent


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, each closed by a unit separator, nulls as <none>."""
    return F.sha2(F.concat(*(F.concat(F.coalesce(p.cast("string"), F.lit("<none>")), F.lit("\x1f")) for p in parts)), 256)


def milliseconds_per_token(total: Column, first: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, F.greatest(F.lit(0.0), (total - first) / tokens)).otherwise(0.0)


def direct_answers(assertions: DataFrame, question: str, score: str, value: str, blocked: str, order: list[str], least: float = 0.45, margin: float = 0.12, rival: float = 0.35) -> DataFrame:
    """The best assertion's value if it is strong, well ahead, unconditional, and no strong rival says otherwise; else the reason against."""
    ranked = assertions.withColumn("__r", F.row_number().over(Window.partitionBy(question).orderBy(F.col(score).desc(), *order)))
    at = lambda k, c: F.max(F.when(F.col("__r") == k, F.col(c)))
    best = ranked.groupBy(question).agg(at(1, score).alias("top"), at(2, score).alias("second"), at(1, value).alias("v"), F.max(F.when(F.col("__r") == 1, F.col(blocked).cast("int"))).alias("blocked"), F.size(F.collect_set(F.when(F.col(score) >= rival, F.col(value)))).alias("rivals"))
    reason = F.when(F.col("top") < least, "weak").when(F.col("top") - F.coalesce("second", F.lit(0.0)) < margin, "close").when(F.col("blocked") == 1, "conditional").when(F.col("rivals") > 1, "contradicted")
    return best.select(question, F.when(reason.isNull(), F.col("v")).alias("answer"), F.coalesce(reason, F.lit("answered")).alias("outcome"))


def agreement(candidates: DataFrame, question: str, answer: str, abstained: str, grounded: str) -> DataFrame:
    """all_abstain, consensus, single_grounded or disagreement per question."""
    given = F.when(~F.col(abstained), F.col(answer))
    a = candidates.groupBy(question).agg(F.count_if(~F.col(abstained)).alias("given"), F.countDistinct(given).alias("different"), F.count_if(F.col(grounded) & ~F.col(abstained)).alias("grounded"))
    state = F.when(F.col("given") == 0, "all_abstain").when((F.col("different") == 1) & (F.col("given") > 1), "consensus").when(F.col("grounded") == 1, "single_grounded").otherwise("disagreement")
    return a.select(question, state.alias("state"))


def import_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: rows of `new` that are imported for the first time, and all that are written."""
    one = new.select(key).distinct()
    return one.join(old.select(key, F.lit(1).alias("__old")).distinct(), key, "left").agg(F.count_if(F.col("__old").isNull()).alias("imported"), F.count("*").alias("upserted"))


def page_violations(rows: DataFrame, key: str, page: str, order: list[str]) -> DataFrame:
    """(key, issue) of the keys whose pages, in order, hold numbers under 1, repeat, or don't rise. No key's pages are gathered: repeats are counted by page.

    The tasks follow the input: PARTS for each of its splits (and no fewer than the session's shuffles have), so that what one task sorts and counts doesn't grow.
    """
    tasks = max(PARTS * rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, key)
    before = F.lag(page).over(Window.partitionBy(key).orderBy(*order))
    falls = rows.withColumn("__falls", F.col(page) < before).groupBy(key, page).agg(F.count("*").alias("k"), F.max("__falls").alias("falls"))
    found = falls.groupBy(key).agg(F.min(page).alias("least"), F.max("k").alias("k"), F.max("falls").alias("falls"))
    issues = F.array_compact(F.array(F.when(F.col("least") < 1, "page_below_one"), F.when(F.col("k") > 1, "page_repeated"), F.when(F.col("falls"), "pages_not_ascending")))
    return found.select(key, F.explode(issues).alias("issue"))


def notices(rows: DataFrame, target: str, date: str, key: str) -> DataFrame:
    """Each target's notices by date, those without one first; ties by key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(target).orderBy(F.col(date).asc_nulls_first(), key)))


def earlier_of(rows: DataFrame, question: str, instrument: str, date: str) -> DataFrame:
    """Per question the instrument with the earliest date; ties and missing dates leave it open."""
    dated = rows.groupBy(question, instrument).agg(F.min(date).alias("d"), F.countDistinct(date).alias("k"))
    a = dated.groupBy(question).agg(F.min(F.struct("d", instrument)).alias("first"), F.count("*").alias("n"), F.count("d").alias("known"), F.min("d").alias("lo"), F.collect_list("d").alias("all"))
    ties = F.size(F.filter("all", lambda x: x == F.col("lo")))
    sure = (F.col("n") >= 2) & (F.col("known") == F.col("n")) & (ties == 1)
    return a.select(question, F.when(sure, F.col(f"first.{instrument}")).alias("answer"), (~sure).alias("abstained"))
