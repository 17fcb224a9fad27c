"""Quality classifier: a sparse ensemble of rules over text statistics.

1. `statistics` computes shares of characters, words and lines of each whole text (numpy over a slice of texts).
2. A random forest of shallow trees is grown on labelled rows; every path from a root is a conjunctive rule.
3. A lasso logistic regression over the rules' truth values keeps few of them.
4. The kept rules are compiled into Spark column expressions; scoring is then one projection over the statistics.

The labelled rows are a sample of at most `train_rows`, the lowest by a hash of their id, so it does not follow the corpus. Scores never
see ids, languages, sources or labels. A null text is scored as an empty one; a null or missing label doesn't train; with no labelled rows, or
only one label, every score is the share of label 1 (0.5 with none). Repeated rows are scored one by one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, gives_back, slices
from .textkit import Words

STATISTICS = ("words", "chars_per_word", "upper", "digits", "stops", "symbols", "bars", "marks", "repeats", "distinct", "words_per_line", "joined")
SLICE = 250_000  # characters of texts worked on at once

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:"]] = 3
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]\\/_=+"]] = 4
_CLASS[ord("|")] = 5
_CLASS[[ord(c) for c in "!?"]] = 6


def measure(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    w = Words(texts)
    n = len(texts)
    size = np.maximum(w.size, 1)
    kind = _CLASS[np.frombuffer(w.bytes, dtype=np.uint8)]
    count = np.diff(w.first)
    words = np.maximum(count, 1)
    h = w.hashes()
    out = np.zeros((n, len(STATISTICS)))
    out[:, 0] = count
    out[:, 1] = w.size / words
    for k in range(1, 7):
        out[:, 1 + k] = np.add.reduceat((kind == k).astype(np.int32), w.at[:-1]) / size if n else 0
    same = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
    doc = np.repeat(np.arange(n), count)
    opening = w.first[:-1][count > 0]
    same[opening] = False
    out[:, 8] = np.bincount(doc, weights=same, minlength=n) / words
    out[:, 9] = [len(np.unique(h[a:b])) for a, b in zip(w.first, w.first[1:], strict=False)] / words
    lines = np.array([x.count("\n") + 1 for x in texts])
    out[:, 10] = count / lines
    # words with a sign joined to their end, other than a stop
    tail = kind[w.end - 1] if len(h) else np.zeros(0, dtype=np.uint8)
    out[:, 11] = np.bincount(doc, weights=tail >= 4, minlength=n) / words
    out[count == 0] = 0
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the kept columns, a double for each of STATISTICS)."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in keep))
    schema = ", ".join(["doc_id long", *(f"`{c}` {dict(kept.dtypes)[c]}" for c in keep), *(f"{s} double" for s in STATISTICS)])
    kinds = {c: dict(kept.dtypes)[c] for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
        for part in chunks(batches, most=SLICE):
            m = measure(part["text"])
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), *(pa.array(part[c], types[kinds[c]]) for c in keep), *(pa.array(m[:, k]) for k in range(m.shape[1]))], names=["doc_id", *keep, *STATISTICS])

    return kept.mapInArrow(gives_back(run), schema)


def measured(docs: DataFrame, name: str = "__statistics", text_col: str = "text") -> DataFrame:
    """docs with a struct of STATISTICS; the other columns stay as they are."""

    @F.arrow_udf(", ".join(f"{s} double" for s in STATISTICS))
    def run(column: pa.Array) -> pa.Array:
        parts = [measure([x or "" for x in part.to_pylist()]) for part in slices(column, column, SLICE)]
        m = np.concatenate([np.zeros((0, len(STATISTICS))), *parts])
        return pa.StructArray.from_arrays([pa.array(m[:, k]) for k in range(m.shape[1])], names=list(STATISTICS))

    return docs.withColumn(name, run(F.col(text_col)))


Rule = tuple[tuple[str, str, float], ...]


def paths(debug: str, names: tuple[str, ...]) -> set[Rule]:
    """Every path of two ends or more from a root, as (name, comparison, threshold) conditions; conditions on one side of a statistic are merged."""
    rules, open_conditions = set(), []
    for line in debug.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            if re.match(r" *Tree ", line):
                open_conditions = []
            continue
        depth, name, sign, threshold = len(found[1]), names[int(found[2])], found[3], float(found[4])
        open_conditions = [x for x in open_conditions if x[0] < depth] + [(depth, name, sign, threshold)]
        merged: dict[tuple[str, str], float] = {}
        for _, n, s, t in open_conditions:
            merged[n, s] = (min if s == "<=" else max)(merged.get((n, s), t), t)
        rules.add(tuple(sorted((n, s, t) for (n, s), t in merged.items())))
    return rules


def condition(rule: Rule, within: str = "") -> Column:
    return reduce(lambda a, b: a & b, (F.col(within + n) <= t if s == "<=" else F.col(within + n) > t for n, s, t in rule))


class RuleEnsemble:
    """`rules` with their weights and the intercept; `score()` is the compiled column."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self, within: str = "") -> Column:
        """The score of rows with the statistics as columns, or as fields of a struct (`within` ends with a dot)."""
        z = reduce(lambda a, b: a + b, (F.when(condition(r, within), F.lit(w)).otherwise(0.0) for r, w in self.rules), F.lit(self.intercept))
        return 1 / (1 + F.exp(-z))

    @classmethod
    def fit(cls, rows: DataFrame, label: str, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
        """rows: STATISTICS and an integer label, a bounded sample; they are read several times and so are cut first."""
        from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import array_to_vector

        rows = cut(rows.select(F.col(label).cast("double").alias("label"), *STATISTICS)).coalesce(2)
        counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
        total = sum(counts.values())
        if len(counts) < 2:
            share = counts.get(1, 0) / total if total else 0.5
            share = min(max(share, 1e-6), 1 - 1e-6)
            return cls(float(np.log(share / (1 - share))), [])
        vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", subsamplingRate=0.7, minInstancesPerNode=max(5, min(50, total // 200)), seed=seed).fit(vectors)
        rules = sorted(paths(forest.toDebugString, STATISTICS), key=lambda r: (len(r), r))
        if not rules:
            share = counts[1] / total
            return cls(float(np.log(share / (1 - share))), [])
        truth = rows.select("label", array_to_vector(F.array(*(condition(r).cast("double") for r in rules))).alias("features"))
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(truth)
        return cls(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w])


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> RuleEnsemble:
    """Fits on at most train_rows labelled rows for which `usable` (over labels) holds."""
    known = labels.where(usable & F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)  # bounded by the parameter
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    return RuleEnsemble.fit(statistics(own, keep=("label",)), "label")
