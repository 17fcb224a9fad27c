"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels.

A document is toxic if any of its sentences is: P(doc) = 1 - prod(1 - p(sentence)), where p is a logistic score over the sentence's distinct
words, each of which stands for itself and for its beginnings (so that inflected forms share what is learnt).
Only documents carry labels; the gradient of the noisy-or tells the sentences apart, and scoring returns the offending ones with
their places in the text.

The labelled rows are a sample of at most `train_rows`, the lowest by a hash of their id, and the vocabulary the `vocabulary` words that
differ most between its two labels, so neither follows the corpus. Scores never see ids, languages, sources or labels. A null text is scored as an
empty one (one empty sentence); null or missing labels don't train; with no labelled rows, or only one label, every score is the share of
label 1 (0.5 with none). Repeated rows are scored one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut
from .wordcache import ChunkCache

_ENDS = bytes(10 if chr(b) in ".!?\n" else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def sentences(text: str) -> list[bytes]:
    """The text's sentences as bytes in lower case, with signs as spaces; joined by one byte they have the text's length."""
    return text.encode().lower().translate(_ENDS).split(b"\n")


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings of 4 to 8 bytes, marked."""
    return [word] + [b"^" + word[:k] for k in range(4, min(8, len(word)) + 1)]


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]

    def __post_init__(self) -> None:
        self.words = ChunkCache(lambda new: [sum(self.weights.get(f, 0.0) for f in features(w)) for w in new])

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) in bytes of each sentence at 0.5 or more."""
        parts = sentences(text)
        own_words = [set(p.split()) for p in parts]
        every = set().union(*own_words)
        weights = self.words.get(every)
        known = {w for w in every if weights[w]}
        plain = 1 / (1 + np.exp(-self.bias))
        filled = sum(map(bool, own_words)) or 1
        if not known:
            return float(1 - (1 - plain) ** filled), []
        left, found, at = 1.0, [], 0
        for p, words in zip(parts, own_words, strict=True):
            own = known & words
            if own:
                s = 1 / (1 + np.exp(-(self.bias + sum(weights[w] for w in own))))
                left *= 1 - s
                if s >= 0.5:
                    found.append((at, at + len(p), float(s)))
            elif words:
                left *= 1 - plain
            at += len(p) + 1
        return float(1 - left), found


def fit(bags: list[list[list[int]]], labels: np.ndarray, size: int, steps: int = 400, rate: float = 0.1, penalty: float = 2e-4) -> tuple[float, np.ndarray]:
    """Bias and weights that maximise the noisy-or likelihood; bags: per document, per sentence, its vocabulary indexes. Adam with an L1 penalty."""
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag], dtype=np.int64)
    row = np.array([r for r, s in enumerate(s for bag in bags for s in bag) for _ in s], dtype=np.int64)
    word = np.array([w for bag in bags for s in bag for w in s], dtype=np.int64)
    y, n = labels.astype(float), len(bags)
    theta = np.zeros(size + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(row, weights=theta[word], minlength=len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        safe = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n))
        q = np.clip(1 - safe, 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p * (1 - y / q) of its document
        g = p * (1 - y / q)[doc] / n
        grad = np.concatenate([np.bincount(word, weights=g[row], minlength=size), [g.sum()]])
        grad[:-1] += penalty * np.sign(theta[:-1])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, train_rows: int = 12_000, vocabulary: int = 2_000, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Model:
    known = labels.where(usable & F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)  # bounded by the parameter
    own = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("label", "text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sets = [{f for s in sentences(x) for w in s.split() for f in features(w)} for x in part["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, s in zip(part["label"], sets, strict=True) for _ in s], pa.int32()), pa.array([w for s in sets for w in s], pa.binary())], names=["label", "word"])

    totals = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        share = min(max(n1 / (n1 + n0), 1e-6), 1 - 1e-6) if n1 + n0 else 0.5
        return Model(float(np.log(share / (1 - share))), {})
    both = own.mapInArrow(words, "label int, word binary").groupBy("word").agg(F.sum("label").alias("in1"), F.count("*").alias("n"))
    in0 = F.col("n") - F.col("in1")
    gap = F.abs(F.log((F.col("in1") + 0.5) / (n1 + 1)) - F.log((in0 + 0.5) / (n0 + 1))) * F.sqrt("n")
    chosen = [bytes(r["word"]) for r in both.where(F.col("n") >= least_docs).orderBy(gap.desc(), "word").limit(vocabulary).select("word").collect()]
    index = {w: i for i, w in enumerate(chosen)}

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            bags = [[sorted(index[f] for w in set(s.split()) for f in features(w) if f in index) for s in sentences(x) if s.strip()] or [[]] for x in part["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(part["label"], pa.int32()), pa.array(bags, pa.list_(pa.list_(pa.int32())))], names=["label", "bag"])

    rows = own.mapInArrow(instances, "label int, bag array<array<int>>").toArrow()  # at most train_rows
    rows = sorted(zip(rows.column("bag").to_pylist(), rows.column("label").to_pylist(), strict=True), key=lambda r: (r[1], r[0]))
    bias, weights = fit([b for b, _ in rows], np.array([y for _, y in rows]), len(chosen))
    return Model(bias, {w: float(x) for w, x in zip(chosen, weights, strict=True)})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, offending): offending has the (start, end, score) of the sentences at 0.5 or more, in code points, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for part in chunks(batches):
            scores, spans = [], []
            for text in part["text"]:
                s, found = model.score(text)
                if found and not text.isascii():
                    raw = text.encode()
                    found = [(len(raw[:a].decode()), len(raw[:b].decode()), x) for a, b, x in found]
                scores.append(s)
                spans.append([{"start": a, "end": b, "score": x} for a, b, x in found])
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "offending"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>")
