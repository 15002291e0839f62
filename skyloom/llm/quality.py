"""Quality scores by Bradley-Terry ranking.

Labelled documents give preference pairs (a label-1 document is preferred to a label-0 one). The
strength of a document is linear in features of its whole text; the weights minimise the logistic
loss on feature differences of the pairs. The threshold is the quantile of the training strengths
that leaves the labelled share of good documents above it, and the score is the logistic function
of the strength above that threshold, so ``score >= 0.5`` is the decision.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows (the first in an order by hash of the
id); the features of those rows are the only thing that reaches the driver. Every document is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyloom.llm.common import by_value, table, texts_of, with_columns

by_value(__name__)

TRAIN_ROWS = 6000
PAIRS_PER_ROW = 4
BINS = 8
L2 = 1e-3
SYMBOLS = "#$%&*|<>{}[]=+~^_\\/@"
DIGITS = "0123456789"
SENTENCE_END = (".", "!", "?", ":", ";")
N_FEATURES = 16


def text_features(text: str) -> list[float]:
    """Statistics of a whole text that say nothing about its language or origin."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * N_FEATURES
    size = len(text)
    counts = Counter(tokens)
    pairs = len(set(zip(tokens, tokens[1:])))
    lines = [x for x in text.split("\n") if x]
    letters = sum(map(len, tokens))
    return [
        math.log1p(n),
        len(counts) / n,
        len(counts) / math.sqrt(n),
        max(counts.values()) / n,
        pairs / max(n - 1, 1),
        letters / n,
        sum(map(text.count, SYMBOLS)) / size,
        counts["|"] / n,
        sum(map(text.count, DIGITS)) / size,
        (text.count(".") + text.count("!") + text.count("?")) / n,
        text.count(",") / n,
        sum(map(str.isupper, tokens)) / n,
        sum(map(str.istitle, tokens)) / n,
        len(set(lines)) / max(len(lines), 1),
        sum(x.endswith(SENTENCE_END) for x in lines) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)),
    ]


@dataclass
class Ranking:
    """A fitted ranking: bin edges per feature, weights, threshold; ``constant`` if nothing could be learnt."""

    edges: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    constant: float | None = None

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features followed by indicators of their quantile bins."""
        parts = [(x - self.mean) / self.spread]
        for k in range(x.shape[1]):
            parts.append(np.eye(self.edges.shape[1] + 1)[np.searchsorted(self.edges[k], x[:, k], side="right")])
        return np.hstack(parts)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(self.strength(x) - self.threshold, -500, 500)))


def fit(x: np.ndarray, label: np.ndarray) -> Ranking:
    """Bradley-Terry weights from all-label-1-over-label-0 preferences, each row in ``PAIRS_PER_ROW`` pairs or more.

    Without rows the score is 0.5 everywhere, with one label only it is that label.
    """
    blank = Ranking(np.zeros((x.shape[1], 0)), np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(0), 0.0)
    if len(x) == 0 or label.min() == label.max():
        blank.constant = 0.5 if len(x) == 0 else float(label[0])
        return blank
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    model = Ranking(np.quantile(x, inner, axis=0).T, x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(0), 0.0)
    wide = model.expand(x)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    steps = np.arange(max(len(good), len(bad)) * PAIRS_PER_ROW)
    # one walk over the good and one over the bad rows, with another offset on each lap
    first, second = good[steps % len(good)], bad[(steps + steps // max(len(good), len(bad))) % len(bad)]
    diff = wide[first] - wide[second]
    weights = np.zeros(wide.shape[1])
    for _ in range(25):  # Newton steps on the regularised logistic loss
        p = 1.0 / (1.0 + np.exp(-np.clip(diff @ weights, -30, 30)))
        gradient = diff.T @ (p - 1) / len(diff) + L2 * weights
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + L2 * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = weights
    strength = wide @ weights
    cut = len(bad)
    ranked = np.sort(strength)
    model.threshold = float((ranked[cut - 1] + ranked[cut]) / 2)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ranking:
    """Fit on at most ``rows`` labelled documents outside the held-out third.

    Null labels or ids teach nothing; of contradictory labels of one id the lowest counts; of several
    documents with one id the one whose features come first counts.
    """
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select(F.col("doc_id").alias("labelled"), "label")
    )
    # at most ``rows`` ids: a bound that does not depend on the data
    named = docs.select("doc_id", "text").alias("d")
    known = named.join(F.broadcast(sample), F.col("d.doc_id") == F.col("labelled")).select("labelled", "text", "label")
    first = _measured(known, ["labelled", "label"]).groupBy("labelled").agg(F.min(F.struct("features", "label")).alias("r"))
    got = first.orderBy("labelled").select("r.features", "r.label").toArrow()
    features = np.array(got.column("features").to_pylist(), dtype=np.float64).reshape(-1, N_FEATURES)
    return fit(features, np.array(got.column("label").to_pylist(), dtype=np.int64))


def _measured(df: DataFrame, keep: list[str]) -> DataFrame:
    def make():
        return lambda text: [[text_features(t) for t in texts_of(text)]]

    return with_columns(df, ["text"], [T.StructField("features", T.ArrayType(T.DoubleType()))], make, keep)


def scored(docs: DataFrame, model: Ranking, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) to every row; null text scores as the empty text, a column ``score`` is replaced."""

    def make():
        def compute(text):
            x = np.array([text_features(t) for t in texts_of(text)]).reshape(-1, N_FEATURES)
            return [model.score(x)]

        return compute

    return with_columns(docs, ["text"], [T.StructField("score", T.DoubleType())], make, keep)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score at least 0.5, with all their columns."""
    model = learn(docs, labels)
    columns = docs.columns
    marked = docs.withColumnRenamed("score", "own score") if "score" in columns else docs
    kept = scored(marked, model).where("score >= 0.5").drop("score")
    return kept.withColumnRenamed("own score", "score").select(*columns)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
