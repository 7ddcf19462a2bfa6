"""Quality by ordinal cumulative-link regression on graded ratings: one weight for each hashed feature of a text, shared by all grades,
and ordered thresholds between grades. P(grade > k) = sigmoid(score - threshold k)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, least_hashed, mix
from .tokens import parts, two

#: Words part at ASCII characters that are no letters or digits; marks are the runs of such characters but blanks.
WORDS = [c for c in range(128) if not chr(c).isalnum()]
MARKS = [c for c in range(256) if c >= 128 or chr(c).isalnum() or c <= 32]
BITS = 20
#: Bytes of a word's beginning that make a feature of their own, so that forms of one stem share weight.
STEM = 6


class Features:
    """Distinct hashed words, word beginnings and marks, and classes of length, repetition, and of how frequent marks and capitals are."""

    def __init__(self):
        self.words, self.marks = WordHasher(WORDS), WordHasher(MARKS)
        self.lower = np.arange(256, dtype=np.uint64)
        self.lower[65:91] += 32

    def __call__(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, np.uint8)
        (words, starts, ends), marks = self.words(data), self.marks(data)[0]
        starts, stems = starts[ends - starts > STEM], np.uint64(0)
        for k in range(STEM if len(starts) else 0):
            stems = stems * np.uint64(256) + self.lower[raw[starts + k]]
        distinct = np.unique(words)
        share = lambda a, b: int(8 * min(1, a / max(1, b)))
        upper, again = int(((raw >= 65) & (raw <= 90)).sum()), int((words[1:] == words[:-1]).sum())
        classes = [1000 + share(upper, len(raw)), 2000 + share(len(marks), len(words)), 3000 + share(again, len(words)), 4000 + share(len(distinct), len(words)), 5000 + len(words).bit_length(), 6000]
        parts = [distinct, marks + np.uint64(1), mix(np.array(classes, np.uint64)), mix(stems + np.uint64(7)) if len(starts) else marks[:0]]
        return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


class Ordinal:
    """Weights of the features that have one, and thresholds."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def score(self, x: np.ndarray) -> float:
        if not len(self.features) or not len(x):
            return 0.0
        k = np.minimum(np.searchsorted(self.features, x), len(self.features) - 1)
        return float(self.weights[k[self.features[k] == x]].sum())

    def tails(self, score: float) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def ordered(start: float, steps: np.ndarray) -> np.ndarray:
    """Thresholds: the first one, and each next one exp(step) above the one before, so that any parameters give an order."""
    return start + np.concatenate(([0.0], np.cumsum(np.exp(steps))))


def likelihood(score: float, grade: int, theta: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Negative log-likelihood of a grade, and its derivatives by the score and the thresholds.

    P(grade = k) = F(k) - F(k - 1) with F(k) = sigmoid(theta[k] - score); F is 0 before the first and 1 after the last threshold. Only the
    two thresholds around the grade count. The derivative by the score is P(> k) + P(> k - 1) - 1.
    """
    sigmoid = lambda x: 0.5 + 0.5 * math.tanh(x / 2)
    high = theta[grade] - score if grade < len(theta) else math.inf
    low = theta[grade - 1] - score if grade else -math.inf
    over, under, slope = (0.0 if grade == len(theta) else sigmoid(-high)), (sigmoid(low) if grade else 0.0), np.zeros(len(theta))
    # F(high) - F(low) = sigmoid(high) * sigmoid(-low) * (1 - exp(low - high)), without a difference of nearly equal numbers.
    apart = -math.expm1(low - high) if grade and grade < len(theta) else 1.0
    if grade < len(theta):
        slope[grade] = -over / max(1e-12, (1 - under) * apart)
    if grade:
        slope[grade - 1] = under / max(1e-12, (1 - over) * apart)
    softplus = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    loss = (softplus(-high) if grade < len(theta) else 0.0) + (softplus(low) if grade else 0.0) - math.log(max(1e-300, apart))
    return loss, over - under, slope


def fit(rows: list[np.ndarray], grades: np.ndarray, grade_count: int, rounds: int = 8, rate: float = 0.2, l1: float = 5e-3, common: int = 5, seed: int = 11) -> Ordinal:
    """Maximum likelihood of the cumulative-link model by stochastic gradients with a rate for each parameter (AdaGrad) and soft thresholding
    of the weights. Features of fewer than `common` rows get no weight, since they tell one text rather than a kind of text."""
    used = np.bincount(np.concatenate(rows), minlength=1 << BITS) >= common if rows else np.zeros(1 << BITS, bool)
    rows = [x[used[x]] for x in rows]
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    start, steps, p2 = -0.5 * (grade_count - 2), np.zeros(max(0, grade_count - 2)), np.ones(grade_count - 1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            x = rows[k]
            _, by_score, by_theta = likelihood(float(w[x].sum()), int(grades[k]), ordered(start, steps))
            g = by_score / math.sqrt(max(1, len(x)))
            g2[x] += g * g
            step = rate / np.sqrt(g2[x])
            new = w[x] - step * g
            w[x] = np.sign(new) * np.maximum(0, np.abs(new) - step * l1)
            # A step moves all thresholds from its own on.
            after = np.cumsum(by_theta[::-1])[::-1]
            by = np.concatenate((after[:1], np.exp(steps) * after[1:]))
            p2 += by * by
            move = rate * by / np.sqrt(p2)
            start, steps = start - move[0], np.clip(steps - move[1:], -6, 6)
    some = np.flatnonzero(w)
    return Ordinal(some, w[some], ordered(start, steps))


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grades 0 (toxic), 1 (not toxic, poor) and 2 (not toxic, good); null where a label is."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(toxic).isNull() | F.col(quality).isNull(), None).when(F.col(quality) == 0, 1).otherwise(2)


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Fit on `sample` rated documents at most, those of least hash. ratings: doc_id and grade (0 to grades - 1); of several ratings of
    a document the least counts, and null ids and grades don't; of several rows with a rated id the least text is learned. Without any, all
    thresholds are even and all weights zero."""
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = least_hashed(rated, sample, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t).astype(np.int32) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "grade", "x"])

    # The sample is bounded by its parameter, and so is what is broadcast.
    found = two(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text")).mapInArrow(run, "doc_id long, grade int, x array<int>")
    rows = sorted(((r.doc_id, r.grade, np.array(r.x, np.int64)) for r in found.toLocalIterator()), key=lambda r: (r[0], r[1], r[2].tolist()))
    return fit([x for _, _, x in rows], np.array([g for _, g, _ in rows]), grades)


def rate(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade and tail (probability of the highest grade) of each row, from its whole text.

    Null and empty texts are rated by the thresholds and the class features alone. Repeated rows and null ids each give a row. Columns
    other than the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for ids, texts in parts(batches):
            tails = [model.tails(model.score(features(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([float(x.sum()) for x in tails], pa.float64()), pa.array([float(x[-1]) if len(x) else 0.0 for x in tails], pa.float64())], names=["doc_id", "expected_grade", "tail"])

    return two(docs, id_col, text_col).mapInArrow(run, "doc_id long, expected_grade double, tail double")


def select(rated: DataFrame, least: float = 0.5) -> DataFrame:
    """Rated rows whose tail probability is at least `least`."""
    return rated.where(F.col("tail") >= least)
