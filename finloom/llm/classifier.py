"""Operator 8: a quality classifier of naive Bayes support vectors.

Features are indicators of character n-grams over the shape of the text (letters,
capitals, digits and white space as classes, other characters as they are), hashed
into ``BUCKETS``, and of how words repeat.  Indicators are scaled by the log-count
ratio of the classes and brought to unit length; a linear hinge-loss model is fitted
to them by dual coordinate descent, and its margin calibrated by a logistic curve on
training rows that it hasn't seen.

Fitting is bounded: about ``per_class`` rows of each class, of ``max_chars`` each.
Scoring reads every whole text in one pass without shuffle.

Defined cases: null and empty texts have no n-grams and are scored like any text;
without labels of both classes every score is 0; rows with null doc_id are scored
and not held out; repeated rows get equal scores; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm import fitting
from finloom.llm.common import read

BUCKETS, GRAMS, PER_CLASS, MAX_CHARS = 1 << 16, (2, 3, 5), 2500, 65536
HELD_OUT, THRESHOLD, COST, EPOCHS = 4, 0.7, 1.0, 30
#: Last buckets, for repetition.
REPEATS = 32


def _shapes() -> bytes:
    table = bytearray(range(256))
    for i in range(256):
        c = chr(i)
        table[i] = ord("a" if i > 127 or "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else " " if c in "\t\v\f\r" else c)
    return bytes(table)


_SHAPES = _shapes()


def features(text: bytes | None) -> np.ndarray:
    """Sorted indices of the indicators that are set."""
    text = text or b""
    shape = np.frombuffer(text.translate(_SHAPES), np.uint8).astype(np.uint32)
    on = np.zeros(BUCKETS + REPEATS, bool)
    for n in GRAMS:
        if len(shape) >= n:
            h = np.full(len(shape) - n + 1, n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + shape[k : len(shape) - n + 1 + k]
            on[(h * np.uint32(0x9E3779B1)) >> np.uint32(16)] = True
    words = text.split()
    if words:
        adjacent = sum(map(eq, words, words[1:])) / len(words)
        distinct = len(set(words)) / len(words)
        on[BUCKETS + min(9, int(10 * adjacent))] = True
        on[BUCKETS + 10 + min(9, int(10 * distinct))] = True
    on[BUCKETS + 20 + min(11, len(words).bit_length())] = True
    return np.flatnonzero(on)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    ratio: np.ndarray
    curve: tuple | None

    def margin(self, text: bytes | None) -> float:
        i = features(text)
        r = self.ratio[i]
        return float(self.weights[i] @ r / max(1e-12, np.sqrt(r @ r)) + self.bias)

    def scores(self, texts) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        return fitting.probability(self.curve, np.array([self.margin(t) for t in texts], float).reshape(-1, 1))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float, epochs: int) -> np.ndarray:
    """Weights (bias last) of the L2-regularised hinge loss by dual coordinate descent; rows have unit length and a 1 for the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            gradient = y[i] * (w[at] @ x + w[-1]) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost)
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def fit(texts: list[bytes], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> Model:
    size = BUCKETS + REPEATS
    if len(set(y)) < 2:
        return Model(np.zeros(size), 0.0, np.ones(size), None)
    found = [features(t) for t in texts]
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    fitted = np.flatnonzero(~held)
    counts = np.ones((2, size))
    for i in fitted:
        counts[y[i], found[i]] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    rows = []
    for i in fitted:
        x = ratio[found[i]]
        rows.append((found[i], x / max(1e-12, np.sqrt(x @ x))))
    w = descend(rows, np.where(y[fitted] == 1, 1.0, -1.0), size, cost, epochs)
    model = Model(w[:-1], float(w[-1]), ratio, None)
    seen = np.flatnonzero(held) if held.any() else fitted
    margins = np.array([model.margin(texts[i]) for i in seen]).reshape(-1, 1)
    model.curve = fitting.logistic(margins, y[seen].astype(float), l2=1e-3)
    return model


def scorer(model: Model):
    """Function on Arrow batches of (doc_id, text): scores."""

    def score(batches):
        import pyarrow as pa

        from finloom.llm import hashing as H

        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.scores(H.texts(batch.column("text"))), pa.float64())], names=["doc_id", "score"])

    return score


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    fold = fitting.remainder(HELD_OUT)
    model = fit(*fitting.sample(docs, labels.select("doc_id", "quality"), "quality", fold != 2, per_class, max_chars))
    scored = docs.mapInArrow(scorer(model), "doc_id long, score double")
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
