"""What the two trained scorers share: folds, bounded samples of labelled rows, logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo: the fold of a document.  A null doc_id is in fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


#: Bytes of text of one class that come to the driver at most.
CLASS_BYTES = 48 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: int, max_chars: int):
    """Texts and labels of a bounded sample: ([bytes], array of 0/1), in order of a hash of doc_id.

    Rows of ``labels`` outside the training folds (``fold`` false) are never read.
    About ``per_class`` documents of each class are chosen by a hash of their ids, which
    are few by that bound and so broadcast.  Of repeated rows of a doc_id, Spark keeps
    the least text; a text of more than ``max_chars`` gives a stretch of that length
    from a place that its hash sets; what is beyond CLASS_BYTES of a class, in order of
    the hash, is left out before anything is collected.
    """
    known = labels.where(fold & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return [], np.zeros(0, int)
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.when(F.col("y") == 1, int(1e6 * per_class / counts[1]) + 1).otherwise(int(1e6 * per_class / counts[0]) + 1)
    chosen = known.where(rank < share)
    spare = F.greatest(F.length("text") - max_chars, F.lit(0))
    start = F.pmod(F.xxhash64("text"), spare + 1).cast("int")
    rows = (
        docs.where("text IS NOT NULL")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "y", F.substr("text", start + 1, F.lit(max_chars)).alias("text"))
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
        .withColumn("order", F.xxhash64("doc_id", F.lit("order")))
    )
    # two windows of some thousand rows each, by the bound above
    upto = Window.partitionBy("y").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(upto)).where(F.col("bytes") <= CLASS_BYTES)
    held = bounded.select("order", "doc_id", F.col("text").cast("binary").alias("text"), "y").toPandas().sort_values(["order", "doc_id"])
    return [bytes(t) for t in held["text"]], held["y"].to_numpy(int)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50):
    """(mean, scale, weights) of a logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    ridge = np.eye(z.shape[1]) * l2 * len(x)
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return mean, scale, w


def probability(model, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -30, 30)))
