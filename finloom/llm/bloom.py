"""Bloom filters of bounded size: built by Spark, held by tasks, used to thin rows before a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bits_for(n: int, least: int = 1 << 16, most: int = 1 << 26) -> int:
    """A power of two with 16 bits an entry, within bounds; 8 MB at most, whatever n is."""
    return min(most, max(least, 1 << max(0, 16 * n - 1).bit_length()))


def words(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of the column ``h`` (long); at most bits / 64 rows come to the driver."""
    at = lambda shift: F.shiftrightunsigned("h", shift).bitwiseAND(bits - 1)
    hit = hashes.select(F.explode(F.array(at(0), at(32))).alias("i")).select(
        F.shiftright("i", 6).alias("word"), F.expr("shiftleft(1L, cast(i & 63 AS int))").alias("bit")
    )
    rows = hit.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def inside(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    ok, last = np.ones(len(h), bool), np.uint64(bits - 1)
    for shift in (0, 32):
        i = (h >> np.uint64(shift)) & last
        ok &= (table[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) == 1
    return ok


def thinned(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose doc_id may be in ``ids``: all that are, and few others.

    A join still has to follow; it only has less to shuffle.
    """
    bits = bits_for(ids.count())
    table = docs.sparkSession.sparkContext.broadcast(words(ids.select(F.xxhash64("doc_id").alias("h")), bits))

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(inside(table.value, bits, h))).select(["doc_id", "text"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(keep, "doc_id long, text string")
