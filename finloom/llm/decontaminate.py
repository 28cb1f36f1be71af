"""Operator 10: benchmark decontamination by MinHash containment, size by size.

A benchmark item is in a document if at least ``percent`` of its k-word shingles
are.  Items are partitioned by size (powers of two of their shingle count); each is
represented by the shingles that are least under ``minima`` hash functions, or by all
of them in partitions of up to that many.  A document that holds 80 % of an item
misses all 24 minima with a chance of 1e-17.  Documents keep all their shingles, as
the one-sided estimate asks for, and so any length of document works.

Documents are read once.  Their shingles pass a Bloom filter of fixed size (``bits``)
of all items' shingles; what passes is staged, joined with the signatures, and the
candidates are verified by counting the item's shingles in the document.  Only the
filter's words go through the driver, 2 MB at most whatever the benchmark's size.

Defined cases: null or empty items and documents match nothing; items of fewer than
k words are one shingle of all their words; repeated items and rows with a doc_id in
common count once; a null doc_id is never reported; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm import bloom
from finloom.llm.common import Staging, read

K, PERCENT, MINIMA, BITS = 5, 80, 24, 1 << 24


def item_signer(k: int, minima: int):
    """Function on Arrow batches of (item_id, text): a row per shingle, marked if in the signature."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        from finloom.llm import hashing as H

        rng = np.random.default_rng(7)
        a = rng.integers(1, 2**63, minima, np.uint64) | np.uint64(1)
        b = rng.integers(0, 2**63, minima, np.uint64)
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), H.texts(batch.column("text")), strict=True):
                s = H.shingles(text, k)
                if item is None or not len(s):
                    continue
                width = min(k, len(text.split()))
                size = 1 << (len(s) - 1).bit_length()
                chosen = np.ones(len(s), bool)
                if size > minima:
                    chosen[:] = False
                    with np.errstate(over="ignore"):
                        chosen[(np.multiply.outer(s, a) + b).argmin(axis=0)] = True
                n = len(s)
                yield pa.record_batch(
                    [pa.array([item] * n, pa.int64()), pa.array(H.signed(s)), pa.array(chosen), pa.array([n] * n, pa.int64()),
                     pa.array([size] * n, pa.int64()), pa.array([width] * n, pa.int32())],
                    names=["item_id", "h", "chosen", "n", "size", "width"],
                )

    return sign


def prober(words, bits: int, widths: list[int]):
    """Function on Arrow batches of (doc_id, text): distinct shingles that pass the filter."""

    def probe(batches):
        import numpy as np
        import pyarrow as pa

        from finloom.llm import hashing as H

        for batch in batches:
            ids, hs = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), H.texts(batch.column("text")), strict=True):
                h = H.word_hashes(text)
                for k in widths if doc is not None else ():
                    w = H.windows(h, k) if len(h) >= k else h[:0]
                    if len(got := np.unique(w[bloom.inside(words.value, bits, w)])):
                        ids.append(np.full(len(got), doc, np.int64))
                        hs.append(H.signed(got))
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(hs))], names=["doc_id", "h"])

    return probe


def contaminated(docs: DataFrame, benchmark: DataFrame, k=K, percent=PERCENT, minima=MINIMA, bits=BITS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: one row per document and item that it holds."""
    spark = docs.sparkSession
    tables = Staging(spark, "decontaminate")
    schema = "item_id long, h long, chosen boolean, n long, size long, width int"
    items = tables.put(
        benchmark.select("item_id", "text").mapInArrow(item_signer(k, minima), schema).distinct(), "items"
    )
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most k rows
    words = spark.sparkContext.broadcast(bloom.words(items, bits))
    hits = tables.put(
        docs.select("doc_id", "text").mapInArrow(prober(words, bits, widths), "doc_id long, h long").distinct(), "hits"
    )
    # the least size of a partition bounds what a document has to hold
    per_doc = hits.groupBy("doc_id").agg(F.count("*").alias("held"))
    signature = items.where("chosen").select("h", "item_id", "size")
    candidates = tables.put(hits.join(signature, "h").select("doc_id", "item_id", "size").distinct(), "candidates")
    able = candidates.join(per_doc, "doc_id").where(F.col("held") * 100 >= percent * F.floor(F.col("size") / 2 + 1).cast("long"))
    shared = (
        able.select("doc_id", "item_id")
        .join(hits, "doc_id")
        .join(items.select("item_id", "h", "n"), ["item_id", "h"])
        .groupBy("doc_id", "item_id")
        .agg(F.count_distinct("h").alias("n_shared"), F.max("n").alias("n_item"))
    )
    return shared.where(100 * F.col("n_shared") >= percent * F.col("n_item")).select("doc_id", "item_id", "n_shared", "n_item")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), s AS (
  SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM w
), i AS (
  SELECT DISTINCT id AS item_id, least(len(ws), 5) AS width, array_to_string(list_slice(ws, p, p + least(len(ws), 5) - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS p FROM s WHERE kind = 'i' AND len(ws) > 0)
), d AS (
  SELECT DISTINCT id AS doc_id, k AS width, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS g
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM s, (SELECT DISTINCT width AS k FROM i) WHERE kind = 'd' AND len(ws) >= k)
), n AS (
  SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id
)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM d JOIN i USING (width, g) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
