"""Operator 7: conflict-constrained best-fit packing of documents into token bins.

Documents longer than ``capacity`` words are cut into full bins and a rest.  Rests
are packed longest first: bins are kept in order of their residual, and the search
goes from the least residual that is large enough to ever larger ones, until a bin
has neither the document's source nor its duplicate cluster in its bitmaps.

The query's clusters are the groups of near copies that operator 4 finds at five words
and 80 %; ``pack`` alone, as in the pipeline after near-dedup, takes equal words.

Documents are dealt to shards of about ``shard_rows`` by a hash of their id, so a
source or cluster of any size is spread evenly; a task holds one shard at a time.

Defined cases: null or empty text has no words and is put in a bin all the same;
null sources and empty texts conflict with nothing; documents with null doc_id are
dealt by their text; ties go by doc_id; repeated rows are packed each, in
different bins; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm.common import ascii_lower, let, read, words
from finloom.llm.neardup import near_duplicates

CAPACITY, SHARD_ROWS = 2048, 4096
PACKED = "bin_id long, position int, doc_id long, piece int, start_word long, n_words long"


class Bins:
    """Open bins in order of residual, with bitmaps of the sources and clusters in them."""

    def __init__(self, capacity: int):
        self.capacity, self.order = capacity, []
        self.sources, self.clusters, self.filled = [], [], []
        self.bits: dict = {}

    def bit(self, kind: str, value) -> int:
        return 0 if value is None else 1 << self.bits.setdefault((kind, value), len(self.bits))

    def open(self, n: int, source: int = 0, cluster: int = 0) -> tuple[int, int]:
        """A new bin with n words in it."""
        b = len(self.sources)
        self.sources.append(source)
        self.clusters.append(cluster)
        self.filled.append(1)
        insort(self.order, (self.capacity - n, b))
        return b, 0

    def place(self, n: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, position) of the tightest compatible bin, a new one if there is none."""
        for at in range(bisect_left(self.order, (n, -1)), len(self.order)):
            room, b = self.order[at]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.order[at]
                insort(self.order, (room - n, b))
                self.sources[b] |= source
                self.clusters[b] |= cluster
                self.filled[b] += 1
                return b, self.filled[b] - 1
        return self.open(n, source, cluster)


def pack_shard(rows: list[tuple], capacity: int):
    """(bin, position, doc_id, piece, start, n) for rows (doc_id, n, source, cluster)."""
    bins, rests = Bins(capacity), []
    for doc, n, source, cluster in rows:
        full = max(0, (n - 1) // capacity)
        for piece in range(full):
            yield *bins.open(capacity), doc, piece, piece * capacity, capacity
        rests.append((n - full * capacity, doc, full, source, cluster))
    repeated = {c for c, k in Counter(r[4] for r in rests).items() if k > 1 and c is not None}
    for n, doc, piece, source, cluster in sorted(rests, key=lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2])):
        marks = bins.bit("source", source), bins.bit("cluster", cluster if cluster in repeated else None)
        yield *bins.place(n, *marks), doc, piece, piece * capacity, n


def packer(capacity: int):
    """Function on Arrow batches sorted by shard."""

    def pack(batches):
        import pyarrow as pa

        def done(shard, rows):
            out = list(pack_shard(rows, capacity))
            cols = list(zip(*out, strict=True))
            ids = [(shard << 24) + b for b in cols[0]]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.record_batch(
                [pa.array(c, t) for c, t in zip([ids, *cols[1:]], kinds, strict=True)],
                names=["bin_id", "position", "doc_id", "piece", "start_word", "n_words"],
            )

        shard, rows = None, []
        for batch in batches:
            for now, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "source", "cluster")), strict=True):
                if now != shard and rows:
                    yield done(shard, rows)
                    rows = []
                shard = now
                rows.append(tuple(row))
        if rows:
            yield done(shard, rows)

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster: str | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """One row per piece of a document: see PACKED.

    ``cluster`` names a column of duplicate clusters; by default documents of equal
    words, A-Z lower-cased, are a cluster.  ``clusters`` (key, near) gives clusters by
    ``key_of`` instead, for documents that have words.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    equal = let(words(ascii_lower(F.col("text"))), lambda w: F.when(F.size(w) > 0, F.xxhash64(F.array_join(w, " "))))
    sized = docs.select(
        "doc_id",
        F.size(words(F.col("text"))).cast("long").alias("n"),
        F.col("source").cast("string").alias("source"),
        (F.col(cluster).cast("long") if cluster else equal if clusters is None else F.lit(None).cast("long")).alias("cluster"),
        F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(shards)).cast("long").alias("shard"),
        *([key_of().alias("key")] if clusters is not None else []),
    )
    if clusters is not None:
        near = F.when(F.col("n") > 0, F.col("near"))
        sized = sized.join(clusters, "key", "left").select("doc_id", "n", "source", near.alias("cluster"), "shard")
    return sized.repartition("shard").sortWithinPartitions("shard").mapInArrow(packer(capacity), PACKED)


def key_of() -> Column:
    """doc_id, and a hash of the text where there is none, so that such documents have clusters too."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def near_clusters(docs: DataFrame) -> DataFrame:
    """key, near: the group of near copies (operator 4, five words and 80 %) of every document."""
    found = near_duplicates(docs.select(key_of().alias("doc_id"), "text"))
    return found.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("near"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pack(docs, clusters=near_clusters(docs))
