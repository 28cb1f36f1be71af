"""Operator 4: near-duplicate documents by MinHash, verified on full shingle sets.

1. One pass over the texts gives per document the size and a 128-bit sum of its set
   of k-word shingles, band keys of its MinHash signature, and one byte of each minimum.
2. Documents with equal sets form a class, which its least doc_id represents.
3. Representatives that share a band key are candidates.  First every one is compared
   with the least of its bucket only; verified links give components.  Buckets that
   still hold several components are then compared in full, in cells of two blocks of
   bounded size: by their minima first, then what is alike by whole sets.  Pairs that
   are in one component already are passed over, as they can't change the result; a
   cell gives only the links that join its components, never its pairs.
4. Verified links of both passes give the components; classes give them to documents.

Shingles are 64-bit hashes.  A pair at the threshold misses all bands with a chance
of 1e-6 (85 %) or 4e-6 (80 %); every other link is found, whatever the bucket's size.

Defined cases: null and empty texts have no shingles and link with nothing; with
fewer than k words the whole sequence is one shingle; rows that share a doc_id are one node, and
rows with null doc_id have null component and aren't kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm.bloom import thinned
from finloom.llm.common import Staging, read
from finloom.llm.components import components


@dataclass(frozen=True)
class Spec:
    """k-word shingles, Jaccard similarity of ``percent`` or more, ``bands`` x ``rows`` minima."""

    k: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    block: int = 256

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def alike(self) -> int:
        """Least equal minima of a link, six standard deviations below what is expected."""
        p = self.percent / 100
        return int(self.minima * p - 6 * (self.minima * p * (1 - p)) ** 0.5)


#: Of the op4 contract: three words, 85 %.
CONTRACT = Spec(k=3, percent=85, bands=24, rows=5)

#: Shingles that are hashed at once.
STEP = 512

SIGNED = "doc_id long, n long, f1 long, f2 long, bands array<long>, sig binary"


def signer(spec: Spec):
    """Function on Arrow batches of (doc_id, text): see SIGNED."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        from finloom.llm import hashing as H

        rng = np.random.default_rng(20240229)
        a = rng.integers(0, 2**32, spec.minima, np.uint32) | np.uint32(1)
        b = rng.integers(0, 2**32, spec.minima, np.uint32)
        band = np.arange(spec.bands, dtype=np.uint64)
        room = np.empty((STEP, spec.minima), np.uint32)

        def minima(s):
            """Least value of every hash a * x + b (mod 2^32) over the shingles."""
            x = (s >> np.uint64(32)).astype(np.uint32)
            least = np.full(spec.minima, np.iinfo(np.uint32).max, np.uint32)
            for i in range(0, len(x), STEP):
                part = x[i : i + STEP]
                out = room[: len(part)]
                np.multiply.outer(part, a, out=out)
                out += b
                np.minimum(least, out.min(axis=0), out=least)
            return least.astype(np.uint64)

        def one(text):
            s = H.shingles(text, spec.k)
            if not len(s):
                return 0, 0, 0, None, None
            with np.errstate(over="ignore"):
                least = minima(s)
                rows = H.mix(least).reshape(spec.bands, spec.rows)
                keys = band + np.uint64(1)
                for r in range(spec.rows):
                    keys = H.mix(keys * H.GOLDEN + rows[:, r])
                f1, f2 = s.sum(dtype=np.uint64), H.mix(s).sum(dtype=np.uint64)
            return len(s), int(f1.view(np.int64)), int(f2.view(np.int64)), H.signed(keys), rows.reshape(-1).astype(np.uint8).tobytes()

        for batch in batches:
            ids, out = batch.column("doc_id"), [one(t) for t in H.texts(batch.column("text"))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch(
                [ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())],
                names=["doc_id", "n", "f1", "f2", "bands", "sig"],
            )

    return sign


def verifier(spec: Spec):
    """Function on Arrow batches of (a, b, text_a, text_b): the pairs (a, b) that are links."""

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        from finloom.llm import hashing as H

        last, held = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(H.texts(batch.column("text_a")), H.texts(batch.column("text_b")), strict=True)):
                if x != last:
                    last, held = x, H.shingles(x, spec.k)
                other = H.shingles(y, spec.k)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep[i] = both and 100 * both >= spec.percent * (len(held) + len(other) - both)
            mask = pa.array(keep)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(mask)

    return verify


def runs(batches, keys: tuple[str, ...], columns):
    """Groups of equal ``keys`` in sorted Arrow batches: (key tuple, list of arrays from ``columns(batch)``)."""
    import numpy as np

    cell, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cols = columns(batch)
        cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now, part = tuple(at[:, lo]), [c[lo:hi] for c in cols]
            if now == cell:
                held = [np.concatenate(x) for x in zip(held, part, strict=True)]
            else:
                if held is not None:
                    yield cell, held
                cell, held = now, part
    if held is not None:
        yield cell, held


CELL = ("key", "ci", "cj")


def comparer(spec: Spec):
    """Function on Arrow batches sorted by cell: members that have an alike partner of another component.

    A pair counts only in the bucket of the first band that it shares, so that no
    pair is looked at twice; at most one row per member of the cell comes out.
    """

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def columns(batch):
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, spec.minima)
            bands = batch.column("bands").flatten().to_numpy().reshape(-1, spec.bands)
            return [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "component", "n", "side")] + [sig, bands]

        for (key, ci, cj), (ids, comps, sizes, side, sig, bands) in runs(batches, CELL, columns):
            flagged = np.zeros(len(ids), bool)
            for i in range(len(ids) - 1):
                ok = (comps[i + 1 :] != comps[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 2))
                ok &= 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= spec.percent * np.maximum(sizes[i + 1 :], sizes[i])
                j = np.flatnonzero(ok) + i + 1
                if len(j):
                    j = j[(sig[j] == sig[i]).sum(axis=1) >= spec.alike]
                if len(j):
                    j = j[bands[i][(bands[j] == bands[i]).argmax(axis=1)] == key]
                if len(j):
                    flagged[i] = flagged[j] = True
            if flagged.any():
                n = int(flagged.sum())
                yield pa.record_batch(
                    [pa.array([key] * n, pa.int64()), pa.array([ci] * n, pa.int32()), pa.array([cj] * n, pa.int32()),
                     pa.array(ids[flagged]), pa.array(comps[flagged])],
                    names=[*CELL, "doc_id", "component"],
                )

    return compare


def linker(spec: Spec):
    """Function on Arrow batches sorted by cell, with texts: links by whole sets that join components of the cell."""

    def link(batches):
        import numpy as np
        import pyarrow as pa

        from finloom.llm import hashing as H

        def columns(batch):
            sets = np.empty(batch.num_rows, object)
            for i, t in enumerate(H.texts(batch.column("text"))):
                sets[i] = H.shingles(t, spec.k)
            return [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "component")] + [sets]

        for _, group in runs(batches, CELL, columns):
            sizes = np.array([len(s) for s in group[2]])
            (ids, comps, sets), sizes = (c[sizes > 0] for c in group), sizes[sizes > 0]
            if len(ids) < 2:
                continue
            vocabulary, which = np.unique(np.concatenate(list(sets)), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            comps, a, b = comps.copy(), [], []
            mark = np.zeros(len(vocabulary), np.int32)
            for i in range(len(ids) - 1):
                if (comps[i + 1 :] == comps[i]).all():
                    continue
                own = which[starts[i] : starts[i] + sizes[i]]
                mark[own] = 1
                both = np.add.reduceat(mark[which], starts)
                mark[own] = 0
                linked = 100 * both >= spec.percent * (sizes + sizes[i] - both)
                for j in np.flatnonzero(linked & (comps != comps[i])):
                    if comps[j] != comps[i]:
                        a.append(ids[i])
                        b.append(ids[j])
                        comps[comps == comps[j]] = comps[i]
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def verified(pairs: DataFrame, docs: DataFrame, spec: Spec) -> DataFrame:
    """The pairs (a, b), a staged table, that are links by their whole texts."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    one = thinned(docs.where("doc_id IS NOT NULL"), ids)
    with_b = pairs.join(one.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(one.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(verifier(spec), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    tables = Staging(docs.sparkSession, "neardup")
    signed = tables.put(docs.mapInArrow(signer(spec), SIGNED), "signed")
    shape = ["n", "f1", "f2"]
    known = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = tables.put(known.groupBy(*shape).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    reps = tables.put(
        known.join(classes.select(F.col("rep").alias("doc_id"), *shape), ["doc_id", *shape], "left_semi")
        .dropDuplicates(["doc_id", *shape]),
        "reps",
    )
    members = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = tables.put(
        members.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1"), "buckets"
    )
    # first pass: every member with the least of its bucket
    shared = tables.put(members.join(buckets, "key"), "shared")
    star = shared.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    pairs = tables.put(star.where("a <> b").distinct(), "pairs")
    links = tables.put(verified(pairs, docs, spec), "links")
    tables.drop(pairs)
    first = tables.put(components(links, tables), "first")
    # second pass: buckets with several components, in blocks
    owned = tables.put(
        shared.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("key", "size", "doc_id", F.coalesce("component", "doc_id").alias("component")),
        "owned",
    )
    mixed = tables.put(
        owned.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo < hi").select("key"),
        "mixed",
    )
    left = owned.join(mixed, "key")
    m = F.ceil(F.col("size") / F.lit(spec.block)).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), m).cast("int")
    cells = (
        left.join(reps.select("doc_id", "n", "sig", "bands"), "doc_id")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), m - 1)))
        .select(
            "key", F.least("mine", "other").alias("ci"), F.greatest("mine", "other").alias("cj"), "doc_id", "component", "n", "sig", "bands",
            F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    in_cells = lambda df: df.repartition(*CELL).sortWithinPartitions(*CELL)
    alike = tables.put(
        in_cells(cells).mapInArrow(comparer(spec), "key long, ci int, cj int, doc_id long, component long"), "alike"
    )
    texts = thinned(docs.where("doc_id IS NOT NULL"), alike.select("doc_id").distinct())
    more = tables.put(in_cells(alike.join(texts, "doc_id")).mapInArrow(linker(spec), "a long, b long").distinct(), "more")
    tables.drop(alike, shared, owned, mixed, reps)
    # doc_ids of one class that are not its least, where a doc_id has several texts
    again = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    final = tables.put(components(again.unionByName(_same_id(signed, classes, shape)), tables), "final")
    tables.drop(buckets, links, first, more)
    of_class = tables.put(
        classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*shape, F.coalesce("component", "rep").alias("component_id")),
        "of_class",
    )
    out = signed.select("doc_id", *shape).join(of_class, shape, "left")
    owner = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), owner.alias("component_id"), F.coalesce(owner == F.col("doc_id"), F.lit(False)).alias("kept"))


def _same_id(signed: DataFrame, classes: DataFrame, shape: list[str]) -> DataFrame:
    """Links between the classes of a doc_id that occurs with several texts."""
    twice = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.collect_set(F.struct(*shape)).alias("sets")
    ).where("rows > 1 AND size(sets) > 1")
    each = twice.select("doc_id", F.explode("sets").alias("s")).select("doc_id", "s.*")
    return each.join(classes, shape).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), CONTRACT)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
         ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), e AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM d
  UNION
  SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node WHERE reach.root < e.b
), c AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
