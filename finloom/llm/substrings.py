"""Operator 5: repeated passages by content-defined chunking.

A gear rolling hash runs over the bytes of every text; chunks end where it is the
greatest within ``RADIUS`` bytes on both sides.  Ends so depend on some 50 bytes
around them only, and an insertion moves at most the chunks that it touches.
Chunks are compared by a 64-bit digest.  The least doc_id that has a digest is its
first place; chunks elsewhere, and later ones in the same document, are repeats.
A run of adjoining repeats is extended on both sides, character by character, against
the texts at the first places of its chunks.  Runs of ``MIN_CHARS`` or more before
that, and passages of over ``MIN_WORDS`` words after it, are repeated passages.

An extension ends before the next chunk on its side and ``SLACK`` bytes more do, as
that chunk would else be a repeat too.  So the words up to there bound what a run can
become, and runs that can't reach the limit are left out before any text is read.
Short runs are extended at all their first places, long ones at those of their ends.

Digests with more than one chunk are staged as a table, so that the join of chunks
with them can be split where a passage is very common.  Sums by digest start before
the shuffle; a document's repeats meet in one task, its text being the bound.

Defined cases: null and empty texts and rows with null doc_id have no chunks; texts
without an end are one chunk; rows that share a doc_id count as one document; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finloom.llm.bloom import thinned
from finloom.llm.common import Staging, cut, read

RADIUS, GEAR_BYTES, MIN_CHARS, MIN_WORDS = 16, 16, 140, 50
#: Bytes that decide on an end (2 * RADIUS before it, RADIUS after), and those of two characters.
SLACK = 2 * RADIUS + 8
#: words: those that start in the chunk, and in its neighbours with SLACK, 21 bits each; reach: characters of these, 31 bits each.
CHUNKS = "doc_id long, start long, chars int, digest long, again boolean, words long, reach long"
SLICES = "doc_id long, lo long, hi long, slice string"
SIDES = "doc_id long, run long, left long, left_words long, right long, right_words long"


def chunk_ends(data: bytes, radius: int = RADIUS):
    """Byte offsets after which chunks end, the last being the length."""
    import numpy as np

    b = np.frombuffer(data, np.uint8)
    gear = np.random.default_rng(1).integers(0, 2**32, 256, np.uint32)
    h = gear[b]
    k = 1
    while k < GEAR_BYTES:  # h[i] sums gear << distance over the last 2k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    n = len(h)
    if n <= 2 * radius:
        return np.array([n] if n else [], np.int64)
    # greatest of `radius` neighbours by doubling
    most, span = h.copy(), 1
    while span < radius:
        step = min(span, radius - span)
        most = np.maximum(most[: len(most) - step], most[step:])
        span += step
    i = np.arange(radius, n - radius)
    peak = (h[i] > most[i - radius]) & (h[i] >= most[i + 1])
    ends = i[peak] + 1
    ends = ends[(b[ends] & 0xC0) != 0x80]  # never within a character
    return np.append(ends, n)


def chunker(batches):
    """Function on Arrow batches of (doc_id, text): see CHUNKS."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    from finloom.llm import hashing as H

    for batch in batches:
        ids, starts, chars, digests, again, words, reach = [], [], [], [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), H.texts(batch.column("text")), strict=True):
            if doc is None or not text:
                continue
            ends = chunk_ends(text)
            begin = np.append(0, ends[:-1])
            b = np.frombuffer(text, np.uint8)
            points = np.append(0, np.cumsum((b & 0xC0) != 0x80))
            blank = (b == 32) | ((b >= 9) & (b <= 13))
            before = np.append(0, np.cumsum(~blank & np.append(True, blank[:-1])))  # words that start before a byte
            lo = np.maximum(np.append(0, begin[:-1]) - SLACK, 0)
            hi = np.minimum(np.append(ends[1:], len(b)) + SLACK, len(b))
            d = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(begin, ends, strict=True)], np.uint64)
            _, first = np.unique(d, return_index=True)
            later = np.ones(len(d), bool)
            later[first] = False
            ids.append(np.full(len(d), doc, np.int64))
            starts.append(points[begin])
            chars.append((points[ends] - points[begin]).astype(np.int32))
            digests.append(H.signed(d))
            again.append(later)
            own, left, right = (np.minimum(before[y] - before[x], 2**21 - 1) for x, y in ((begin, ends), (lo, begin), (ends, hi)))
            words.append(own << 42 | left << 21 | right)
            reach.append((points[begin] - points[lo]) << 31 | points[hi] - points[ends])
        if ids:
            cols = [pa.array(np.concatenate(x)) for x in (ids, starts, chars, digests, again, words, reach)]
            yield pa.record_batch(cols, names=["doc_id", "start", "chars", "digest", "again", "words", "reach"])


def slicer(batches):
    """Function on Arrow batches of (doc_id, text, ranges): see SLICES."""
    import pyarrow as pa

    for batch in batches:
        rows = [
            (doc, r["lo"], r["hi"], text[r["lo"] : r["hi"]])
            for doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True)
            for r in ranges
        ]
        if rows:
            cols = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)
            yield pa.record_batch([pa.array(c, t) for c, t in cols], names=["doc_id", "lo", "hi", "slice"])


def alike(a: str, b: str) -> int:
    """Length of the common start of two texts."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return low


def extender(batches):
    """Function on Arrow batches of (doc_id, run, leftwards, inner, own, other): see SIDES."""
    import pyarrow as pa

    names = ["doc_id", "run", "left", "left_words", "right", "right_words"]
    for batch in batches:
        rows = []
        for doc, run, leftwards, inner, own, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "run", "leftwards", "inner", "own", "other")), strict=True):
            n = alike(own[::-1], other[::-1]) if leftwards else alike(own, other)
            outer = max(0, n - inner)
            if leftwards:
                added = own[len(own) - n : len(own) - inner] if outer else ""
                rows.append((doc, run, outer, len(added.split()), 0, 0))
            else:
                rows.append((doc, run, 0, 0, outer, len(own[inner:n].split())))
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def repeated_passages(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, start, chars, first_doc_id, sources: a row per repeated passage, positions in code points."""
    tables = Staging(docs.sparkSession, "substrings")
    chunks = docs.select("doc_id", "text").mapInArrow(chunker, CHUNKS)
    common = tables.put(
        chunks.groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.min_by("start", F.when(~F.col("again"), F.col("doc_id"))).alias("at"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "first", "at"),
        "common",
    )
    repeats = (
        chunks.join(common, "digest")
        .where("again OR first < doc_id")
        .select("doc_id", "start", "chars", "first", "at", "words", "reach")
        .repartition("doc_id")
        .groupBy("doc_id", "start")
        .agg(
            F.max("chars").alias("chars"), F.min("first").alias("first"), F.min_by("at", "first").alias("at"),
            F.max_by("words", "chars").alias("words"), F.max_by("reach", "chars").alias("reach"),
        )
    )
    order = Window.partitionBy("doc_id").orderBy("start")
    parted = F.col("start") != F.lag(F.col("start") + F.col("chars")).over(order)
    numbered = repeats.withColumn("cut", F.coalesce(parted, F.lit(True)).cast("int")).withColumn("run", F.sum("cut").over(order))
    bits = lambda c, at, n: F.shiftright(c, at).bitwiseAND(2**n - 1)
    long = F.col("chars") >= min_chars
    runs = tables.put(
        numbered.groupBy("doc_id", "run")
        .agg(
            F.min("start").alias("start"), F.sum("chars").alias("chars"), F.min("first").alias("first_doc_id"),
            F.sort_array(F.collect_set("first")).alias("sources"),
            F.sum(bits(F.col("words"), 42, 21)).alias("words"),
            bits(F.min_by("words", "start"), 21, 21).alias("words_before"), bits(F.max_by("words", "start"), 0, 21).alias("words_after"),
            bits(F.min_by("reach", "start"), 31, 31).alias("before"), bits(F.max_by("reach", "start"), 0, 31).alias("after"),
            F.sort_array(F.collect_list(F.struct("start", "chars", "first", "at"))).alias("places"),
        )
        .where(long | (F.col("words") + F.col("words_before") + F.col("words_after") + 2 > MIN_WORDS))
        .withColumn("left", F.filter("places", lambda p, i: (i == 0) | (~long & _moved(p, F.get("places", i - 1)))))
        .withColumn("right", F.filter("places", lambda p, i: (i == F.size("places") - 1) | (~long & _moved(p, F.get("places", i + 1)))))
        .drop("places"),
        "runs",
    )
    grown = _grown(runs, docs, tables)
    return (
        runs.join(grown, ["doc_id", "run"], "left")
        .na.fill(0, ["left_chars", "left_words", "right_chars", "right_words"])
        # a word that is cut at an edge counts
        .where(long | (F.col("words") + F.greatest(F.col("left_words"), F.lit(1)) + F.col("right_words") > MIN_WORDS))
        .select(
            "doc_id", (F.col("start") - F.col("left_chars")).alias("start"),
            (F.col("chars") + F.col("left_chars") + F.col("right_chars")).alias("chars"), "first_doc_id", "sources",
        )
    )


def _moved(p, q):
    """Whether two chunks of a run aren't as far apart at their first places as in the run."""
    return (p["first"] != q["first"]) | (p["at"] - p["start"] != q["at"] - q["start"])


def _grown(runs: DataFrame, docs: DataFrame, tables: Staging) -> DataFrame:
    """doc_id, run, and the characters and words by which a run can be extended on each side."""
    end = F.col("start") + F.col("chars")
    left = runs.select("doc_id", "run", "start", "before", F.explode("left").alias("p")).select(
        "doc_id", "run", F.lit(True).alias("leftwards"), (F.col("p.start") - F.col("start")).alias("inner"),
        (F.col("start") - F.col("before")).alias("lo"), F.col("p.start").alias("hi"), F.col("p.first").alias("other_id"), F.col("p.at").alias("at"),
    )
    stop = F.col("p.start") + F.col("p.chars")
    right = runs.select("doc_id", "run", end.alias("end"), "after", F.explode("right").alias("p")).select(
        "doc_id", "run", F.lit(False).alias("leftwards"), (F.col("end") - stop).alias("inner"),
        stop.alias("lo"), (F.col("end") + F.col("after")).alias("hi"), F.col("p.first").alias("other_id"), (F.col("p.at") + F.col("p.chars")).alias("at"),
    )
    # lengths at the first place in steps, so that few slices serve a common passage
    step = (F.floor((F.col("hi") - F.col("lo")) / 64) + 1) * 64
    sides = tables.put(
        left.unionByName(right)
        .where("lo < hi")
        .withColumn("other_lo", F.when(F.col("leftwards"), F.greatest(F.col("at") - step, F.lit(0))).otherwise(F.col("at")))
        .withColumn("other_hi", F.when(F.col("leftwards"), F.col("at")).otherwise(F.col("at") + step))
        .drop("at"),
        "sides",
    )
    asked = tables.put(
        sides.select("doc_id", "lo", "hi").unionByName(sides.select(F.col("other_id").alias("doc_id"), F.col("other_lo").alias("lo"), F.col("other_hi").alias("hi")))
        .distinct().groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")),
        "asked",
    )
    texts = thinned(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"), asked.select("doc_id"))
    slices = tables.put(texts.join(asked, "doc_id").select("doc_id", "text", "ranges").mapInArrow(slicer, SLICES).distinct(), "slices")
    others = slices.select(*[F.col(c).alias(f"other_{c}") for c in ("lo", "hi")], F.col("doc_id").alias("other_id"), F.col("slice").alias("other"))
    met = tables.put(sides.join(others, ["other_id", "other_lo", "other_hi"]).drop("other_id", "other_lo", "other_hi"), "met")
    both = met.join(slices.withColumnRenamed("slice", "own"), ["doc_id", "lo", "hi"])
    sized = both.select("doc_id", "run", "leftwards", "inner", "own", "other").mapInArrow(extender, SIDES)
    return sized.groupBy("doc_id", "run").agg(
        F.max("left").alias("left_chars"), F.max("left_words").alias("left_words"), F.max("right").alias("right_chars"), F.max("right_words").alias("right_words")
    )


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and text with every repeated passage taken out but at its first place."""
    spans = repeated_passages(docs, min_chars).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("chars")).alias("end")))).alias("spans")
    )
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col("spans"), ""))
    return joined.select("doc_id", kept.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))
