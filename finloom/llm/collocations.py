"""Operator 12: phrases whose words stand together more often than by chance.

1. Every task counts the hashes of the runs of 1 to ``longest`` words of its texts in a
   count-min sketch of ``rows`` rows; the counters of a stretch of cells are one row of
   the output, so that Spark merges sketches by a shuffle on these stretches, each in a
   buffer of its own.  Counters stop at ``least``, which can't hide a frequent phrase.
   What remains is a bit a cell: whether ``least`` or more was counted there.
2. A second pass over the texts keeps phrases all of whose cells are set, which holds for
   every frequent one, and only where both shorter phrases inside were kept as well.
   Survivors are summed exactly, in the task first; those below ``least`` go.
3. Every cut of a candidate is scored from exact counts in DECIMAL; the lowest counts.
   Candidates inside a longer one that is as frequent go, and the best of each language
   are ranked.

A row of the sketch has 2 ** ``bits`` cells; only cells with counts are kept and sent, so
a sketch takes the memory of ``FLUSH`` hashes whatever its width is.  An executor holds
the bits of full cells, 32 MB a row.  Where cells get some fifty phrases each (25 GB of
text with 2 ** 28), more pass to the exact sums; results are the same.  Tasks get up to
``per_task`` bytes of text, so that a phrase is sent once a GB, but two tasks a core at least.

Phrases are told apart by 64-bit hashes in a task, and by their words when they are summed.

Defined cases: a null lang is ``und``; null and empty texts have no words, and a
language without words no rows; repeated rows count again; a piece (the text between two
delimiters) has to fit a task, a text is read piece by piece; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finloom.llm import hashing as H
from finloom.llm.common import LOWER, UPPER, Staging, read


@dataclass(frozen=True)
class Spec:
    """Phrases of up to ``longest`` words, seen ``least`` times; ``top`` of a language; a sketch of ``rows`` rows of 2 ** ``bits`` cells."""

    longest: int = 5
    least: int = 100
    top: int = 2000
    inside_pct: int = 100
    rows: int = 2
    bits: int = 28
    per_task: int = 1 << 30


#: Delimiters of pieces become full stops, tabs blanks, A-Z small letters.
TABLE = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t", LOWER.encode() + b"." * 10 + b" ")
#: Bytes that are split into words at once, hashes that are sorted at once, phrases held before they are handed on.
STEP, FLUSH, HELD = 1 << 20, 1 << 21, 1 << 19
#: Cells of a row of counters.
CHUNK = 20
COUNTERS = "line int, chunk int, cells binary"
COUNTED = "lang string, k int, phrase string, a long"


def rows_of(batches, at_once: int = 256):
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            part = batch.slice(i, at_once)
            yield from zip(part.column("lang").to_pylist(), H.texts(part.column("text")), strict=True)


def stretches(rows, step: int = STEP):
    """(lang, bytes) of about ``step`` bytes with full stops between pieces; pieces stay whole."""
    held, size, total = defaultdict(list), defaultdict(int), 0
    for lang, text in rows:
        t, at = (text or b"").translate(TABLE), 0
        while at < len(t):
            end = len(t)
            if end - at > step:
                stop = t.rfind(b".", at, at + step)
                stop = t.find(b".", at) if stop < 0 else stop
                end = stop + 1 if stop >= 0 else end
            held[lang].append(t[at:end])
            size[lang] += end - at
            total += end - at
            at = end
            if size[lang] >= step:
                total -= size.pop(lang)
                yield lang, b".".join(held.pop(lang))
        if total >= 8 * step:
            yield from ((k, b".".join(v)) for k, v in held.items())
            held, size, total = defaultdict(list), defaultdict(int), 0
    yield from ((k, b".".join(v)) for k, v in held.items())


def hashed(lang: str, text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words and full stops of a stretch, their hashes in this language, and how many words of its piece start at each."""
    import xxhash

    words = (text + b".").replace(b".", b" . ").split()
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    stops = np.flatnonzero(h == np.frombuffer(xxhash.xxh3_64_digest(b"."), np.uint64)[0])
    reach = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(h))
    return words, H.mix(h ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))), reach


def phrases(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from every place of ``at`` on."""
    out = np.full(len(at), np.uint64(k), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out *= H.GOLDEN
            out += h[at + i]
    return H.mix(out)


def cells(h: np.ndarray, line: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = H.mix(h + np.uint64(line) * H.GOLDEN) if line else h
    return (mixed >> np.uint64(64 - bits)).astype(np.uint32)


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted places and what was counted there: the steps from place to place and the counts, byte by byte of their rank."""
    import zstandard as zs

    both = np.concatenate([np.diff(at, prepend=np.uint32(0)), n.astype(np.uint32)])
    return zs.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard as zs

    raw = np.frombuffer(zs.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(raw.T).view(np.uint32).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def sketcher(spec: Spec):
    """Function on Arrow batches of (lang, text): see COUNTERS."""
    width = min(CHUNK, spec.bits)

    def counters(h):
        for line in range(spec.rows):
            c = np.sort(cells(h, line, spec.bits))
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            n = np.minimum(np.diff(np.append(first, len(c))), spec.least)
            c = c[first]
            cuts = np.searchsorted(c, np.arange(1 << (spec.bits - width), dtype=np.uint64) << np.uint64(width)).tolist()
            for chunk, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(c)], strict=True)):
                if lo < hi:
                    yield line, chunk, packed(c[lo:hi] - np.uint32(chunk << width), n[lo:hi])

    def run(batches):
        held, n = [], 0
        for lang, text in stretches(rows_of(batches)):
            _, h, reach = hashed(lang, text)
            for k in range(1, spec.longest + 1):
                held.append(phrases(h, np.flatnonzero(reach >= k), k))
                n += len(held[-1])
            if n >= FLUSH:
                yield from _batches(counters(np.concatenate(held)))
                held, n = [], 0
        if n:
            yield from _batches(counters(np.concatenate(held)))

    return run


def _batches(rows, at_once: int = 64):
    import pyarrow as pa

    names, types, held = ["line", "chunk", "cells"], (pa.int32(), pa.int32(), pa.binary()), []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def merger(spec: Spec):
    """Function on Arrow batches of COUNTERS in order of (line, chunk): the full cells of every stretch."""
    width = min(CHUNK, spec.bits)

    def run(batches):
        now, sums = None, np.zeros(1 << width, np.uint32)

        def full():
            at = np.flatnonzero(sums >= spec.least).astype(np.uint32)
            if now is not None and len(at):
                yield (*now, packed(at, np.ones(len(at))))

        for batch in batches:
            for line, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("line", "chunk", "cells")), strict=True):
                if (line, chunk) != now:
                    yield from _batches(full())
                    now = (line, chunk)
                    sums[:] = 0
                at, n = unpacked(data)
                sums[at] = np.minimum(sums[at] + n, spec.least)
        yield from _batches(full())

    return run


def counter(spec: Spec, held):
    """Function on Arrow batches of (lang, text): see COUNTED; k = 0 counts all words of a language."""
    eight = np.uint32(7)

    def inside(h):
        ok = np.ones(len(h), bool)
        for line in range(spec.rows):
            c = cells(h, line, spec.bits)
            ok &= (held.value[line][c >> np.uint32(3)] >> (c & eight).astype(np.uint8)) & 1 == 1
        return ok

    def run(batches):
        import pyarrow as pa

        def batch(names, counts):
            if not names:
                return
            h, n = (np.concatenate(x) for x in zip(*counts, strict=True))
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            sums = np.add.reduceat(n, first)
            lang, k, phrase = zip(*(names[x] for x in h[first].tolist()), strict=True)
            cols = (pa.array(lang), pa.array(k, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(sums, pa.int64()))
            yield pa.record_batch(list(cols), names=["lang", "k", "phrase", "a"])

        names, counts, totals = {}, [], defaultdict(int)
        for lang, text in stretches(rows_of(batches)):
            words, h, reach = hashed(lang, text)
            totals[lang] += int((reach > 0).sum())
            at = np.flatnonzero(reach > 0)
            for k in range(1, spec.longest + 1):
                if k > 1:  # both phrases of one word less were kept
                    kept = np.zeros(len(h) + 1, bool)
                    kept[at] = True
                    at = at[(reach[at] >= k) & kept[at + 1]]
                g = phrases(h, at, k)
                ok = inside(g)
                at, g = at[ok], g[ok]
                if not len(at):
                    break
                u, first, n = np.unique(g, return_index=True, return_counts=True)
                counts.append((u, n))
                for x, i in zip(u.tolist(), at[first].tolist(), strict=True):
                    if x not in names:
                        names[x] = (lang, k, b" ".join(words[i : i + k]))
            if len(names) >= HELD:
                yield from batch(names, counts)
                names, counts = {}, []
            elif len(counts) >= 512:  # as many arrays become one
                h, n = (np.concatenate(x) for x in zip(*counts, strict=True))
                u, at = np.unique(h, return_inverse=True)
                counts = [(u, np.bincount(at, n).astype(np.int64))]
        yield from batch(names, counts)
        if totals:
            lang, n = zip(*totals.items(), strict=True)
            cols = (pa.array(lang), pa.array([0] * len(n), pa.int32()), pa.array([""] * len(n)), pa.array(n, pa.int64()))
            yield pa.record_batch(list(cols), names=["lang", "k", "phrase", "a"])

    return run


def full_cells(docs: DataFrame, spec: Spec) -> list[np.ndarray]:
    """A bit for every cell of every row of the merged sketches, 2 ** ``bits`` / 8 bytes a row; only full cells come to the driver."""
    width = min(CHUNK, spec.bits)
    counters = docs.mapInArrow(sketcher(spec), COUNTERS)
    merged = counters.repartition("line", "chunk").sortWithinPartitions("line", "chunk").mapInArrow(merger(spec), COUNTERS)
    out = [np.zeros((1 << spec.bits) // 8, np.uint8) for _ in range(spec.rows)]
    for line, chunk, data in merged.collect():
        at = unpacked(bytes(data))[0] + np.uint64(chunk << width)
        np.bitwise_or.at(out[line], at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return out


def frequent(docs: DataFrame, spec: Spec, tables: Staging) -> DataFrame:
    """lang, k, phrase, a: exact counts of the phrases seen ``least`` times or more; k = 0 has all words of a language."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.coalesce(max(2 * context.defaultParallelism, size // spec.per_task))
    held = context.broadcast(full_cells(docs, spec))
    sums = docs.mapInArrow(counter(spec, held), COUNTED).groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a"))
    return tables.put(sums.where((F.col("a") >= spec.least) | (F.col("k") == 0)), "frequent")


def _slice(words, start, n):
    return F.array_join(F.slice(words, start, n), " ")


def scored(counts: DataFrame, spec: Spec, tables: Staging) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of every candidate: its lowest-scoring cut."""
    total = tables.put(counts.where("k = 0").select("lang", F.col("a").alias("n")), "words")
    part = lambda name, n: counts.where((F.col("k") > 0) & (F.col("k") < spec.longest)).select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = (
        counts.where("k > 1").withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
        .select("lang", "phrase", "k", "a", "cut", _slice("w", F.lit(1), F.col("cut")).alias("left"), _slice("w", F.col("cut") + 1, F.col("k")).alias("right"))
    )
    big = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    score = F.expr(f"(1000BD * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    met = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(total, "lang")
    lowest = met.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "n")).alias("x"))
    return lowest.select("lang", "phrase", "k", "a", "x.l", "x.r", "x.n", "x.score")


def not_inside(candidates: DataFrame, spec: Spec) -> DataFrame:
    """The candidates that stand in no longer one which is as frequent, dropped or not."""
    w = F.split("phrase", " ")
    spans = lambda k: F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda n: F.transform(F.sequence(F.lit(1), k - n + 1), lambda i: F.struct(i.alias("i"), n.alias("n")))))
    longer = candidates.where("k > 2").select("lang", "a", w.alias("w"), F.explode(spans(F.col("k"))).alias("s"))
    most = longer.groupBy("lang", _slice("w", F.col("s.i"), F.col("s.n")).alias("phrase")).agg(F.max("a").alias("most"))
    apart = F.coalesce(100 * F.col("most") < spec.inside_pct * F.col("a"), F.lit(True))
    return candidates.join(most, ["lang", "phrase"], "left").where(apart).drop("most")


def collocations(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language."""
    tables = Staging(docs.sparkSession, "collocations")
    candidates = tables.put(scored(frequent(docs, spec, tables), spec, tables), "candidates")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = not_inside(candidates, spec).withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.where(F.col("rank") <= spec.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), s AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s, range(1, 6) t(k))
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM s GROUP BY lang
), cut AS (
  SELECT lang, phrase, k, a, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), sc AS (
  SELECT cut.lang, cut.phrase, cut.k, cut.a, c, l.a AS l, r.a AS r, n.n,
         ((1000::HUGEINT * cut.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:c], ' ')
  JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[c + 1:], ' ') JOIN n ON n.lang = cut.lang
), cand AS MATERIALIZED (
  SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ins AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, a, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM cand WHERE k > 2))
  GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM cand LEFT JOIN ins USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a
QUALIFY rank <= 2000
"""
