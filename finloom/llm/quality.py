"""Operator 1: rule-based document quality as one Spark projection.

A table of thresholds over length, symbol, stop-word and line ratios is compiled
into boolean columns.  No user functions, no shuffle: the plan is scan, project.

Defined cases: a null or empty text has no words and fails the base rule; a null
``doc_id`` passes through; repeated rows are each judged alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.llm.common import WS, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur avec ce il",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más",
}


#: As written within and at the start of a sentence.
STOP_FORMS = sorted({f for ws in STOP_WORDS.values() for w in ws.split() for f in (w, w.capitalize())})


@dataclass(frozen=True)
class Rule:
    """Keeps a document whose ``metric`` lies in [least, most]."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: Production thresholds.  Ratios are of words, but for lines.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", most=0.3),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
)


def _hashes(ws: Column) -> Column:
    """A 64-bit hash of every 8-word window; equal windows have equal hashes."""

    def windows(h: Column) -> Column:
        picked = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        return F.when(
            F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), picked)
        ).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), windows)


def _covered(hashes: Column) -> Column:
    """Words covered by windows that occur at least twice: sort, keep repeats, join intervals."""

    def repeats(s: Column) -> Column:
        same = lambda x, i: (x.h == F.get(s, i - 1).h) | F.coalesce(x.h == F.get(s, i + 1).h, F.lit(False))
        first = lambda x, i: F.coalesce(same(x, i), x.h == F.get(s, i + 1).h, F.lit(False))
        return F.sort_array(F.transform(F.filter(s, first), lambda x: x.p))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    def body(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(pairs, repeats), total)
        )

    return let(hashes, body)


def measured(text: Column) -> Column:
    """struct of the base counts and of the ratios that the rules use, each part evaluated once."""
    text = F.coalesce(text, F.lit(""))
    without = lambda c, chars: F.length(F.translate(c, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WS, "") != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _covered(_hashes(w)).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    counts = F.struct(
        let(words(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        without(text, WS).cast("long").alias("word_chars"),
        (F.length(text) - without(text, SYMBOLS)).cast("long").alias("n_symbols"),
    )

    def ratios(c: Column) -> Column:
        n = F.greatest(c["w"]["n_words"], F.lit(1))
        return F.struct(
            c["w"]["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
            c["l"]["n_dup_lines"].alias("n_dup_lines"), c["w"]["n_repeat_words"].alias("n_repeat_words"),
            c["w"]["n_stop_words"].alias("n_stop_words"), c["l"]["n_lines"].alias("n_lines"),
            (c["word_chars"] / n).alias("mean_word_chars"), (c["n_symbols"] / n).alias("symbol_ratio"),
            (c["w"]["n_stop_words"] / n).alias("stop_ratio"),
            (c["l"]["n_dup_lines"] / F.greatest(c["l"]["n_lines"], F.lit(1))).alias("dup_line_ratio"),
        )

    return let(counts, ratios)


def compiled(rules: tuple[Rule, ...], m: Column) -> Column:
    """Names of the rules that the measures ``m`` break, as one array expression."""
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (m[r.metric] < r.least)
        if r.most is not None:
            bad = bad | (m[r.metric] > r.most)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def _base_failed(m: Column, min_words: int, max_repeat_pct: int) -> Column:
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_pct * m["n_words"])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, ratios, ``base_failed``, ``broken`` rules and ``kept``."""
    m = F.col("m")
    got = docs.select("doc_id", measured(F.col("text")).alias("m"))
    got = got.select("doc_id", "m.*", _base_failed(m, min_words, max_repeat_pct).alias("base_failed"), compiled(rules, m).alias("broken"))
    return got.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def good_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """The rows of ``docs``, as they are, that the rules keep.

    The measures are bound inside the predicate: a filter on their columns would be
    pushed below them and evaluate them once for every use.
    """
    verdict = lambda m: ~_base_failed(m, min_words, max_repeat_pct) & (F.size(compiled(rules, m)) == 0)
    return docs.where(let(measured(F.col("text")), verdict))


def query(spark, sf_dir: str) -> DataFrame:
    from finloom.llm.common import read

    got = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept"
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_FORMS)

ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, list_slice(ws, i, i + {WINDOW - 1}) AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         list_sum(list_concat([0], list_transform(ws, lambda x: length(x))))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: x IN ({_STOP_SQL})))::BIGINT AS n_stop_words,
         len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
       NOT base_failed
       AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 14.0
       AND n_symbols / greatest(n_words, 1) <= 0.3
       AND n_stop_words / greatest(n_words, 1) >= 0.02
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM b
"""
