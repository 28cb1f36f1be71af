"""Entity merging: spellings of one counterparty found by equi joins on keys, closed, and folded into a survivor.

Input is one row per name: ``name``, ``n_rows`` and ``turnover``.  Every rule turns a
name into keys that it offers and keys that it answers to; equal keys link.  A key's
holders are linked to the least of them, so that no rule lists all pairs.  Names of
buckets (PROTECTED) are never linked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.operators.closure import least_labels

#: Buckets that stay as they are.
PROTECTED = (
    "UNIDENTIFIED", "UNIDENTIFIED (CHEQUE)", "CASH DEPOSIT", "CASH WITHDRAWAL", "RETURNED CHEQUE", "INWARD RETURN", "REVERSAL", "FD/INTEREST",
    "BANK FEES", "BULK SALARY", "JANM", "UNCATEGORIZED",
)
MARKERS = ("BIN", "BINTI", "BT", "BTE")
PREFIX_CHARS, SUBSET_CHARS, SUBSET_TOP = 10, 6, 200


def merge_key(name: Column) -> Column:
    """Words without legal forms and punctuation."""
    bare = F.regexp_replace(F.upper(name), r"\b(?:SDN|BHD|PTY|LTD|MAL|BER)\b\.?|\(M\)|& CO\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^A-Z0-9 ]+", " "), r"\s+", " "))


def _starts(words: Column, least: int) -> Column:
    """All starts of ``least`` words or more, short of the whole."""
    n = F.size(words)
    return F.when(n > least, F.transform(F.sequence(F.lit(least), n - 1), lambda k: F.array_join(F.slice(words, 1, k), " "))).otherwise(F.array().cast("array<string>"))


def _runs(words: Column, least: int) -> Column:
    """All runs of ``least`` words or more, short of the whole."""
    n = F.size(words)
    some = F.when(n > least, F.sequence(F.lit(least), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(some, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))))


def links(names: DataFrame) -> DataFrame:
    """a, b: pairs that a rule links, each key's holders with one of them.

    M1 equal keys; M2 a key of ten characters or more that starts another at a word's
    end; M3 equal given names before BIN or BINTI and a surname cut to three or four
    letters; M5 a key of two words or more, seen twice or more, as a run of words in
    another; M6 as many words, of which only the last differs by being cut.
    """
    known = names.where(~F.upper("name").isin(*PROTECTED)).withColumn("key", merge_key(F.col("name"))).where("key <> ''")
    w = F.split("key", " ")
    known = known.withColumn("w", w).withColumn("last", F.element_at("w", -1)).withColumn("at", F.array_max(F.transform("w", lambda x, i: F.when(x.isin(*MARKERS), i).otherwise(-1))))
    put = lambda rule, *cs: F.concat_ws("|", F.lit(rule), *cs)
    given, surname = F.array_join(F.slice("w", 1, F.col("at")), " "), F.get("w", F.col("at") + 1)
    but_last = F.array_join(F.slice("w", 1, F.size("w") - 1), " ")
    cut = F.when(F.size("w") < 2, F.array().cast("array<string>")).when(F.length("last") > F.when(F.size("w") < 3, 3).otherwise(1), F.transform(F.sequence(F.when(F.size("w") < 3, 3).otherwise(1), F.length("last") - 1), lambda k: put("M6", but_last, F.substr("last", F.lit(1), k)))).otherwise(F.array().cast("array<string>"))
    named = F.col("at") > 0
    offered = F.concat(
        F.array(put("M1", "key")), F.transform(F.filter(_starts(F.col("w"), 1), lambda s: F.length(s) >= PREFIX_CHARS), lambda s: put("M2", s)),
        F.when(named & (F.length(surname) > 3), F.transform(F.filter(F.array(F.lit(3), F.lit(4)), lambda k: k < F.length(surname)), lambda k: put("M3", given, F.substr(surname, F.lit(1), k)))).otherwise(F.array().cast("array<string>")),
        F.transform(_runs(F.col("w"), 2), lambda s: put("M5", s)), cut,
    )
    asked = F.concat(
        F.array(put("M1", "key")), F.when(F.length("key") >= PREFIX_CHARS, F.array(put("M2", "key"))).otherwise(F.array().cast("array<string>")),
        F.when(named & F.length(surname).between(3, 4), F.array(put("M3", given, surname))).otherwise(F.array().cast("array<string>")),
        F.when((F.size("w") >= 2) & (F.col("n_rows") >= 2), F.array(put("M5", "key"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("w") >= 2, F.array(put("M6", but_last, "last"))).otherwise(F.array().cast("array<string>")),
    )
    who = known.select(F.explode(asked).alias("k"), F.col("name").alias("a")).groupBy("k").agg(F.min("a").alias("a"))
    have = known.select(F.explode(offered).alias("k"), F.col("name").alias("b")).distinct()
    return have.join(who, "k").where("a <> b").select("a", "b").distinct()


def merged(names: DataFrame) -> DataFrame:
    """name, survivor: the spelling of most rows, then turnover, then least text, of every group of linked names."""
    roots = least_labels(links(names))
    grouped = names.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    best = grouped.groupBy("root").agg(F.min_by("name", F.struct((-F.col("n_rows")).alias("r"), (-F.col("turnover")).alias("t"), "name")).alias("survivor"))
    return grouped.join(best, "root").select("name", "survivor")


def ledger_merged(book: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums of a ledger (party, credits, debits, n_rows) by survivor, with the spellings in order of text."""
    return book.join(groups.withColumnRenamed("name", "party"), "party").groupBy("survivor").agg(
        F.sum("credits").alias("credits"), F.sum("debits").alias("debits"), F.sum("n_rows").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("party")), ";").alias("spellings")
    )


def subset_merge(names: DataFrame, top: int = SUBSET_TOP) -> DataFrame:
    """key, target: of the ``top`` keys by turnover, those whose words all stand in a longer one point to it.

    The longest such key wins, ties by text; the chain isn't followed, as a longest one
    points to nothing.  The limit is the rule's own; keys meet on words.
    """
    keys = names.withColumn("key", merge_key(F.col("name"))).where("key <> ''").groupBy("key").agg(F.sum("turnover").alias("turnover"))
    best = keys.orderBy(F.col("turnover").desc(), "key").limit(top).withColumn("w", F.array_distinct(F.split("key", " ")))
    word = best.select("key", F.size("w").alias("n"), F.explode("w").alias("x"))
    pair = word.alias("s").join(word.alias("l"), F.col("s.x") == F.col("l.x")).where(
        (F.length("s.key") >= SUBSET_CHARS) & (F.length("l.key") > F.length("s.key"))
    ).groupBy(F.col("s.key").alias("key"), F.col("l.key").alias("target"), F.col("s.n").alias("n")).agg(F.count("*").alias("shared"))
    into = pair.where("shared = n").groupBy("key").agg(F.max_by("target", F.struct(F.length("target"), "target")).alias("target"))
    return keys.join(into, "key", "left").select("key", F.coalesce("target", "key").alias("target"))
