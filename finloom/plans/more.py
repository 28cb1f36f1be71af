"""Further queries: summaries, grades, clusters, text tests, citations, with their SQL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from finloom.functions import text
from finloom.operators import balance as B
from finloom.operators import classify as C
from finloom.sources import tables as S


def accounts_summary(spark, d):
    """Per account: first bank by row, first and last month, opening of the first, closing of the last."""
    months = B.monthly_balances(B.with_running_balance(S.ledger(spark, d)))
    ends = months.groupBy("account").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.min_by("opening", "month").alias("opening"), F.max_by("closing", "month").alias("closing"))
    banks = S.ledger(spark, d).groupBy("account").agg(F.min_by("bank", "row_ord").alias("bank"))
    return ends.join(banks, "account")


def data_completeness(spark, d):
    """One row: months, those with a gap, missing sums, and the verdict."""
    m = B.reconciled(B.monthly_balances(B.with_running_balance(S.ledger(spark, d))))
    bad = F.col("status") == "FAIL"
    out = m.agg(F.count("*").alias("months"), F.count_if(bad).alias("gap_months"), F.coalesce(F.sum(F.when(bad, F.abs("gap"))), F.lit(0)).alias("missing"))
    return out.withColumn("verdict", F.when(F.col("gap_months") == 0, "COMPLETE").otherwise("INCOMPLETE"))


def parser_grades(spark, d):
    """Per bank: share of rows with a known category, as a grade."""
    rows = C.classified(S.ledger(spark, d), companies=("BINTANG JAYA",), related=S.RELATED, factors=S.FACTORS)
    g = rows.groupBy("bank").agg(F.count("*").alias("n_rows"), F.count("primary").alias("known"))
    pct = F.col("known") * 100
    grade = F.when(pct >= F.col("n_rows") * 95, "A").when(pct >= F.col("n_rows") * 90, "B").when(pct >= F.col("n_rows") * 80, "C").when(pct >= F.col("n_rows") * 60, "D").otherwise("F")
    return g.withColumn("grade", grade)


CLUSTERS = (("statutory", r"EPF|KWSP|PERKESO|EIS|LHDN|LEMBAGA|HRDF|PEMBANGUNAN"), ("payroll", r"SALARY|PAYROLL|GAJI"), ("finance", r"LOAN|HIRE PURCHASE|INVOICE FIN"), ("transfer", r"TRANSFER|IBG|DUITNOW|GIRO"))


def purpose_clusters(spark, d):
    """Rows by the first purpose that fits, and whether it holds a fifth of all."""
    t = S.ledger(spark, d)
    c = F.lit("other")
    for name, pattern in reversed(CLUSTERS):
        c = F.when(F.rlike(F.upper("description"), F.lit(pattern)), name).otherwise(c)
    by = t.withColumn("cluster", c).groupBy("cluster").agg(F.count("*").alias("n_rows"))
    total = t.agg(F.count("*").alias("total"))  # one row
    return by.crossJoin(F.broadcast(total)).select("cluster", "n_rows", (F.col("n_rows") * 5 >= F.col("total")).alias("dominant"))


def inter_company_trace(spark, d):
    """Rows that name at least two tokens of the company."""
    tokens = [t for t in S.COMPANY.split() if t not in ("SDN", "BHD")]
    hits = sum(F.when(F.rlike(F.upper("description"), F.lit(rf"\b{t}\b")), 1).otherwise(0) for t in tokens)
    return S.ledger(spark, d).withColumn("hits", hits).where("hits >= 2").select("row_ord", "account", "hits")


def clean_description(spark, d):
    """Narratives with a repeated phrase and a reference, cleaned."""
    t = S.ledger(spark, d)
    phrase = F.array_join(F.slice(F.split("description", " "), 1, 3), " ")
    noisy = F.concat_ws(" ", phrase, phrase, F.lpad(F.col("row_ord").cast("string"), 9, "0"))
    return t.select("row_ord", text.collapsed_repeats(text.without_references(noisy)).alias("cleaned"))


def markdown_table_detect(spark, d):
    """Documents with at least two adjoining lines that part cells by bars."""
    f = S.fragments(spark, d).withColumn("row", F.rlike("content", F.lit(r"\S \| \S.* \|")).cast("int"))
    return f.groupBy("doc_id").agg(F.sum("row").alias("table_lines"), F.count("*").alias("n_lines")).where("table_lines > 0")


WINDOW, STARTS, SHORTEST, LONGEST = 2000, 200, 5, 500


def _real(part: str) -> bool:
    return bool(re.sub(r"<[^>]+>", "", part).strip())


def _repeats(tails: pd.Series) -> pd.Series:
    """Whether a pattern repeats 20 times, or over 70 % of the window, backwards from one of its last 200 characters.

    Of the patterns, the one with most repeats decides, the shortest and leftmost of these.  What
    breaks a repetition off must be tags or blanks; with real content before it, it doesn't count.
    """
    import numpy as np

    least = -(-WINDOW * 7 // 10 // STARTS)  # fewer repeats meet neither limit, as patterns start and end in STARTS

    def one(t: str) -> bool:
        if len(t) < WINDOW:
            return False
        c, first = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), WINDOW - STARTS
        best, best_size = 0, 0
        for size in range(SHORTEST, min(LONGEST, STARTS) + 1):
            same = c[size:] == c[:-size]
            if np.count_nonzero(same[max(0, first - (least - 1) * size) :]) < (least - 1) * size:
                continue
            at = np.arange(len(same))
            run = at - np.maximum.accumulate(np.where(same, -1, at))
            starts = np.arange(first, WINDOW - size + 1)
            counts = run[starts - 1] // size + 1
            for i in np.flatnonzero(counts >= least):
                n, before = int(counts[i]), int(starts[i] - counts[i] * size)
                if n > best and not (before >= 0 and _real(t[before : before + size])):
                    best, best_size = n, size
        return best >= 20 or best * best_size >= 0.7 * WINDOW

    return tails.map(one)


def repetition_flag(spark, d):
    docs, repeats = S.table(spark, d, "documents"), F.pandas_udf(_repeats, "boolean")
    return docs.select("doc_id", repeats(F.right(F.coalesce("text", F.lit("")), F.lit(WINDOW))).alias("repeats"))


def citation_join(spark, d):
    """Citations (every seventh fragment cites its header) resolved to pages, within allowed pages."""
    f = S.fragments(spark, d)
    cites = f.where("reading_order % 7 = 4").select("doc_id", F.col("reading_order").alias("cited_by"), (F.col("reading_order") - 4).alias("ref"))
    allowed = f.where("page % 2 = 1").select("doc_id", "page").distinct()
    places = f.select("doc_id", F.col("reading_order").alias("ref"), "page", "kind").join(allowed, ["doc_id", "page"], "left_semi")
    return cites.join(places, ["doc_id", "ref"], "left").select("doc_id", "cited_by", "ref", "page", "kind")


def account_meta(spark, d):
    """Per nation: whether any customer is overdrawn, and the largest limit."""
    c = S.table(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(F.bool_or(F.col("c_acctbal") < 0).alias("any_od"), F.max(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("most"))


def key_mismatch(spark, d):
    """Keys on one side only, from both sides (two anti joins)."""
    a = S.ledger(spark, d).select("account").distinct()
    b = S.events(spark, d).select("account").distinct()
    return a.join(b, "account", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "account", "left_anti").withColumn("side", F.lit("right")))


QUERIES = {f.__name__: f for f in (
    accounts_summary, data_completeness, parser_grades, purpose_clusters, inter_company_trace, clean_description,
    markdown_table_detect, repetition_flag, citation_join, account_meta, key_mismatch,
)}

from finloom.plans.classification import BAL, ROWS  # noqa: E402

_TX = f"WITH tx AS ({S.LEDGER_SQL})"
_FR = f"WITH fr AS ({S.FRAGMENTS_SQL['duck']})"
_CL = "CASE " + " ".join(f"WHEN regexp_matches(upper(description), '{p}') THEN '{n}'" for n, p in CLUSTERS) + " ELSE 'other' END"
ORACLES = {
    "accounts_summary": BAL + """ SELECT account, min(month) AS first_month, max(month) AS last_month, arg_min(opening, month) AS opening, arg_max(closing, month) AS closing,
      (SELECT arg_min(bank, row_ord) FROM tx t WHERE t.account = mo.account) AS bank FROM mo GROUP BY account""",
    "data_completeness": BAL + """ SELECT count(*) AS months, count(*) FILTER (abs(closing - opening - move) > 100) AS gap_months,
      CAST(coalesce(sum(abs(closing - opening - move)) FILTER (abs(closing - opening - move) > 100), 0) AS BIGINT) AS missing,
      CASE WHEN count(*) FILTER (abs(closing - opening - move) > 100) = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS verdict FROM mo""",
    "parser_grades": ROWS + """, g AS (SELECT bank, count(*) AS n_rows, count("primary") FILTER ("primary" <> '') AS known FROM r GROUP BY bank)
      SELECT *, CASE WHEN known * 100 >= n_rows * 95 THEN 'A' WHEN known * 100 >= n_rows * 90 THEN 'B' WHEN known * 100 >= n_rows * 80 THEN 'C' WHEN known * 100 >= n_rows * 60 THEN 'D' ELSE 'F' END AS grade FROM g""",
    "purpose_clusters": _TX + f" SELECT {_CL} AS cluster, count(*) AS n_rows, count(*) * 5 >= (SELECT count(*) FROM tx) AS dominant FROM tx GROUP BY 1",
    "inter_company_trace": _TX + r" SELECT row_ord, account, 2 AS hits FROM tx WHERE regexp_matches(upper(description), '\bBINTANG\b') AND regexp_matches(upper(description), '\bJAYA\b')",
    "clean_description": _TX + " SELECT row_ord, upper(array_to_string(list_slice(string_split(description, ' '), 1, 3), ' ')) AS cleaned FROM tx",
    "markdown_table_detect": _FR + r" SELECT doc_id, count(*) FILTER (regexp_matches(content, '\S \| \S.* \|')) AS table_lines, count(*) AS n_lines FROM fr GROUP BY doc_id HAVING count(*) FILTER (regexp_matches(content, '\S \| \S.* \|')) > 0",
    "citation_join": _FR + """ SELECT a.doc_id, a.reading_order AS cited_by, a.reading_order - 4 AS ref, b.page, b.kind FROM fr a
      LEFT JOIN fr b ON b.doc_id = a.doc_id AND b.reading_order = a.reading_order - 4 AND b.page % 2 = 1 WHERE a.reading_order % 7 = 4""",
    "account_meta": "SELECT c_nationkey, bool_or(c_acctbal < 0) AS any_od, max(CAST(round(c_acctbal * 100) AS BIGINT)) AS most FROM customer GROUP BY c_nationkey",
    "key_mismatch": f"WITH a AS (SELECT DISTINCT account FROM ({S.LEDGER_SQL}) x), b AS (SELECT DISTINCT account FROM ({S.EVENTS_SQL}) y) SELECT account, 'left' AS side FROM a WHERE account NOT IN (SELECT account FROM b) UNION ALL SELECT account, 'right' FROM b WHERE account NOT IN (SELECT account FROM a)",
}
