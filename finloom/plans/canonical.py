"""Queries over raw statement rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from finloom.operators import canonical as K
from finloom.operators import classify as C
from finloom.operators import parties as Y
from finloom.plans.classification import ROWS, _rows
from finloom.plans.domain import SIGNALS
from finloom.sources import tables as S

CREDIT_WORDS, DEBIT_WORDS = r"\bDEPOSIT\b|\bCREDIT\b|\bINWARD\b", r"\bPAYMENT\b|\bFEE\b|\bDR\b|\bTAX\b"
STATUTORY = (("KWSP", C.EPF), ("SOCSO", C.SOCSO), ("LHDN", C.TAX), ("HRDF", C.HRDF))
#: Orders as printed rows of a file: three forms of dates, signs, blanks.
RAW = f"""SELECT account AS file, row_ord, description,
  CASE row_ord % 3 WHEN 0 THEN CAST(date AS STRING) WHEN 1 THEN substr(CAST(date AS STRING), 9, 2) || '/' || substr(CAST(date AS STRING), 6, 2) || '/' || substr(CAST(date AS STRING), 1, 4)
    ELSE substr(CAST(date AS STRING), 9, 2) || '/' || substr(CAST(date AS STRING), 6, 2) END AS raw_date,
  CASE WHEN debit > 0 AND row_ord % 7 <> 0 THEN CAST(CAST(floor(debit / 100) AS BIGINT) AS STRING) || '.00' WHEN row_ord % 7 = 0 AND credit > 0 THEN '-' || CAST(CAST(floor(credit / 100) AS BIGINT) AS STRING) || '.50' END AS raw_debit,
  CASE WHEN credit > 0 AND row_ord % 7 <> 0 THEN CAST(CAST(floor(credit / 100) AS BIGINT) AS STRING) || '.25' WHEN row_ord % 7 = 0 AND debit > 0 THEN '(' || CAST(CAST(floor(debit / 100) AS BIGINT) AS STRING) || '.75)' END AS raw_credit,
  CASE WHEN row_ord % 5 > 0 THEN CAST(CAST(floor((credit + debit) / 100) AS BIGINT) AS STRING) || '.10' ELSE ' ' END AS raw_balance,
  CASE WHEN row_ord % 4 > 0 THEN bank ELSE ' ' END AS bank,
  CASE WHEN row_ord % 3 = 0 THEN '' ELSE CAST(account AS STRING) END AS account_no, CASE WHEN row_ord % 3 = 1 THEN NULL ELSE 'N' || CAST(account AS STRING) END AS account_number
FROM ({S.LEDGER_SQL}) z"""
#: Orders with a running balance, now and then misprinted, and an unsigned amount.
PRINTED = f"""SELECT account AS file, row_ord, month, date, description, credit, debit, credit + debit AS amount,
  CAST(sum(credit - debit) OVER (PARTITION BY account ORDER BY row_ord) AS BIGINT) + CASE row_ord % 13 WHEN 0 THEN 5000 WHEN 1 THEN 30000 ELSE 0 END AS balance
FROM ({S.LEDGER_SQL}) z"""


def _sql(spark, d, text):
    return spark.sql(text.replace("FROM orders", "FROM {t}"), t=S.table(spark, d, "orders"))


def canonical_rows(spark, d):
    return K.canonical(_sql(spark, d, RAW), "HOME BANK")


def side_by_delta(spark, d):
    return K.sided(_sql(spark, d, PRINTED), CREDIT_WORDS, DEBIT_WORDS)


def snap_to_delta(spark, d):
    return K.snapped(_sql(spark, d, PRINTED))


def printed_override(spark, d):
    rows = _sql(spark, d, PRINTED)
    return K.anchored_balance(rows.withColumn("printed", F.when(F.col("row_ord") % 5 == 0, F.col("balance"))))


def carry_dates(spark, d):
    rows = _sql(spark, d, PRINTED).withColumn("date", F.when(F.col("row_ord") % 4 == 0, F.col("date")))
    return K.carried_dates(rows).select("file", "row_ord", "date")


def date_fault_scan(spark, d):
    return K.date_faults(_sql(spark, d, PRINTED))


def _names(spark, d):
    t = S.ledger(spark, d)
    short = F.array_join(F.slice(F.split("description", " "), 1, 2), " ")
    return t.select(F.col("counterparty").alias("name")).union(t.select(short)).union(t.select("description")).distinct()


def synthetic_labels(spark, d):
    return _names(spark, d).where(K.is_synthetic(F.col("name")))


def name_fragments(spark, d):
    return _names(spark, d).where(K.is_fragment(F.col("name")))


def loan_review(spark, d):
    rows = _rows(spark, d).withColumn("primary", F.when(F.col("row_ord") % 2 == 0, F.col("primary")))
    return K.loan_review(rows)


def statutory_stamp(spark, d):
    t = S.ledger(spark, d)
    return t.select("row_ord", K.statutory_bucket(F.col("description"), F.col("counterparty"), F.col("credit"), STATUTORY).alias("bucket"))


def patronymic_guard(spark, d):
    shown = F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ("SITI BINTI", "RAHIM BIN", "TRADE")]), (F.col("row_ord") % 3 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in ("BA", "TL", "FD", "ALI")]), (F.col("row_ord") % 4 + 1).cast("int")), "description")
    return S.ledger(spark, d).select("row_ord", F.array_join(K.patronymic_tokens(shown), ",").alias("tokens"))


def suffix_shares(spark, d):
    sign = F.when(F.col("row_ord") % 3 > 0, F.when(F.col("debit") > 0, "dr").otherwise("CR"))
    return K.suffix_shares(_sql(spark, d, PRINTED).withColumn("sign", sign))


def month_summary(spark, d):
    return K.month_summary(_sql(spark, d, PRINTED))


def statement_month(spark, d):
    t = S.ledger(spark, d)
    return t.select("row_ord", K.statement_month(F.col("date")).alias("month"), F.last_day("date").alias("month_end"), F.date_format(F.add_months(F.trunc("date", "MM"), -1), "yyyy-MM").alias("month_before"))


def totals_search(spark, d):
    """Printed totals of every account among misread ones: other accounts' figures and scaled ones."""
    by = S.ledger(spark, d).groupBy(F.col("account").alias("file")).agg(F.sum("credit").alias("c"), F.sum("debit").alias("b"))
    few = lambda *v: F.array(*v)
    o = F.col("file") * 1000 + 50_000
    off = F.when(F.col("file") % 5 == 0, 7_000).otherwise(0)
    return K.best_totals(by.select(
        "file", few(F.lit(62_067).cast("long"), o, o * 10).alias("opens"), few(F.col("c"), o + F.col("c") - F.col("b") + off).alias("ends"),
        few(F.col("b") + 100, F.col("b"), F.floor(F.col("b") / 10)).alias("debits"), few(F.floor(F.col("c") / 10), F.col("c"), F.col("c") + 5).alias("credits"),
    ))


def canonical_sort(spark, d):
    t = S.ledger(spark, d).withColumn("date", F.when(F.col("row_ord") % 9 > 0, F.col("date")))
    order = Window.partitionBy("account").orderBy(F.col("date").asc_nulls_last(), "bank", "description", "row_ord")
    return t.select("account", "row_ord", F.row_number().over(order).alias("place"))


def top_credit_rows(spark, d):
    """The 30 largest credits, ties by order."""
    return S.ledger(spark, d).where("credit > 0").orderBy(F.col("credit").desc(), "row_ord").limit(30).select("row_ord", "account", "credit")


def rp_order(spark, d):
    """Related parties by confidence, then by debits."""
    rank = F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).otherwise(2)
    found = Y.related_signals(S.ledger(spark, d))
    # parties are few: one row for each name
    return found.select("party", "confidence", F.row_number().over(Window.orderBy(rank, F.col("debits").desc(), "party")).alias("place"))


def rp_advisory(spark, d):
    """At most 25 parties with debits of 3,000 or more that aren't confirmed, largest first."""
    found = Y.related_signals(S.ledger(spark, d)).where("confidence <> 'HIGH' AND debits >= 300000")
    return found.orderBy(F.col("debits").desc(), "party").limit(25).select("party", "debits", "confidence")


def related_union(spark, d):
    t = S.ledger(spark, d)
    a = t.groupBy(F.col("counterparty").alias("name")).agg(F.min("row_ord").alias("place"))
    b = t.groupBy(F.lower("counterparty").alias("name")).agg((F.min("row_ord") + 1_000_000_000).alias("place"))
    return K.first_spellings(a.unionByName(b))


def token_differences(spark, d):
    """Words of the narrative that the counterparty lacks, and the other way round."""
    words = lambda c: F.array_distinct(F.split(F.upper(c), " "))
    t = S.ledger(spark, d)
    a, b = words(F.col("description")), words(F.col("counterparty"))
    return t.select("row_ord", F.array_join(F.array_sort(F.array_except(a, b)), " ").alias("only_text"), F.array_join(F.array_sort(F.array_except(b, a)), " ").alias("only_party"))


def money_format(spark, d):
    t = S.ledger(spark, d)
    return t.select("row_ord", K.dollars(F.col("credit") + F.col("debit")).alias("shown"), K.percent(F.col("credit") % 1000, F.col("row_ord") % 3 * 1000).alias("share"))


QUERIES = {f.__name__: f for f in (
    canonical_rows, side_by_delta, snap_to_delta, printed_override, carry_dates, date_fault_scan, synthetic_labels, name_fragments, loan_review, statutory_stamp,
    patronymic_guard, suffix_shares, month_summary, statement_month, totals_search, canonical_sort, top_credit_rows, rp_order, rp_advisory, related_union,
    token_differences, money_format,
)}


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_TX = f"WITH tx AS ({S.LEDGER_SQL})"
_PR = f"WITH pr AS ({PRINTED}), dl AS (SELECT *, balance - lag(balance) OVER (PARTITION BY file ORDER BY row_ord) AS delta FROM pr)"
_NAMES = _TX + ", nm AS (SELECT counterparty AS name FROM tx UNION SELECT array_to_string(list_slice(string_split(description, ' '), 1, 2), ' ') FROM tx UNION SELECT description FROM tx)"
_CASE = " ".join(f"WHEN regexp_matches(upper(description), '{p}') THEN '{b}'" for b, p in STATUTORY)
_BARE = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
ORACLES = {
    "canonical_rows": f"""WITH r AS ({RAW}), y AS (SELECT file, arg_min(CASE row_ord % 3 WHEN 0 THEN substr(raw_date, 1, 4) ELSE substr(raw_date, 7, 4) END, row_ord) AS y FROM r WHERE row_ord % 3 < 2 GROUP BY file),
      v AS (SELECT *, CASE row_ord % 3 WHEN 0 THEN raw_date WHEN 1 THEN substr(raw_date, 7, 4) || '-' || substr(raw_date, 4, 2) || '-' || substr(raw_date, 1, 2)
        ELSE coalesce(CAST(TRY_CAST(y || '-' || substr(raw_date, 4, 2) || '-' || substr(raw_date, 1, 2) AS DATE) AS VARCHAR), raw_date) END AS day,
        coalesce(CAST(CAST(replace(raw_debit, '-', '') AS DECIMAL(18, 2)) * 100 AS BIGINT), 0) AS a, coalesce(CAST(CAST(regexp_replace(raw_credit, '[()]', '', 'g') AS DECIMAL(18, 2)) * 100 AS BIGINT), 0) AS b FROM r LEFT JOIN y USING (file))
      SELECT file, row_ord, day AS date, description, CASE WHEN row_ord % 7 = 0 THEN b ELSE a END AS debit, CASE WHEN row_ord % 7 = 0 THEN a ELSE b END AS credit,
        CAST(CAST(nullif(trim(raw_balance), '') AS DECIMAL(18, 2)) * 100 AS BIGINT) AS balance, coalesce(nullif(trim(bank), ''), 'HOME BANK') AS bank,
        coalesce(nullif(account_no, ''), account_number) AS account_no, coalesce(account_number, nullif(account_no, '')) AS account_number FROM v""",
    "side_by_delta": _PR + f""", s AS (SELECT *, CASE WHEN abs(abs(delta) - amount) <= 1 AND delta <> 0 THEN CASE WHEN delta > 0 THEN 'CR' ELSE 'DR' END
        WHEN regexp_matches(upper(description), '{CREDIT_WORDS}') THEN 'CR' WHEN regexp_matches(upper(description), '{DEBIT_WORDS}') THEN 'DR' END AS side FROM dl)
      SELECT file, row_ord, side, CASE WHEN side = 'CR' THEN amount WHEN side IS NULL THEN greatest(coalesce(delta, 0), 0) ELSE 0 END AS credit,
        CASE WHEN side = 'DR' THEN amount WHEN side IS NULL THEN CASE WHEN delta IS NULL THEN amount ELSE greatest(-delta, 0) END ELSE 0 END AS debit FROM s""",
    "snap_to_delta": _PR + """, s AS (SELECT *, coalesce(delta <> 0 AND credit + debit > 0 AND abs(abs(delta) - (credit + debit)) <= 50000, false) AS snapped FROM dl)
      SELECT file, row_ord, CASE WHEN snapped THEN greatest(delta, 0) ELSE credit END AS credit, CASE WHEN snapped THEN greatest(-delta, 0) ELSE debit END AS debit, snapped FROM s""",
    "printed_override": _PR + """, a AS (SELECT *, max(CASE WHEN row_ord % 5 = 0 THEN row_ord END) OVER (PARTITION BY file ORDER BY row_ord) AS anc FROM pr)
      SELECT file, row_ord, CAST(sum(CASE WHEN row_ord % 5 = 0 THEN balance ELSE credit - debit END) OVER (PARTITION BY file, anc ORDER BY row_ord) AS BIGINT) AS balance FROM a""",
    "carry_dates": _PR + " SELECT file, row_ord, last_value(CASE WHEN row_ord % 4 = 0 THEN date END IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_ord) AS date FROM pr",
    "date_fault_scan": _PR + """, b AS (SELECT *, lag(date) OVER (PARTITION BY file ORDER BY row_ord) - date AS back FROM pr)
      SELECT file, row_ord, back, CASE WHEN back BETWEEN 330 AND 400 THEN 'YEAR_LEAK' ELSE 'REGRESSION' END AS fault FROM b WHERE back > 30""",
    "synthetic_labels": _NAMES + f" SELECT name FROM nm WHERE trim(name) = '' OR upper(trim(name)) IN ({_list(K.SYNTHETIC)}) OR regexp_matches(upper(trim(name)), '{K.SYNTHETIC_FORM}')",
    "name_fragments": _NAMES + f" SELECT name FROM nm WHERE length(trim(name)) <= 2 OR NOT regexp_matches(upper(name), '[A-Z]') OR len(list_filter(string_split(upper(name), ' '), lambda w: w NOT IN ({_list(K.MONTHS + K.PURPOSES)}))) = 0",
    "loan_review": ROWS + f""" SELECT row_ord, account, side, greatest(credit, debit) AS amount FROM r WHERE (row_ord % 2 <> 0 OR "primary" IS NULL OR "primary" = '')
      AND regexp_matches(upper(description), '{K.LOAN_SHAPED}') AND NOT regexp_matches(upper(description), '{K.LOAN_NOISE}') AND greatest(credit, debit) > 0""",
    "statutory_stamp": _TX + f" SELECT row_ord, CASE WHEN credit > 0 OR (length({_BARE.format('counterparty')}) >= 4 AND contains({_BARE.format('description')}, {_BARE.format('counterparty')})) THEN NULL ELSE CASE {_CASE} END END AS bucket FROM tx",
    "patronymic_guard": _TX + " SELECT row_ord, CASE WHEN row_ord % 3 < 2 AND row_ord % 4 < 3 THEN list_extract(['BA', 'TL', 'FD'], CAST(row_ord % 4 + 1 AS INT)) ELSE '' END AS tokens FROM tx",
    "suffix_shares": _PR + """, s AS (SELECT file, count(*) FILTER (row_ord % 3 > 0) AS signed, count(*) FILTER (row_ord % 3 > 0 AND debit > 0) AS dr_rows FROM pr GROUP BY file)
      SELECT *, CASE WHEN signed > 0 THEN dr_rows * 10000 // signed ELSE 0 END AS dr_share FROM s""",
    "month_summary": _PR + """, l AS (SELECT DISTINCT file, month, last_value(balance) OVER (PARTITION BY file, month ORDER BY row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM pr),
      g AS (SELECT month, CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits, CAST(sum(credit - debit) AS BIGINT) AS net, count(*) AS n_rows, count(DISTINCT file) AS files, min(balance) AS lowest FROM pr GROUP BY month)
      SELECT g.*, (SELECT CAST(sum(e) AS BIGINT) FROM l WHERE l.month = g.month) AS ending FROM g""",
    "statement_month": _TX + """ SELECT row_ord, strftime(CASE WHEN day(date) <= 7 THEN date - INTERVAL 1 MONTH ELSE date END, '%Y-%m') AS month, last_day(date) AS month_end, strftime(date - INTERVAL 1 MONTH, '%Y-%m') AS month_before FROM tx""",
    "totals_search": _TX + """, g AS (SELECT account AS file, CAST(sum(credit) AS BIGINT) AS c, CAST(sum(debit) AS BIGINT) AS b, account * 1000 + 50000 AS o FROM tx GROUP BY account),
      k AS (SELECT file, x.i, y.i AS j, u.i AS k, v.i AS m, x.v AS o, y.v AS e, u.v AS d, v.v AS c FROM g,
        LATERAL (SELECT * FROM (VALUES (0, 62067::BIGINT), (1, g.o), (2, g.o * 10)) t(i, v)) x, LATERAL (SELECT * FROM (VALUES (0, g.c), (1, g.o + g.c - g.b + CASE WHEN file % 5 = 0 THEN 7000 ELSE 0 END)) t(i, v)) y,
        LATERAL (SELECT * FROM (VALUES (0, g.b + 100), (1, g.b), (2, g.b // 10)) t(i, v)) u, LATERAL (SELECT * FROM (VALUES (0, g.c // 10), (1, g.c), (2, g.c + 5)) t(i, v)) v),
      z AS (SELECT *, abs(o + c - d - e) AS err, CASE WHEN greatest(o, e, d, c) >= 1000000 AND least(o, e, d, c) < 100000 THEN 100000 ELSE 0 END AS pen FROM k)
      SELECT file, o AS opening, e AS ending, d AS total_debit, c AS total_credit, err <= 6 AS exact FROM z QUALIFY row_number() OVER (PARTITION BY file ORDER BY err > 6, err + pen, i, j, k, m) = 1""",
    "canonical_sort": _TX + " SELECT account, row_ord, row_number() OVER (PARTITION BY account ORDER BY CASE WHEN row_ord % 9 > 0 THEN date END NULLS LAST, bank, description, row_ord) AS place FROM tx",
    "top_credit_rows": _TX + " SELECT row_ord, account, credit FROM tx WHERE credit > 0 ORDER BY credit DESC, row_ord LIMIT 30",
    "rp_order": SIGNALS + " SELECT party, confidence, row_number() OVER (ORDER BY CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, debits DESC, party) AS place FROM rp",
    "rp_advisory": SIGNALS + " SELECT party, debits, confidence FROM rp WHERE confidence <> 'HIGH' AND debits >= 300000 ORDER BY debits DESC, party LIMIT 25",
    "related_union": _TX + " SELECT arg_min(counterparty, row_ord) AS name, min(row_ord) AS place FROM tx WHERE trim(counterparty) <> '' GROUP BY upper(trim(counterparty))",
    "token_differences": _TX + """, w AS (SELECT row_ord, list_distinct(string_split(upper(description), ' ')) AS a, list_distinct(string_split(upper(counterparty), ' ')) AS b FROM tx)
      SELECT row_ord, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS only_text, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ' ') AS only_party FROM w""",
    "money_format": _TX + """ SELECT row_ord, 'RM ' || format('{:,}', (credit + debit) // 100) || '.' || lpad(CAST((credit + debit) % 100 AS VARCHAR), 2, '0') AS shown,
      CASE WHEN row_ord % 3 = 0 THEN '0.0%' ELSE CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || '%' END AS share FROM (SELECT *, CASE WHEN row_ord % 3 > 0 THEN (credit % 1000 * 2000 + row_ord % 3 * 1000) // (row_ord % 3 * 2000) END AS t FROM tx)""",
}
