"""Queries over balances and months, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.operators import balance as B
from finloom.sources import tables as S

TX = f"WITH tx AS ({S.EVENTS_SQL}), bal AS (SELECT *, CAST(sum(credit - debit) OVER (PARTITION BY account ORDER BY row_ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM tx)"
EOD = TX + ", eod AS (SELECT account, date, month, arg_max(balance, row_ord) AS eod_balance FROM bal GROUP BY ALL)"
MONTHS = TX + """, m AS (
  SELECT account, month, CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits,
         count(*) FILTER (credit > 0) AS credit_rows, count(*) FILTER (debit > 0) AS debit_rows,
         arg_max(balance, row_ord) AS closing, min(balance) AS low, max(balance) AS high,
         arg_min(balance - credit + debit, row_ord) AS fo
  FROM bal GROUP BY ALL
), mo AS (SELECT *, coalesce(last_value(closing IGNORE NULLS) OVER (PARTITION BY account ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), fo) AS opening FROM m)"""


def _balances(spark, d):
    return B.with_running_balance(S.events(spark, d))


def running_balance(spark, d):
    return _balances(spark, d).select("account", "row_ord", "balance")


def eod_monthly(spark, d):
    return B.eod_statistics(_balances(spark, d), "account", "month")


def eod_rows(spark, d):
    return B.end_of_day(_balances(spark, d))


def balance_delta_side(spark, d):
    return B.sides_from_deltas(_balances(spark, d))


def month_totals(spark, d):
    return B.monthly_balances(_balances(spark, d))


def reconcile_tolerance(spark, d):
    return B.reconciled(B.monthly_balances(_balances(spark, d)))


def month_rollup(spark, d):
    return B.month_rollup(S.events(spark, d))


def account_type_vote(spark, d):
    return B.account_type_votes(_balances(spark, d))


def median_outlier_filter(spark, d):
    from dataclasses import replace

    from finloom.config import DEFAULT

    return B.without_outliers(_balances(spark, d), replace(DEFAULT, outlier_window=20_000)).groupBy("account").agg(
        F.count("*").alias("kept_rows"), F.sum("balance").cast("bigint").alias("kept_sum")
    )


def year_rollover(spark, d):
    """Dates printed in one leap year, so that every day has a printed form."""
    tx = S.ledger(spark, d)
    printed = tx.withColumn("printed", F.to_date(F.concat(F.lit("2004"), F.substring(F.col("date").cast("string"), 5, 6))))
    return B.rolled_years(printed).select("account", "row_ord", "years", "rolled")


def dedupe_fingerprint(spark, d):
    return B.deduplicated(S.ledger(spark, d), "account", "date", "description").select("row_ord", "account", "fingerprint")


def consolidated_annualised(spark, d):
    m = B.monthly_balances(_balances(spark, d))
    return m.agg(
        F.sum("credits").alias("credits"), F.sum("debits").alias("debits"), F.count_distinct("month").alias("months"),
        F.floor(F.sum("credits") * 12 / F.count_distinct("month")).alias("annual_credits"), F.max("high").alias("high"), F.min("low").alias("low"),
    )


QUERIES = {f.__name__: f for f in (
    eod_monthly, running_balance, eod_rows, balance_delta_side, month_totals, reconcile_tolerance, month_rollup,
    account_type_vote, median_outlier_filter, year_rollover, dedupe_fingerprint, consolidated_annualised,
)}

ORACLES = {
    "running_balance": TX + " SELECT account, row_ord, balance FROM bal",
    "eod_monthly": EOD + " SELECT account, month, count(*) AS eod_days, min(eod_balance) AS eod_low, max(eod_balance) AS eod_high, CAST(sum(eod_balance) AS BIGINT) AS eod_sum FROM eod GROUP BY ALL",
    "eod_rows": EOD + " SELECT * FROM eod",
    "balance_delta_side": TX + """, x AS (SELECT account, row_ord, balance, balance - lag(balance) OVER (PARTITION BY account ORDER BY row_ord) AS dl FROM bal)
        SELECT account, row_ord, balance, CASE WHEN dl > 0 THEN dl ELSE 0 END AS credit_seen, CASE WHEN dl < 0 THEN -dl ELSE 0 END AS debit_seen FROM x""",
    "month_totals": MONTHS + " SELECT account, month, credits, debits, credit_rows, debit_rows, closing, low, high, opening, high - low AS swing FROM mo",
    "reconcile_tolerance": MONTHS + """ SELECT account, month, opening, closing, opening + credits - debits AS expected_closing,
        closing - (opening + credits - debits) AS gap, CASE WHEN abs(closing - (opening + credits - debits)) <= 100 THEN 'PASS' ELSE 'FAIL' END AS status FROM mo""",
    "month_rollup": TX + " SELECT account, month, CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits, count(*) AS n_rows FROM tx GROUP BY ROLLUP (account, month)",
    "account_type_vote": TX + """, v AS (
        SELECT *, balance - lag(balance) OVER w AS step, credit - debit AS move FROM bal WINDOW w AS (PARTITION BY account ORDER BY row_ord)
      ), g AS (SELECT account, count(*) FILTER (abs(step - move) <= 2) AS cr_rows, count(*) FILTER (abs(step + move) <= 2) AS od_rows,
        count(step) AS checked, count(*) FILTER (balance < 0) AS negative, count(balance) AS with_balance FROM v GROUP BY account)
      SELECT *, CASE WHEN checked > 0 AND od_rows >= checked * 0.9 AND od_rows > cr_rows THEN 'OD' WHEN with_balance > 0 AND negative >= with_balance * 0.5 THEN 'OD'
        WHEN checked > 0 AND cr_rows >= checked * 0.9 THEN 'CR' ELSE 'UNDETERMINED' END AS account_type FROM g""",
    "median_outlier_filter": TX + """, s AS (SELECT account, list_sort(list(balance))[len(list(balance)) // 2 + 1] AS middle, count(*) AS n FROM bal GROUP BY account)
      SELECT account, count(*) AS kept_rows, CAST(sum(balance) AS BIGINT) AS kept_sum FROM bal JOIN s USING (account) WHERE n < 10 OR abs(balance - middle) <= 20000 GROUP BY account""",
    "year_rollover": f"""WITH tx AS ({S.LEDGER_SQL}), p AS (SELECT *, CAST('2004' || substr(CAST(date AS VARCHAR), 5, 6) AS DATE) AS printed FROM tx),
      q AS (SELECT *, CASE WHEN lag(printed) OVER (PARTITION BY account ORDER BY row_ord) - printed > 30 THEN 1 ELSE 0 END AS fall FROM p),
      y AS (SELECT *, CAST(sum(fall) OVER (PARTITION BY account ORDER BY row_ord) AS BIGINT) AS years FROM q)
      SELECT account, row_ord, years, CAST(printed + to_months(CAST(years * 12 AS INT)) AS DATE) AS rolled FROM y""",
    "dedupe_fingerprint": f"""WITH tx AS ({S.LEDGER_SQL}), m AS (SELECT *, sha256(account || '|' || date || '|' || description) AS fingerprint FROM tx)
      SELECT row_ord, account, fingerprint FROM m QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY row_ord) = 1""",
    "consolidated_annualised": MONTHS + """ SELECT CAST(sum(credits) AS BIGINT) AS credits, CAST(sum(debits) AS BIGINT) AS debits, count(DISTINCT month) AS months,
      CAST(floor(sum(credits) * 12 / count(DISTINCT month)) AS BIGINT) AS annual_credits, max(high) AS high, min(low) AS low FROM mo""",
}
