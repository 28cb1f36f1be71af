"""Statements of every registered bank, printed from orders and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.sources import banks as K
from finloom.sources import tables as S

#: One file per account and year, in order of date; a running balance in every file, from an opening of 1,000.00.
FILES = f"""SELECT account * 10000 + CAST(substr(month, 1, 4) AS INT) AS file, CAST(substr(month, 1, 4) AS INT) AS year, row_ord, date, description, credit, debit,
  row_number() OVER (PARTITION BY account, substr(month, 1, 4) ORDER BY date, row_ord) AS n,
  CAST(100000 + sum(credit - debit) OVER (PARTITION BY account, substr(month, 1, 4) ORDER BY date, row_ord) AS BIGINT) AS balance FROM ({S.LEDGER_SQL}) z"""


def _lines(spark, d, form: K.BankFormat):
    """Three lines of print a row: noise, the transaction, and more text where the format has it."""
    t = spark.sql(FILES.replace("FROM orders", "FROM {t}"), t=S.table(spark, d, "orders"))
    money = lambda c: F.format_number(c / 100, 2)
    amount, bal, into = F.col("credit") + F.col("debit"), F.col("balance"), F.col("credit") > 0
    shape = {"dd/MM/yyyy": "dd/MM/yyyy" if form.has_year else "dd/MM", "d MMM yyyy": "d MMM", "ddMMM yyyy": "ddMMM"}.get(form.date_form, form.date_form)
    day = F.date_format("date", shape)
    if form.bank == "public_bank":  # not every row prints its date
        day = F.when((F.col("n") == 1) | (F.col("row_ord") % 3 == 0), day)
    after = {"alliance": F.concat(money(F.abs(bal)), F.when(bal < 0, " DR").otherwise(" CR")), "rhb": F.concat(money(F.abs(bal)), F.when(bal < 0, "-").otherwise("+")), "agrobank": F.concat(money(F.abs(bal)), F.when(bal < 0, "-").otherwise("")), "maybank": F.concat(money(F.abs(bal)), F.when(bal < 0, "DR").otherwise(""))}.get(form.bank, money(bal))
    cells = {"sign": F.concat(money(amount), F.when(into, "+").otherwise("-")), "in_out": F.concat_ws(" ", money(F.col("credit")), money(F.col("debit"))), "out_in": F.concat_ws(" ", money(F.col("debit")), money(F.col("credit")))}.get(form.side, money(amount))
    line = F.concat_ws(" ", day, "description", cells, after)
    told = lambda when, at, text: F.when(when, F.struct(at.cast("long").alias("line_no"), text.alias("line")))
    n, number = F.col("n"), F.col("row_ord")
    lines = [told(F.lit(True), n * 10, line), told(n == 1, F.lit(1), F.lit("OPENING BALANCE 1,000.00")), told(number % 4 == 0, n * 10 + 5, F.concat(F.lit("Page "), n.cast("string")))]
    if form.more:
        lines.append(told(number % 5 == 0, n * 10 + 2, F.concat(F.lit("REF "), number.cast("string"))))
    # one pass over the rows prints all their lines
    return t.select("file", "year", F.inline(F.array_compact(F.array(*lines)))).withColumn("bank", F.lit(form.bank))


def _query(form: K.BankFormat):
    return lambda spark, d: K.statement_rows(_lines(spark, d, form)).select("file", "row", "date", "description", "debit", "credit", "balance")


QUERIES = {f"bank_{f.bank}": _query(f) for f in K.BANKS}


def _oracle(form: K.BankFormat) -> str:
    date = "last_value(CASE WHEN n = 1 OR row_ord % 3 = 0 THEN date END IGNORE NULLS) OVER (PARTITION BY file ORDER BY n)" if form.bank == "public_bank" else "date"
    text = "CASE WHEN row_ord % 5 = 0 THEN description || ' REF ' || row_ord ELSE description END" if form.more else "description"
    side = "credit > 0"
    if form.side == "words":
        told = lambda pattern: f"regexp_matches(' ' || upper(description) || ' ', '{pattern}')"
        side = f"CASE WHEN {told(form.hints[0])} AND NOT {told(form.hints[1])} THEN true WHEN {told(form.hints[2])} THEN false ELSE credit > 0 END"
    return f"""WITH f AS ({FILES}), s AS (SELECT *, {side} AS into_ FROM f)
      SELECT file, n AS row, {date} AS date, {text} AS description, CASE WHEN into_ THEN 0 ELSE credit + debit END AS debit, CASE WHEN into_ THEN credit + debit ELSE 0 END AS credit, balance FROM s"""


ORACLES = {f"bank_{f.bank}": _oracle(f) for f in K.BANKS}
