"""Queries over printed statements, names and report documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.operators import balance as B
from finloom.operators import extraction as X
from finloom.sinks import reports as R
from finloom.sources import statements as P
from finloom.sources import tables as S


def _printed(spark, d):
    """Order rows printed in the three line formats."""
    t = S.ledger(spark, d)
    money = lambda c: F.format_number(F.col(c) / 100, 2)
    amount, credit = F.greatest("credit", "debit"), F.col("credit") > 0
    t = t.withColumn("amount_", amount).withColumn("k", F.col("row_ord") % 3)
    line = (
        F.when(F.col("k") == 0, F.concat_ws(" ", F.date_format("date", "dd/MM/yyyy"), "description", F.concat(money("amount_"), F.when(credit, "+").otherwise("-")), money("amount_")))
        .when(F.col("k") == 1, F.concat_ws(" ", F.date_format("date", "dd-MM-yyyy"), "description", F.concat(money("amount_"), F.when(credit, "CR").otherwise("DR")), money("amount_")))
        .otherwise(F.concat_ws(" ", F.date_format("date", "dd MMM yyyy"), "description", money("amount_"), money("amount_")))
    )
    bank = F.element_at(F.array(*[F.lit(f.bank) for f in P.FORMATS]), (F.col("k") + 1).cast("int"))
    noise = t.select("row_ord", bank.alias("bank"), F.lit("Page 1 of 9").alias("line"))
    return t.select("row_ord", bank.alias("bank"), line.alias("line")).unionByName(noise)


def statement_parse(spark, d):
    return P.parsed(_printed(spark, d)).select("row_ord", "bank", "date", "description", "amount", "balance", "side")


def extract_counterparty(spark, d):
    return X.extracted(S.ledger(spark, d))


def extraction_statistics(spark, d):
    return X.statistics(X.extracted(S.ledger(spark, d)))


def report_json(spark, d):
    """Months and totals of every account as one JSON document."""
    m = B.monthly_balances(B.with_running_balance(S.events(spark, d))).select("account", "month", "credits", "debits", "closing")
    total = m.groupBy("account").agg(F.sum("credits").alias("total_credits"))
    return R.document(total, "account", [R.section(m, "account", "months", "month")])


def reminder_scan(spark, d):
    e = S.table(spark, d, "events")
    r = e.select(
        "event_id", F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp")).alias("reminder_sent_at"),
        F.when(F.col("event_id") % 5 > 0, "x@example.com").alias("email"),
    )
    return R.due_reminders(r, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


QUERIES = {f.__name__: f for f in (statement_parse, extract_counterparty, extraction_statistics, report_json, reminder_scan)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules() -> str:
    out = []
    for r in X.RULES:
        name = _q(r.result) if r.result else rf"regexp_replace(upper(trim(regexp_replace(regexp_extract(t, {_q(r.pattern)}, {r.group}), '\s+', ' ', 'g'))), '\s+(SDN\.?(\s+B(H(D\.?)?)?)?|SB)$', ' SDN BHD')"
        out.append(f"WHEN regexp_matches(t, {_q(r.pattern)}) THEN struct_pack(name := {name}, method := '{r.method}')")
    return "CASE " + " ".join(out) + " ELSE struct_pack(name := t, method := 'raw') END"


_NAMES = rf"""WITH tx AS ({S.LEDGER_SQL}), t AS (SELECT row_ord, regexp_replace(upper(trim(regexp_replace(description, '\s+', ' ', 'g'))), {_q(X.TRAILING)}, '') AS t FROM tx),
h AS (SELECT row_ord, {_rules()} AS h FROM t), n AS (SELECT row_ord, h.name AS name, h.method AS method FROM h)"""
_MONTHS = f"""WITH tx AS ({S.EVENTS_SQL}), bal AS (SELECT *, CAST(sum(credit - debit) OVER (PARTITION BY account ORDER BY row_ord) AS BIGINT) AS balance FROM tx),
m AS (SELECT account, month, CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits, arg_max(balance, row_ord) AS closing FROM bal GROUP BY ALL)"""
ORACLES = {
    "statement_parse": f"""WITH tx AS ({S.LEDGER_SQL}) SELECT row_ord, CASE row_ord % 3 WHEN 0 THEN 'signed' WHEN 1 THEN 'suffixed' ELSE 'balanced' END AS bank, date, description,
      greatest(credit, debit) AS amount, greatest(credit, debit) AS balance, CASE WHEN row_ord % 3 = 2 THEN NULL WHEN credit > 0 THEN 'CR' ELSE 'DR' END AS side FROM tx""",
    "extract_counterparty": _NAMES + " SELECT * FROM n",
    "extraction_statistics": _NAMES + " SELECT method, count(*) AS n_rows, count(DISTINCT name) AS n_names FROM n GROUP BY method",
    "report_json": _MONTHS + """ SELECT account, '{"total_credits":' || CAST(sum(credits) AS BIGINT) || ',"months":[' || string_agg('{"month":"' || month || '","credits":' || credits || ',"debits":' || debits
      || ',"closing":' || closing || '}', ',' ORDER BY month) || ']}' AS report FROM m GROUP BY account""",
    "reminder_scan": "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 HOUR AND event_id % 3 <> 0 AND event_id % 5 > 0",
}
