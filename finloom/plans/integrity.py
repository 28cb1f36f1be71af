"""Queries over integrity layers and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.operators import balance as B
from finloom.operators import integrity as I
from finloom.sources import tables as S

META = """SELECT c_custkey AS file, c_mktsegment AS bank, CASE c_custkey % 9 WHEN 0 THEN 'Adobe Photoshop' WHEN 1 THEN 'Sejda' ELSE 'Core Banking' END AS creator,
  CASE c_custkey % 5 WHEN 0 THEN 'iText 2' ELSE 'iText 5' END AS producer, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + (c_custkey % 50 - 2) * INTERVAL 1 DAY AS modified, CAST(c_custkey % 4 AS INT) AS eof_count,
  CAST(c_custkey % 6 + 1 AS INT) AS pages, c_custkey * 7919 % 2000000 + 1000 AS file_size FROM customer"""
SPANS = """SELECT l_orderkey % 300 AS file, CAST(l_linenumber AS INT) AS page, CAST(CAST(l_quantity AS INT) AS STRING) || '.00' AS text,
  CASE WHEN l_partkey % 4 = 0 THEN 'Courier' WHEN l_partkey % 7 = 0 THEN 'Times' ELSE 'Arial' END AS font FROM lineitem"""


def _meta(spark, d):
    return spark.sql(META.replace("FROM customer", "FROM {t}"), t=S.table(spark, d, "customer"))


def _spans(spark, d):
    return spark.sql(SPANS.replace("FROM lineitem", "FROM {t}"), t=S.table(spark, d, "lineitem"))


def metadata_findings(spark, d):
    return I.metadata_findings(_meta(spark, d))


def font_findings(spark, d):
    return I.font_findings(_spans(spark, d))


def batch_outlier_mode(spark, d):
    return I.batch_outliers(_meta(spark, d))


def dominant_profile(spark, d):
    return I.dominant_profile(_meta(spark, d))


def severity_rollup(spark, d):
    return I.summary(I.metadata_findings(_meta(spark, d)).unionByName(I.font_findings(_spans(spark, d))))


def arithmetic_audit(spark, d):
    rows = B.with_running_balance(S.events(spark, d))
    return I.arithmetic_findings(rows.withColumn("balance", F.when(F.col("row_ord") % 97 == 0, F.col("balance") + 500).otherwise(F.col("balance"))))


def repeated_lines(spark, d):
    lines = S.fragments(spark, d).select(F.col("doc_id").alias("file"), F.col("content").alias("text"))
    return I.repeated_lines(lines).select("file", F.sha2("text", 256).alias("sha256"), "n")


def union_reports(spark, d):
    """Accounts of several reports: rows by name, first and last date, distinct banks."""
    a = S.ledger(spark, d).select("account", "date", "bank", "row_ord")
    b = S.events(spark, d).select("account", "date", "row_ord")
    return a.unionByName(b, allowMissingColumns=True).groupBy("account").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.array_join(F.array_sort(F.collect_set("bank")), ",").alias("banks")
    )


def usage_cost(spark, d):
    """Price of token usage joined to a price table, in hundred-thousandths of a unit."""
    prices = spark.sql("SELECT * FROM VALUES ('click', 5, 25), ('view', 3, 15), ('error', 1, 5) AS p(kind, price_in, price_out)")
    e = S.events(spark, d)
    return e.join(F.broadcast(prices), "kind").groupBy("kind").agg(F.sum(F.col("debit") * F.col("price_in") + F.col("row_ord") * F.col("price_out")).alias("cost"))


def totals_cross_product(spark, d):
    """Per account: of candidate totals, those that best meet opening + credits - debits = closing."""
    from pyspark.sql import Window

    m = B.monthly_balances(B.with_running_balance(S.events(spark, d)))
    cand = m.select("account", "month", "opening", "closing", F.explode(F.array(F.col("credits"), F.col("credits") + 100, F.col("debits"))).alias("c"), "debits", "credits")
    cand = cand.withColumn("x", F.explode(F.array(F.col("debits"), F.col("debits") - 100, F.col("credits")))).drop("debits", "credits")
    miss = F.abs(F.col("opening") + F.col("c") - F.col("x") - F.col("closing"))
    best = Window.partitionBy("account", "month").orderBy("miss", "c", "x")
    return cand.withColumn("miss", miss).withColumn("rn", F.row_number().over(best)).where("rn = 1").select("account", "month", "c", "x", "miss")


QUERIES = {f.__name__: f for f in (
    metadata_findings, font_findings, batch_outlier_mode, dominant_profile, severity_rollup, arithmetic_audit, repeated_lines, union_reports, usage_cost, totals_cross_product,
)}

_EDIT = " OR ".join(f"contains(upper(creator || ' ' || producer), '{e}')" for e in I.EDITORS)
_M = f"""WITH m AS (SELECT *, date_diff('second', created, modified) AS gap FROM ({META}) z), mf AS (
  SELECT file, 'HIGH' AS severity, 'made or changed by an editor' AS message FROM m WHERE {_EDIT}
  UNION ALL SELECT file, 'HIGH', 'changed more than 30 days later' FROM m WHERE gap > 2592000
  UNION ALL SELECT file, 'MEDIUM', 'changed more than a day later' FROM m WHERE gap > 86400 AND gap <= 2592000
  UNION ALL SELECT file, 'MEDIUM', 'several incremental saves' FROM m WHERE eof_count > 2
  UNION ALL SELECT file, 'MEDIUM', 'changed before it was made' FROM m WHERE gap < 0
), sp AS ({SPANS}), fo AS (SELECT file, font, count(*) AS n FROM sp GROUP BY ALL), fb AS (
  SELECT *, sum(n) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY n DESC, font) AS rn FROM fo
), ff AS (SELECT file, 'MEDIUM' AS severity, 'mixed fonts in amounts' AS message FROM fb WHERE rn = 1 AND n * 100 < total * 85)"""
_TX = f"WITH tx AS ({S.EVENTS_SQL}), bal AS (SELECT *, CAST(sum(credit - debit) OVER (PARTITION BY account ORDER BY row_ord) AS BIGINT) AS balance FROM tx)"
ORACLES = {
    "metadata_findings": _M + " SELECT file, 'metadata' AS layer, severity, message FROM mf",
    "font_findings": _M + " SELECT file, 'fonts' AS layer, severity, message FROM ff",
    "batch_outlier_mode": f"""WITH m AS (SELECT *, CAST(floor(file_size / pages) AS BIGINT) AS per_page FROM ({META}) z), k AS (
        SELECT bank, list_sort(list(per_page))[len(list(per_page)) // 2 + 1] AS middle, list_sort(list(pages))[len(list(pages)) // 2 + 1] AS usual FROM m GROUP BY bank)
      SELECT file, bank, per_page, middle FROM m JOIN k USING (bank) WHERE per_page > middle * 3 AND NOT (pages <= 2 AND usual >= 4 AND file_size < 600000)""",
    "dominant_profile": f"""WITH m AS ({META}), u AS (SELECT bank, producer AS usual FROM (SELECT bank, producer, count(*) AS n FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY bank ORDER BY n DESC, producer) = 1)
      SELECT file, bank, producer, usual FROM m JOIN u USING (bank) WHERE producer <> usual""",
    "severity_rollup": _M + """, a AS (SELECT * FROM mf UNION ALL SELECT * FROM ff) SELECT file, CASE WHEN bool_or(severity = 'HIGH') THEN 'HIGH' ELSE 'MEDIUM' END AS worst, count(*) AS n_findings,
      count(*) FILTER (severity = 'INFO') AS info_n, count(*) FILTER (severity = 'LOW') AS low_n, count(*) FILTER (severity = 'MEDIUM') AS medium_n, count(*) FILTER (severity = 'HIGH') AS high_n,
      count(*) FILTER (severity = 'CRITICAL') AS critical_n FROM a GROUP BY file""",
    "arithmetic_audit": _TX + """, t AS (SELECT * REPLACE (CASE WHEN row_ord % 97 = 0 THEN balance + 500 ELSE balance END AS balance) FROM bal),
      x AS (SELECT *, lag(balance) OVER (PARTITION BY account ORDER BY row_ord) + credit - debit AS expected FROM t) SELECT account, row_ord, balance, expected FROM x WHERE abs(balance - expected) > 1""",
    "repeated_lines": f"WITH f AS ({S.FRAGMENTS_SQL['duck']}) SELECT doc_id AS file, sha256(content) AS sha256, count(*) AS n FROM f WHERE length(content) >= 40 GROUP BY doc_id, content HAVING count(*) > 1",
    "union_reports": f"""WITH u AS (SELECT account, date, bank FROM ({S.LEDGER_SQL}) a UNION ALL SELECT account, date, NULL FROM ({S.EVENTS_SQL}) b)
      SELECT account, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, coalesce(string_agg(DISTINCT bank, ',' ORDER BY bank), '') AS banks FROM u GROUP BY account""",
    "usage_cost": f"SELECT kind, CAST(sum(debit * price_in + row_ord * price_out) AS BIGINT) AS cost FROM ({S.EVENTS_SQL}) e JOIN (VALUES ('click', 5, 25), ('view', 3, 15), ('error', 1, 5)) p(kind, price_in, price_out) USING (kind) GROUP BY kind",
    "totals_cross_product": _TX + """, m AS (SELECT account, month, CAST(sum(credit) AS BIGINT) AS cr, CAST(sum(debit) AS BIGINT) AS db, arg_max(balance, row_ord) AS closing, arg_min(balance - credit + debit, row_ord) AS fo FROM bal GROUP BY ALL),
      o AS (SELECT *, coalesce(lag(closing) OVER (PARTITION BY account ORDER BY month), fo) AS opening FROM m),
      k AS (SELECT account, month, c, x, abs(opening + c - x - closing) AS miss FROM (SELECT *, unnest([cr, cr + 100, db]) AS c FROM o) p, LATERAL (SELECT unnest([p.db, p.db - 100, p.cr]) AS x))
      SELECT account, month, c, x, miss FROM k QUALIFY row_number() OVER (PARTITION BY account, month ORDER BY miss, c, x) = 1""",
}
