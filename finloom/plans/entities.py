"""Queries over merged names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.operators import entities as E
from finloom.operators import parties as Y
from finloom.sources import tables as S

#: Spellings by remainder of the order key; chains, cut words and buckets among them.
SPELLINGS = (
    "ALPHA MAJU SDN BHD", "ALPHA MAJU", "ALPHA MAJU TRADING", "ALPHA BETA", "OMEGA HOLDINGS", "OMEGA HOLDING", "OMEGA HOLDIN", "THE OMEGA HOLDINGS GROUP",
    "RAHIM BIN OSMAN", "RAHIM BIN OSM", "SITI BINTI ALI", "CASH DEPOSIT", "CASH DEPOSIT MACHINE", "GAMMA SUPPLY NORTH EAST", "GAMMA SUPPLY NORTH EAS",
    "GAMMA SUPPLY NORTH", "PELITA CREDIT LEASING (M)", "PELITA CREDIT LEASING", "NOVA", "NOVA LTD", "KOPERASI WARIS BERSAMA", "WARIS BERSAMA", "ZETA", "BANK FEES",
)
NAMES = f"""SELECT {S._case("o_orderkey", SPELLINGS)} AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderkey AS row_ord FROM orders"""


def _rows(spark, d):
    return spark.sql(NAMES.replace("FROM orders", "FROM {t}"), t=S.table(spark, d, "orders"))


def _names(spark, d):
    return _rows(spark, d).groupBy("name").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("turnover"))


def entity_links(spark, d):
    return E.links(_names(spark, d))


def entity_merge_closure(spark, d):
    """Every spelling with the one that its group of linked spellings is known by."""
    return E.merged(_names(spark, d))


def entity_ledger(spark, d):
    """Sums by survivor: spellings of one party add up, and no amount is lost."""
    rows = _rows(spark, d).withColumn("odd", F.col("row_ord") % 2 == 1)
    book = rows.groupBy(F.col("name").alias("party")).agg(F.sum(F.when(F.col("odd"), F.col("amount")).otherwise(0)).alias("credits"), F.sum(F.when(~F.col("odd"), F.col("amount")).otherwise(0)).alias("debits"), F.count("*").alias("n_rows"))
    return E.ledger_merged(book, E.merged(_names(spark, d)))


def token_subset_merge(spark, d):
    return E.subset_merge(_names(spark, d))


def ledger_nested(spark, d):
    """Per party: totals and the rows themselves as one ordered text, a row an entry."""
    rows = Y.named(S.ledger(spark, d))
    by = rows.groupBy("party", "account", "month").agg(F.sum("credit").alias("c"), F.sum("debit").alias("b"), F.count("*").alias("n"))
    return by.groupBy("party").agg(
        F.sum("c").alias("credits"), F.sum("b").alias("debits"), F.sum("n").alias("n_rows"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("account", "month", "c", "b"))), lambda x: F.concat_ws(":", x["account"], x["month"], x["c"], x["b"])), ";"), 256).alias("entries"),
    )


QUERIES = {f.__name__: f for f in (entity_links, entity_merge_closure, entity_ledger, token_subset_merge, ledger_nested)}

_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(upper(name), '\b(?:SDN|BHD|PTY|LTD|MAL|BER)\b\.?|\(M\)|& CO\b', ' ', 'g'), '[^A-Z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_LIST = ", ".join(f"'{p}'" for p in E.PROTECTED)
_J = "array_to_string(list_slice({}, 1, {}), ' ')"
_N = f"""WITH RECURSIVE x AS ({NAMES}), nm AS (SELECT name, count(*) AS n_rows, CAST(sum(amount) AS BIGINT) AS turnover FROM x GROUP BY name),
k AS (SELECT *, {_KEY} AS key, string_split({_KEY}, ' ') AS w FROM nm WHERE upper(name) NOT IN ({_LIST})), kk AS (SELECT *, coalesce(nullif(list_position(w, 'BIN'), 0), nullif(list_position(w, 'BINTI'), 0)) AS at FROM k),
rl AS (SELECT s.name AS s, l.name AS l, s.key AS sk,
    CASE WHEN s.key = l.key THEN 'M1' END AS m1, CASE WHEN length(s.key) >= 10 AND starts_with(l.key, s.key || ' ') THEN 'M2' END AS m2,
    CASE WHEN s.at > 1 AND l.at > 1 AND {_J.format('s.w', 's.at - 1')} = {_J.format('l.w', 'l.at - 1')} AND length(s.w[s.at + 1]) BETWEEN 3 AND 4 AND starts_with(l.w[l.at + 1], s.w[s.at + 1]) AND length(l.w[l.at + 1]) > length(s.w[s.at + 1]) THEN 'M3' END AS m3,
    CASE WHEN len(s.w) >= 2 AND s.n_rows >= 2 AND len(l.w) > len(s.w) AND contains(' ' || l.key || ' ', ' ' || s.key || ' ') THEN 'M5' END AS m5,
    CASE WHEN len(s.w) >= 2 AND len(s.w) = len(l.w) AND {_J.format('s.w', 'len(s.w) - 1')} = {_J.format('l.w', 'len(l.w) - 1')} AND starts_with(l.w[-1], s.w[-1]) AND length(l.w[-1]) > length(s.w[-1]) AND (length(s.w[-1]) >= 3 OR len(s.w) >= 3) THEN 'M6' END AS m6
  FROM kk s JOIN kk l ON s.name <> l.name),
lk AS (SELECT DISTINCT min(s) OVER (PARTITION BY rule, sk, CASE rule WHEN 'M3' THEN s END) AS a, l AS b FROM (UNPIVOT rl ON m1, m2, m3, m5, m6 INTO NAME z VALUE rule)),
ls AS (SELECT a, b FROM lk WHERE a <> b), ed AS (SELECT a, b FROM ls UNION SELECT b, a FROM ls),
rc AS (SELECT name, name AS root FROM nm UNION SELECT ed.b, rc.root FROM rc JOIN ed ON ed.a = rc.name),
rt AS (SELECT name, min(root) AS root FROM rc GROUP BY name),
sv AS (SELECT name, first_value(name) OVER (PARTITION BY root ORDER BY n_rows DESC, turnover DESC, name) AS survivor FROM rt JOIN nm USING (name))"""
ORACLES = {
    "entity_links": _N + " SELECT a, b FROM ls",
    "entity_merge_closure": _N + " SELECT name, survivor FROM sv",
    "entity_ledger": _N + """ SELECT survivor, CAST(sum(CASE WHEN row_ord % 2 = 1 THEN amount ELSE 0 END) AS BIGINT) AS credits, CAST(sum(CASE WHEN row_ord % 2 = 0 THEN amount ELSE 0 END) AS BIGINT) AS debits, count(*) AS n_rows,
      array_to_string(list_sort(list(DISTINCT name)), ';') AS spellings FROM x JOIN sv USING (name) GROUP BY survivor""",
    "token_subset_merge": f"""WITH x AS ({NAMES}), k AS (SELECT {_KEY} AS key, CAST(sum(amount) AS BIGINT) AS t FROM x GROUP BY 1), b AS (SELECT key, list_distinct(string_split(key, ' ')) AS w FROM k WHERE key <> '' ORDER BY t DESC, key LIMIT 200),
      p AS (SELECT s.key, l.key AS target FROM b s JOIN b l ON length(s.key) >= 6 AND length(l.key) > length(s.key) AND list_has_all(l.w, s.w) QUALIFY row_number() OVER (PARTITION BY s.key ORDER BY length(l.key) DESC, l.key DESC) = 1)
      SELECT k.key, coalesce(target, k.key) AS target FROM k LEFT JOIN p USING (key) WHERE k.key <> ''""",
    "ledger_nested": f"""WITH tx AS ({S.LEDGER_SQL}), n AS (SELECT *, regexp_replace(upper(trim(regexp_replace(counterparty, '\\s+', ' ', 'g'))), '\\s+(SDN\\.?(\\s+B(H(D\\.?)?)?)?|SB)$', ' SDN BHD') AS party FROM tx),
      g AS (SELECT party, account, month, CAST(sum(credit) AS BIGINT) AS c, CAST(sum(debit) AS BIGINT) AS b, count(*) AS k FROM n GROUP BY ALL)
      SELECT party, CAST(sum(c) AS BIGINT) AS credits, CAST(sum(b) AS BIGINT) AS debits, CAST(sum(k) AS BIGINT) AS n_rows, sha256(string_agg(account || ':' || month || ':' || c || ':' || b, ';' ORDER BY account, month, c, b)) AS entries FROM g GROUP BY party""",
}
