"""Queries over shown statement figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.operators import checks as K
from finloom.sources import tables as S

#: A balance sheet and results of every entity and year; some figures are shown wrong or not at all.
SHEET = f"""SELECT entity, period, revenue, cost, interest, expenses, tax, line_count,
  revenue - cost AS gross_profit, revenue - cost - expenses AS ebit, revenue - cost - expenses - interest AS pbt, revenue - cost - expenses - interest - tax AS npat,
  tax AS depreciation, revenue - cost - expenses + tax AS ebitda, cost AS receivables, expenses * 3 AS payables, interest * 5 AS inventory, interest AS cash, tax AS intangibles,
  cost + interest * 6 AS current_assets, cost + interest AS quick_assets, revenue AS non_current_assets, expenses * 4 AS current_liabilities, tax * 2 AS non_current_liabilities, tax * 2 AS borrowings, tax * 2 AS term_loans,
  revenue + cost + interest * 6 - expenses * 4 - tax * 2 AS equity,
  revenue + cost + interest * 6 + CASE WHEN line_count % 5 = 0 THEN 900 ELSE 0 END AS total_assets,
  CASE WHEN line_count % 7 > 0 THEN expenses * 4 + tax * 2 + CASE WHEN line_count % 4 = 0 THEN 150 ELSE 0 END END AS total_liabilities,
  revenue + cost + interest * 6 AS total_equity_and_liabilities,
  cost + interest * 5 - expenses * 3 + CASE WHEN line_count % 3 = 0 THEN 5000 ELSE 0 END AS shown_owc, revenue + cost + interest * 6 - expenses * 4 - tax * 3 AS shown_tnw,
  CASE WHEN line_count % 2 = 0 THEN cost + interest * 6 - expenses * 4 - tax * 2 END AS shown_funding_gap, revenue - cost - expenses AS shown_ebitda,
  revenue * 2 - cost + line_count % 6 * 100 AS retained, CASE WHEN line_count % 2 = 0 THEN interest ELSE 0 END AS dividends, CAST(period AS INT) % 3 > 0 AS audited,
  CASE WHEN line_count % 3 > 0 THEN expenses END AS principal_shown
FROM ({S.FIGURES_SQL}) f"""
LINES = f"""SELECT substr(CAST(l_shipdate AS STRING), 1, 4) AS period, l_suppkey % 25 AS entity, CASE l_linenumber % 4 WHEN 0 THEN 'revenue' WHEN 1 THEN 'cost' WHEN 2 THEN 'borrowings' ELSE 'other' END AS section,
  CASE l_orderkey % 6 WHEN 0 THEN 'Term loan' WHEN 1 THEN 'Other items' WHEN 2 THEN '' WHEN 3 THEN 'Sales' WHEN 4 THEN 'Sundry' ELSE NULL END AS label,
  CASE WHEN l_orderkey % 10 > 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS value FROM lineitem"""
REQUIRED, OPTIONAL = ("revenue", "cost", "equity"), ("borrowings",)
BENCHMARKS = (">= 1.25x", "< 30%", "= 1", "n/a")


def _sql(spark, d, text):
    return spark.sql(text.replace("FROM lineitem", "FROM {t}"), t=S.table(spark, d, "lineitem"))


def _sheet(spark, d):
    return _sql(spark, d, SHEET)


def _lines(spark, d):
    return _sql(spark, d, LINES)


def fin_section_sums(spark, d):
    lines = _lines(spark, d)
    totals = lines.groupBy("entity", "period", "section").agg(F.sum("value").alias("shown")).withColumn("shown", F.coalesce("shown", F.lit(0)) + F.when(F.col("entity") % 4 == 0, 900).otherwise(0))
    return K.section_sums(lines, totals)


def fin_sheet_identities(spark, d):
    return K.identities(_sheet(spark, d))


def fin_restated(spark, d):
    s = _sheet(spark, d)
    copy = s.select("entity", "period", (F.col("total_assets") + F.when(F.col("entity") % 2 == 0, 1000).otherwise(0)).alias("total_assets"), "total_equity_and_liabilities")
    return K.restated(s, copy, "total_assets", "total_equity_and_liabilities")


def fin_ratio_values(spark, d):
    return K.ratio_values(_sheet(spark, d))


def fin_ratio_drift(spark, d):
    v = K.ratio_values(_sheet(spark, d))
    shown = v.select("entity", "period", "ratio", (F.col("value") + F.length("ratio") * F.when(F.col("entity") % 2 == 0, 15).otherwise(5)).alias("value"))
    return K.ratio_drift(v, shown)


def fin_turnover_days(spark, d):
    return K.turnover_days(_sheet(spark, d))


def fin_cross_section(spark, d):
    return K.cross_section(_sheet(spark, d))


def fin_retained(spark, d):
    return K.retained(_sheet(spark, d))


def fin_service_cover(spark, d):
    return K.service_cover(_sheet(spark, d))


def fin_period_match(spark, d):
    s = _sheet(spark, d)
    a = s.select("entity", F.concat(F.lit("FY"), "period").alias("period"), F.col("ebitda").alias("value"))
    b = s.select("entity", F.concat("period", F.lit(" (audited)")).alias("period"), F.col("ebit").alias("value"))
    return K.matched_periods(a, b, 5_000_000)


def fin_benchmarks(spark, d):
    v = K.ratio_values(_sheet(spark, d)).where("ratio IN ('current', 'gearing')")
    mark = F.element_at(F.array(*[F.lit(b) for b in BENCHMARKS]), (F.col("entity") % 4 + 1).cast("int"))
    return v.select("entity", "period", "ratio", mark.alias("benchmark"), K.meets(F.col("value") / 10000, mark).alias("met"))


def fin_structure(spark, d):
    found = _lines(spark, d).select("entity", F.col("section").alias("item"))
    return K.structure(found.unionByName(_sheet(spark, d).select("entity", F.when(F.col("entity") % 2 == 0, "equity").otherwise("shares").alias("item"))), REQUIRED, OPTIONAL)


def fin_line_shape(spark, d):
    return K.line_shape(_lines(spark, d)).groupBy("entity", "period", "section", "faults").agg(F.count("*").alias("n"))


def fin_parity(spark, d):
    s = _sheet(spark, d)
    long = lambda x, *names: x.select("entity", "period", F.inline(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in names])))
    return K.parity(long(s, "revenue", "total_assets"), long(s.withColumn("total_assets", F.col("total_equity_and_liabilities")), "revenue", "total_assets"))


def fin_suite(spark, d):
    s = _sheet(spark, d)
    return K.suite(identities=K.identities(s), cross_section=K.cross_section(s), retained=K.retained(s))


QUERIES = {f.__name__: f for f in (
    fin_section_sums, fin_sheet_identities, fin_restated, fin_ratio_values, fin_ratio_drift, fin_turnover_days, fin_cross_section, fin_retained, fin_service_cover,
    fin_period_match, fin_benchmarks, fin_structure, fin_line_shape, fin_parity, fin_suite,
)}

_S = f"WITH s AS ({SHEET}), ln AS ({LINES})"


def _status(a: str, b: str, tolerance: int = 200) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'MISSING' WHEN abs({a} - {b}) <= {tolerance} THEN 'OK' ELSE 'DIFFERS' END"


def _bp(a: str, b: str) -> str:
    return f"CAST(CASE WHEN {b} <> 0 THEN floor(CAST({a} AS DECIMAL(38, 6)) * 10000 / ({b})) END AS BIGINT)"


_ID = " UNION ALL ".join(
    f"SELECT entity, period, '{n}' AS \"check\", {n2} AS shown, {c} AS computed FROM s"
    for n, n2, c in (
        ("total_assets", "total_assets", "non_current_assets + current_assets"), ("total_liabilities", "total_liabilities", "non_current_liabilities + current_liabilities"),
        ("total_equity_and_liabilities", "total_equity_and_liabilities", "equity + total_liabilities"), ("balances", "total_assets", "total_equity_and_liabilities"),
    )
)
_CR = " UNION ALL ".join(
    f"SELECT entity, period, '{n}' AS figure, {c} AS computed, shown_{n} AS shown FROM s"
    for n, c in (
        ("owc", "receivables + inventory - payables"), ("tnw", "equity - intangibles"), ("funding_gap", "current_assets - current_liabilities - borrowings"), ("ebitda", "ebit + depreciation"),
    )
)
_RT = " UNION ALL ".join(f"SELECT entity, period, '{n}' AS ratio, {_bp(a, b)} AS value FROM s" for n, (a, b) in K.RATIOS.items())
_RE = "re AS (SELECT *, lag(retained) OVER w AS opening, audited AND lag(audited) OVER w AS both_ FROM s WINDOW w AS (PARTITION BY entity ORDER BY period)), rt AS (SELECT entity, period, opening, opening + npat - dividends AS rolled, retained FROM re WHERE both_)"
_LEAP = "(CASE WHEN CAST(period AS INT) % 4 = 0 AND (CAST(period AS INT) % 100 <> 0 OR CAST(period AS INT) % 400 = 0) THEN 366 ELSE 365 END)"
_DAYS = ", ".join(f"CAST(CASE WHEN {b} <> 0 THEN CAST({a} AS HUGEINT) * {n} // {b} END AS BIGINT) AS {k}_days{x}" for x, n in (("", "365"), ("_actual", _LEAP)) for k, a, b in (("debtor", "receivables", "revenue"), ("creditor", "payables", "cost"), ("inventory", "inventory", "cost")))
ORACLES = {
    "fin_section_sums": _S + f""", t AS (SELECT entity, period, section, g + CASE WHEN entity % 4 = 0 THEN 900 ELSE 0 END AS shown FROM (SELECT entity, period, section, coalesce(sum(value), 0)::BIGINT AS g FROM ln GROUP BY ALL)),
      a AS (SELECT entity, period, section, sum(value)::BIGINT AS added, count(value) AS n FROM ln GROUP BY ALL)
      SELECT entity, period, section, shown, added, CASE WHEN coalesce(n, 0) = 0 THEN CASE WHEN abs(shown) > 200 THEN 'NOT_ITEMISED' ELSE 'OK' END ELSE {_status('added', 'shown')} END AS status FROM t LEFT JOIN a USING (entity, period, section)""",
    "fin_sheet_identities": _S + f', i AS ({_ID}) SELECT *, {_status("computed", "shown")} AS status FROM i',
    "fin_restated": _S + " SELECT entity, period, 'total_assets' AS item, total_assets AS stated, total_assets + 1000 AS restated FROM s WHERE entity % 2 = 0",
    "fin_ratio_values": _S + ", " + f"v AS ({_RT}) SELECT * FROM v",
    "fin_ratio_drift": _S + f", v AS ({_RT}), w AS (SELECT *, value + length(ratio) * CASE WHEN entity % 2 = 0 THEN 15 ELSE 5 END AS shown FROM v) SELECT entity, period, ratio, value, shown, {_status('value', 'shown', 100)} AS status FROM w",
    "fin_turnover_days": _S + f" SELECT entity, period, {_DAYS} FROM s",
    "fin_cross_section": _S + f", c AS ({_CR}) SELECT *, {_status('computed', 'shown')} AS status FROM c",
    "fin_retained": _S + f", {_RE} SELECT *, {_status('rolled', 'retained')} AS status FROM rt",
    "fin_service_cover": _S + f""", p AS (SELECT *, greatest(coalesce(lag(term_loans) OVER (PARTITION BY entity ORDER BY period) - term_loans, 0), 0) AS fall FROM s), q AS (SELECT *, coalesce(principal_shown, fall) AS paid FROM p)
      SELECT entity, period, paid AS principal, principal_shown IS NULL AND fall > 200 AS principal_missing, {_bp('ebitda', 'interest + paid')} AS dscr FROM q""",
    "fin_period_match": _S + """, a AS (SELECT entity, period AS key, ebitda AS left_value FROM s), b AS (SELECT entity, period AS key, ebit AS right_value FROM s)
      SELECT *, CASE WHEN left_value IS NULL THEN 'RIGHT_ONLY' WHEN right_value IS NULL THEN 'LEFT_ONLY' WHEN abs(left_value - right_value) <= 5000000 THEN 'OK' ELSE 'DIFFERS' END AS status FROM a FULL JOIN b USING (entity, key)""",
    "fin_benchmarks": _S + f""", v AS ({_RT}) SELECT entity, period, ratio, list_extract(['>= 1.25x', '< 30%', '= 1', 'n/a'], CAST(entity % 4 + 1 AS INT)) AS benchmark,
      CASE entity % 4 WHEN 0 THEN value >= 12500 WHEN 1 THEN value < 300000 WHEN 2 THEN value = 10000 END AS met FROM v WHERE ratio IN ('current', 'gearing')""",
    "fin_structure": _S + """, f AS (SELECT entity, section AS item FROM ln UNION SELECT entity, CASE WHEN entity % 2 = 0 THEN 'equity' ELSE 'shares' END FROM s), g AS (SELECT entity, list(DISTINCT item) AS h FROM f GROUP BY entity)
      SELECT entity, array_to_string(list_sort(list_filter(['revenue', 'cost', 'equity'], lambda x: NOT list_contains(h, x))), ',') AS missing, array_to_string(list_sort(list_filter(h, lambda x: x NOT IN ('revenue', 'cost', 'equity', 'borrowings'))), ',') AS unknown,
        list_has_all(h, ['revenue', 'cost', 'equity']) AS valid FROM g""",
    "fin_line_shape": _S + """, w AS (SELECT *, sum(abs(value)) OVER (PARTITION BY entity, period, section) AS whole FROM ln),
      x AS (SELECT entity, period, section, concat_ws(',', CASE WHEN coalesce(trim(label), '') = '' THEN 'NO_LABEL' END, CASE WHEN value IS NULL THEN 'NO_VALUE' END, CASE WHEN label = 'Term loan' AND section <> 'borrowings' THEN 'BORROWING_ELSEWHERE' END,
        CASE WHEN label IN ('Other items', 'Sundry') AND abs(value) * 2 > whole THEN 'COARSE' END) AS faults FROM w) SELECT *, count(*) AS n FROM x WHERE faults <> '' GROUP BY ALL""",
    "fin_parity": _S + """, a AS (SELECT entity, period, 'revenue' AS item, revenue AS actual FROM s UNION ALL SELECT entity, period, 'total_assets', total_assets FROM s),
      b AS (SELECT entity, period, 'revenue' AS item, revenue AS expected FROM s UNION ALL SELECT entity, period, 'total_assets', total_equity_and_liabilities FROM s),
      j AS (SELECT *, CASE WHEN actual IS NULL THEN 'MISSING' WHEN expected IS NULL THEN 'EXTRA' WHEN actual <> expected THEN 'DIFFERS' END AS kind FROM a FULL JOIN b USING (entity, period, item)) SELECT * FROM j WHERE kind IS NOT NULL""",
    "fin_suite": _S + f""", {_RE}, z AS (SELECT 'identities' AS "check", {_status('computed', 'shown')} AS status FROM ({_ID}) UNION ALL SELECT 'cross_section', {_status('computed', 'shown')} FROM ({_CR}) UNION ALL SELECT 'retained', {_status('rolled', 'retained')} FROM rt)
      SELECT "check", status, count(*) AS n FROM z GROUP BY ALL""",
}
