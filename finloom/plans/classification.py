"""Queries over categories, months and risk, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from finloom.functions import text
from finloom.operators import balance as B
from finloom.operators import classify as C
from finloom.operators import monthly as M
from finloom.sources import tables as S

ROOT = "BINTANG JAYA"


def _rows(spark, d):
    return C.classified(S.ledger(spark, d), companies=(ROOT,), related=S.RELATED, factors=S.FACTORS)


def _pivot(spark, d):
    """Equal narratives of a month are summed before the ladder sees them."""
    sums = C.narrative_sums(S.ledger(spark, d))
    return M.category_pivot(C.classified(sums, companies=(ROOT,), related=S.RELATED, factors=S.FACTORS))


def classify_ladder(spark, d):
    return _rows(spark, d).select("row_ord", "side", "primary", "mode")


def classify_rate_by_category(spark, d):
    return _rows(spark, d).groupBy("primary").agg(F.count("*").alias("n_rows"), F.sum(F.greatest("credit", "debit")).alias("amount"))


def category_pivot(spark, d):
    return _pivot(spark, d)


def net_totals_exclusions(spark, d):
    return M.net_totals(_pivot(spark, d))


def statutory_matrix(spark, d):
    return M.statutory_matrix(_pivot(spark, d))


def _matrix(spark, d):
    """Contributions brought to the size of salaries, so that bands are met."""
    m = M.statutory_matrix(_pivot(spark, d))
    return m.withColumn("epf", F.floor(F.col("epf") / 4).cast("bigint"))


def epf_band_runs(spark, d):
    return M.band_runs(_matrix(spark, d))


def statutory_compliance(spark, d):
    return M.compliance(_matrix(spark, d))


def channel_blind(spark, d):
    return M.channel_blind(S.ledger(spark, d))


def _eod(spark, d):
    return B.eod_statistics(B.with_running_balance(S.ledger(spark, d)), "account", "month")


def credit_overlays(spark, d):
    return M.credit_overlays(S.ledger(spark, d), _eod(spark, d))


def _facts(spark, d):
    """One row per account; categories and compliance come from one pivot, so the ladder runs once."""
    pivot = M.category_pivot(_rows(spark, d), balances=True)
    matrix = M.statutory_matrix(pivot, *[f"{c.lower()}_n" for c in C.SIDES]).withColumn("epf", F.floor(F.col("epf") / 4).cast("bigint"))
    codes = M.compliance(matrix, *[F.sum(f"{c.lower()}_n").alias(f"{c.lower()}_n") for c in C.SIDES])
    marks = credit_overlays(spark, d).groupBy("account").agg(
        F.count_if("large").alias("large_n"), F.count_if("round_figure").alias("round_n"), F.count_if("high_value").alias("high_n")
    )
    months = B.monthly_balances(B.with_running_balance(S.ledger(spark, d)))
    recon = B.reconciled(months).groupBy("account").agg(F.count_if(F.col("status") == "FAIL").alias("failed_months"), F.max_by("closing", "month").alias("last_closing"))
    fx = C.detected(S.ledger(spark, d), C.DETECTORS["detect_fx"]).groupBy("account").agg(F.sum("hits").alias("fx_n"))
    return codes.join(marks, "account", "left").join(recon, "account", "left").join(fx, "account", "left")


def risk_flags(spark, d):
    return M.risk_flags(_facts(spark, d))


def observations(spark, d):
    return M.observations(M.risk_flags(_facts(spark, d)))


def unclassified_listing(spark, d):
    return _rows(spark, d).where(F.col("primary").isNull() & (F.greatest("credit", "debit") >= 1_000_000)).select("row_ord", "account", "credit", "debit")


def own_related_listing(spark, d):
    return _rows(spark, d).where(F.col("primary").isin("C01", "C02", "C03", "C04")).select("row_ord", "account", "primary", "counterparty")


def loan_listing(spark, d):
    return _rows(spark, d).where(F.col("primary").isin("C10", "C11")).select("row_ord", "account", "primary", "mode")


def parsing_metadata(spark, d):
    """Pass rate and gap months per account."""
    r = B.reconciled(B.monthly_balances(B.with_running_balance(S.ledger(spark, d))))
    return r.groupBy("account").agg(F.count("*").alias("months"), F.count_if(F.col("status") == "PASS").alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "FAIL", F.col("month")))), ",").alias("gap_months"))


def dq_counters(spark, d):
    """Per bank: rows without amount, with both sides, footer text, very short narratives."""
    t = S.ledger(spark, d)
    return t.groupBy("bank").agg(
        F.count("*").alias("n_rows"), F.count_if((F.col("credit") == 0) & (F.col("debit") == 0)).alias("zero_rows"),
        F.count_if((F.col("credit") > 0) & (F.col("debit") > 0)).alias("both_sides"), F.count_if(F.rlike("description", F.lit("OPENING|CLOSING"))).alias("footers"),
        F.count_if(F.length("description") < 12).alias("short_text"),
    )


def coverage_semi_anti(spark, d):
    """Salary months with and without a contribution, by semi and anti join."""
    m = M.statutory_matrix(_pivot(spark, d))
    paid, salary = m.where("epf > 0").select("account", "month"), m.where("salary > 0").select("account", "month")
    return salary.join(paid, ["account", "month"], "left_semi").withColumn("covered", F.lit(True)).unionByName(
        salary.join(paid, ["account", "month"], "left_anti").withColumn("covered", F.lit(False))
    )


def month_intersect(spark, d):
    m = M.statutory_matrix(_pivot(spark, d))
    return m.where("salary > 0").select("account", "month").intersect(m.where("socso > 0").select("account", "month"))


def month_except(spark, d):
    m = M.statutory_matrix(_pivot(spark, d))
    return m.where("salary > 0").select("account", "month").exceptAll(m.where("socso > 0").select("account", "month"))


def _detector(rung):
    return lambda spark, d: C.detected(S.ledger(spark, d), rung)


QUERIES = {f.__name__: f for f in (
    classify_ladder, classify_rate_by_category, category_pivot, net_totals_exclusions, statutory_matrix, epf_band_runs, statutory_compliance,
    channel_blind, credit_overlays, risk_flags, observations, unclassified_listing, own_related_listing, loan_listing, parsing_metadata,
    dq_counters, coverage_semi_anti, month_intersect, month_except,
)} | {name: _detector(r) for name, r in C.DETECTORS.items()}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _m(c: str, pattern: str | None) -> str:
    return f"regexp_matches({c}, {_q(pattern)})" if pattern else "false"


def _hit(r: C.Rung) -> str:
    side = "true" if r.side == "ANY" else f"side = '{r.side}'"
    return f"({side} AND {_m('t', r.pattern)} AND NOT {_m('t', r.unless)})"


_WORDS = ", ".join(f"'{w}'" for w in C.JOMPAY_WORDS)
_BILLER = rf"(regexp_matches(t, '^\s*JOMPAY\b') AND len(list_filter(regexp_split_to_array(t, '[\s,/\-]+'), lambda w: regexp_matches(w, '^[A-Z]{{2,}}$') AND w NOT IN ({_WORDS}))) = 0)"


def _ladder_sql() -> str:
    own = f"(t LIKE '%{ROOT}%' OR p LIKE '%{ROOT}%' OR (length(p) >= 6 AND contains('{ROOT}', p)))"
    own_p = f"(p LIKE '%{ROOT}%' OR (length(p) >= 6 AND contains('{ROOT}', p)))"
    memo = f"(p <> '' AND NOT {own_p} AND ({_m('t', C.DISBURSEMENT)} OR {_m('t', C.REPAYMENT)}))"
    rel = " OR ".join(f"contains(t, '{n}') OR contains(p, '{n}')" for n in S.RELATED)
    both = lambda a, b, m: f"CASE WHEN side = 'CR' THEN '{a}/{m}' ELSE '{b}/{m}' END"
    out = [f"WHEN {_m('t', C.BALANCE)} THEN 'C25/KEYWORD'", f"WHEN side IS NOT NULL AND {_m('p', C.OWN_MARKER)} THEN {both('C01', 'C02', 'PARTY')}"]
    out += [f"WHEN side IS NOT NULL AND {own} AND NOT {memo} THEN {both('C01', 'C02', 'PARTY')}", f"WHEN {_hit(C.DETECTORS['detect_salary'])} THEN 'C05/KEYWORD'"]
    out += [f"WHEN side IS NOT NULL AND ({rel}) THEN {both('C03', 'C04', 'PARTY')}"]
    for name, code in C.BUCKETS.items():
        out.append(f"WHEN p = '{name}' AND " + ("side IS NOT NULL" if C.SIDES[code] == "ANY" else f"side = '{C.SIDES[code]}'") + f" THEN '{code}/BUCKET'")
    for r in C.RUNGS:
        if r.code == "C13":
            out.append(f"WHEN side = 'DR' AND {_m('p', C.FINANCIER)} AND NOT {_m('p', C.NO_FINANCIER)} AND NOT {_m('p', C.PERSON)} AND NOT {_m('t', C.FEES)} THEN 'C11/HEURISTIC'")
        test = _hit(r) + (f" AND NOT {_BILLER}" if r.guarded else "") + (f" OR (side = 'CR' AND p IN ({', '.join(map(_q, S.FACTORS))}))" if r.code == "C10" else "")
        out.append(f"WHEN {test} THEN '{r.code}/KEYWORD'")
    out.append(f"WHEN side IS NOT NULL AND {_m('p', text.CORPORATE_ANY)} AND NOT {_m('p', C.PERSON)} THEN {both('C26', 'C27', 'HEURISTIC')}")
    return "CASE " + "\n".join(out) + " END"


TX = f"""WITH tx AS ({S.LEDGER_SQL}), s AS (
  SELECT *, CASE WHEN credit > 0 AND debit <= 0 THEN 'CR' WHEN debit > 0 AND credit <= 0 THEN 'DR' END AS side,
         upper(trim(regexp_replace(description, '\\s+', ' ', 'g'))) AS t, upper(trim(regexp_replace(counterparty, '\\s+', ' ', 'g'))) AS p FROM tx
)"""
ROWS = TX + f""", cl AS (SELECT *, {_ladder_sql()} AS cm FROM s), r AS (
  SELECT *, split_part(cm, '/', 1) AS "primary", nullif(split_part(cm, '/', 2), '') AS mode FROM cl
)"""
_CODES = [c for c in C.SIDES if c != "C25"]
PIVOT = ROWS + """, pv AS (SELECT account, month, CAST(sum(credit) AS BIGINT) AS gross_credits, CAST(sum(debit) AS BIGINT) AS gross_debits, """ + ", ".join(
    f"CAST(sum(CASE WHEN \"primary\" = '{c}' THEN greatest(credit, debit) ELSE 0 END) AS BIGINT) AS {c.lower()}_sum, count(*) FILTER (\"primary\" = '{c}') AS {c.lower()}_n" for c in _CODES
) + """, count(*) FILTER ("primary" IS NULL) AS unclassified FROM r WHERE "primary" IS NULL OR "primary" <> 'C25' GROUP BY account, month)"""
MATRIX = PIVOT + ", mx AS (SELECT account, month, c05_sum AS salary, c06_sum AS epf, c07_sum AS socso, c08_sum AS tax, c09_sum AS hrdf FROM pv), mq AS (SELECT * REPLACE (CAST(floor(epf / 4) AS BIGINT) AS epf) FROM mx)"
COMPLIANCE = MATRIX + """, st AS (
  SELECT account, list_sort(list(DISTINCT month) FILTER (salary > 0)) AS sm, list_sort(list(DISTINCT month) FILTER (epf > 0)) AS em,
         list_sort(list(DISTINCT month) FILTER (socso > 0)) AS om, count(DISTINCT month) FILTER (tax > 0) AS tax_n, count(DISTINCT month) FILTER (hrdf > 0) AS hrdf_n,
         CAST(sum(salary) AS BIGINT) AS salary_total FROM mq GROUP BY account
), co AS (
  SELECT account, coalesce(len(sm), 0) AS salary_n, len(list_filter(coalesce(sm, []), lambda x: list_contains(coalesce(em, []), x))) AS epf_n,
         len(list_filter(coalesce(sm, []), lambda x: list_contains(coalesce(om, []), x))) AS socso_n,
         coalesce(array_to_string(list_filter(coalesce(sm, []), lambda x: NOT list_contains(coalesce(em, []), x)), ','), '') AS epf_missing,
         coalesce(array_to_string(list_filter(coalesce(sm, []), lambda x: NOT list_contains(coalesce(om, []), x)), ','), '') AS socso_missing,
         tax_n, hrdf_n, salary_total, salary_total > 0 AND salary_total <= 3000000 AS subthreshold FROM st
), cs AS (
  SELECT *, CASE WHEN salary_n > 0 AND (epf_n = 0 OR socso_n = 0) THEN CASE WHEN subthreshold THEN 'SUB_THRESHOLD' ELSE 'CRITICAL' END
                 WHEN epf_n = salary_n AND socso_n = salary_n THEN 'COMPLIANT' ELSE 'GAPS_DETECTED' END AS status FROM co
)"""
BAL = f"""WITH tx AS ({S.LEDGER_SQL}), bal AS (SELECT *, CAST(sum(credit - debit) OVER (PARTITION BY account ORDER BY row_ord) AS BIGINT) AS balance FROM tx),
eod AS (SELECT account, date, month, arg_max(balance, row_ord) AS b FROM bal GROUP BY ALL), em AS (SELECT account, month, sum(b) AS s, count(*) AS n FROM eod GROUP BY ALL),
ov AS (SELECT account, row_ord, credit, credit >= 10000000 AS "large", credit >= 1000000 AND credit % 1000000 = 0 AS round_figure,
         coalesce(s > 0 AND CAST(credit AS HUGEINT) * n > 3 * CAST(s AS HUGEINT), false) AS high_value FROM tx LEFT JOIN em USING (account, month) WHERE credit > 0),
mb AS (SELECT account, month, sum(credit) - sum(debit) AS move, arg_max(balance, row_ord) AS closing, arg_min(balance - credit + debit, row_ord) AS fo FROM bal GROUP BY ALL),
mo AS (SELECT *, coalesce(lag(closing) OVER (PARTITION BY account ORDER BY month), fo) AS opening FROM mb),
rc AS (SELECT account, month, closing, CASE WHEN abs(closing - opening - move) <= 100 THEN 'PASS' ELSE 'FAIL' END AS status FROM mo)"""
_FLAGS = (
    "c14_n > 0", "c15_n > 0", "round_n > 0", "high_n > 0", "c17_n > 0", "salary_n > 0 AND epf_n < salary_n", "salary_n > 0 AND socso_n < salary_n", "c08_n > 0", "large_n > 0",
    "c01_n + c02_n > 0", "c03_n + c04_n > 0", "c10_n + c11_n > 0", "failed_months > 0", "fx_n > 0", "last_closing < 100000", "c09_n > 0",
)
FLAGS = COMPLIANCE + ", " + BAL.split(", bal AS", 1)[1].join(["bal AS", ""]) + f""", k AS (
  SELECT account, {", ".join(f'''count(*) FILTER ("primary" = '{c}') AS {c.lower()}_n''' for c in C.SIDES)} FROM r GROUP BY account
), om AS (SELECT account, count(*) FILTER ("large") AS large_n, count(*) FILTER (round_figure) AS round_n, count(*) FILTER (high_value) AS high_n FROM ov GROUP BY account),
rr AS (SELECT account, count(*) FILTER (status = 'FAIL') AS failed_months, arg_max(closing, month) AS last_closing FROM rc GROUP BY account),
fxn AS (SELECT account, count(*) AS fx_n FROM s WHERE {_hit(C.DETECTORS['detect_fx'])} GROUP BY account),
fa AS (SELECT * FROM k LEFT JOIN om USING (account) LEFT JOIN cs USING (account) LEFT JOIN rr USING (account) LEFT JOIN fxn USING (account)),
fl AS ({" UNION ALL ".join(f"SELECT account, {i + 1} AS id, {_q(n)} AS name, coalesce({t}, false) AS detected FROM fa" for i, (n, t) in enumerate(zip(M.FLAG_NAMES, _FLAGS, strict=True)))})"""

ORACLES = {
    "classify_ladder": ROWS + ' SELECT row_ord, side, "primary", mode FROM r',
    "classify_rate_by_category": ROWS + ' SELECT "primary", count(*) AS n_rows, CAST(sum(greatest(credit, debit)) AS BIGINT) AS amount FROM r GROUP BY "primary"',
    "category_pivot": PIVOT + " SELECT * FROM pv",
    "net_totals_exclusions": PIVOT + " SELECT account, month, gross_credits, gross_debits, gross_credits - (c01_sum + c03_sum + c10_sum + c12_sum + c13_sum + c16_sum) AS net_credits, gross_debits - c02_sum AS net_debits FROM pv",
    "statutory_matrix": MATRIX + " SELECT * FROM mx",
    "epf_band_runs": MATRIX + """, b AS (SELECT *, CASE WHEN (epf * 100 BETWEEN salary * 11 AND salary * 15) OR (epf * 100 BETWEEN salary * 20 AND salary * 26) THEN 'OK'
        WHEN epf * 100 < salary * 11 THEN 'WARNING' ELSE 'ABOVE' END AS status FROM mq WHERE salary > 0 AND epf > 0),
      i AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY month) - row_number() OVER (PARTITION BY account, status ORDER BY month) AS g FROM b)
      SELECT account, month, status, CASE WHEN status <> 'ABOVE' THEN status WHEN count(*) OVER (PARTITION BY account, status, g) >= 4 THEN 'STRUCTURAL' ELSE 'CATCH_UP' END AS label FROM i""",
    "statutory_compliance": COMPLIANCE + " SELECT *, CASE WHEN status = 'SUB_THRESHOLD' THEN 'COMPLIANT' ELSE status END AS status_shown FROM cs",
    "channel_blind": TX + r""", c AS (SELECT account, CAST(sum(CASE WHEN regexp_matches(t, '\bCHEQUE\b|\bCHQ\b') THEN debit ELSE 0 END) AS BIGINT) AS cheque_debits, CAST(sum(debit) AS BIGINT) AS debits FROM s GROUP BY account)
      SELECT *, cheque_debits >= 50000000 AND cheque_debits * 100 >= debits * 10 AS channel_blind FROM c""",
    "credit_overlays": BAL + " SELECT * FROM ov",
    "risk_flags": FLAGS + " SELECT * FROM fl",
    "observations": FLAGS + """ SELECT account, coalesce(array_to_string(list_slice(list(name ORDER BY id) FILTER (detected), 1, 8), '; '), '') AS concerns,
      coalesce(array_to_string(list_slice(list(name ORDER BY id) FILTER (NOT detected), 1, 8), '; '), '') AS positives FROM fl GROUP BY account""",
    "unclassified_listing": ROWS + ' SELECT row_ord, account, credit, debit FROM r WHERE "primary" IS NULL AND greatest(credit, debit) >= 1000000',
    "own_related_listing": ROWS + """ SELECT row_ord, account, "primary", counterparty FROM r WHERE "primary" IN ('C01', 'C02', 'C03', 'C04')""",
    "loan_listing": ROWS + """ SELECT row_ord, account, "primary", mode FROM r WHERE "primary" IN ('C10', 'C11')""",
    "parsing_metadata": BAL + " SELECT account, count(*) AS months, count(*) FILTER (status = 'PASS') AS passed, coalesce(string_agg(month, ',' ORDER BY month) FILTER (status = 'FAIL'), '') AS gap_months FROM rc GROUP BY account",
    "dq_counters": TX + """ SELECT bank, count(*) AS n_rows, count(*) FILTER (credit = 0 AND debit = 0) AS zero_rows, count(*) FILTER (credit > 0 AND debit > 0) AS both_sides,
      count(*) FILTER (regexp_matches(description, 'OPENING|CLOSING')) AS footers, count(*) FILTER (length(description) < 12) AS short_text FROM s GROUP BY bank""",
    "coverage_semi_anti": MATRIX + " SELECT account, month, epf > 0 AS covered FROM mx WHERE salary > 0",
    "month_intersect": MATRIX + " SELECT account, month FROM mx WHERE salary > 0 AND socso > 0",
    "month_except": MATRIX + " SELECT account, month FROM mx WHERE salary > 0 AND socso <= 0",
} | {
    name: TX + f" SELECT account, month, count(*) AS hits, CAST(sum(greatest(credit, debit)) AS BIGINT) AS amount, min(row_ord) AS first_row FROM s WHERE {_hit(r)} GROUP BY account, month"
    for name, r in C.DETECTORS.items()
}
