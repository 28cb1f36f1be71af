"""Queries over nested reports, printed from orders as JSON and read back, with their SQL.

A customer's orders are a report; even ones are printed in the flat version, odd ones in
sections, so that the flat ones are summed by the operator and the others only read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.functions.binding import bound
from finloom.operators import reshape as R
from finloom.sources import tables as S

ROWS = f"""SELECT report, row_number() OVER (PARTITION BY report ORDER BY date, k) - 1 AS pos, 'A' || k % 3 AS account, CASE WHEN k % 2 = 0 THEN 'NORTH' ELSE '' END AS bank, date, substr(date, 1, 7) AS month,
    'ROW ' || k AS description, party, CASE WHEN k % 3 > 0 THEN amount ELSE 0 END AS credit, CASE WHEN k % 3 > 0 THEN 0 ELSE amount END AS debit, CASE WHEN k % 5 > 0 THEN k * 37 % 90000 END AS balance
  FROM (SELECT o_custkey AS report, o_orderkey AS k, substr(CAST(o_orderdate AS STRING), 1, 10) AS date, {S._case("o_orderkey", S.NAMES)} AS party,
    CASE WHEN o_orderkey % 4 = 0 THEN 500000 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS amount FROM orders) o"""
ACCOUNTS = """SELECT report, account, coalesce(min_by(bank, CASE WHEN bank <> '' THEN pos END), '') AS bank, CAST(coalesce(min_by(balance - credit + debit, CASE WHEN balance IS NOT NULL THEN pos END), 0) AS BIGINT) AS opening,
  CAST(coalesce(max_by(balance, CASE WHEN balance IS NOT NULL THEN pos END), 0) AS BIGINT) AS closing, CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits, count(*) AS n_rows FROM {r} GROUP BY report, account"""
MONTHS = """SELECT rep AS report, CAST(row_number() OVER (PARTITION BY rep ORDER BY month) - 1 AS INT) AS place, month, account, credits, debits, lowest, highest, opening, closing, n_rows FROM (
  SELECT report AS rep, month, '' AS account, CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits, CAST(coalesce(min(balance), 0) AS BIGINT) AS lowest,
    CAST(coalesce(max(balance), 0) AS BIGINT) AS highest, CAST(0 AS BIGINT) AS opening, CAST(7 AS BIGINT) AS closing, count(*) AS n_rows FROM {r} GROUP BY report, month) m"""
_SUMS = "SELECT report, '{side}' AS side, party, CAST(sum({c}) AS BIGINT) AS amount, CAST(count(CASE WHEN {c} > 0 THEN 1 END) AS BIGINT) AS n_rows FROM {r} GROUP BY report, party"
_MONTHLY = "SELECT report, '{side}' AS side, party, month, CAST(sum({c}) AS BIGINT) AS m FROM {r} WHERE {c} > 0 GROUP BY report, party, month"
BY_SIDE = " UNION ALL ".join(_SUMS.replace("{side}", s).replace("{c}", c) for s, c in (("payer", "credit"), ("payee", "debit")))
BY_SIDE_AND_MONTH = " UNION ALL ".join(_MONTHLY.replace("{side}", s).replace("{c}", c) for s, c in (("payer", "credit"), ("payee", "debit")))
RANKED = f"SELECT * FROM (SELECT report, side, CAST(row_number() OVER (PARTITION BY report, side ORDER BY amount DESC, party) AS INT) AS rank, party, amount, n_rows, party LIKE '%BINTANG%' OR party LIKE '%JAYA%' AS related FROM ({BY_SIDE}) s) t WHERE rank <= 10"
LARGE = """SELECT * FROM (SELECT report, CAST(row_number() OVER (PARTITION BY report ORDER BY credit DESC, pos) AS INT) AS place, date, description, CAST(credit AS BIGINT) AS amount, CAST(coalesce(balance, 0) AS BIGINT) AS balance, account
  FROM {r} WHERE credit > 0) t WHERE place <= 30"""


def _of(rows: Column, key: str, body) -> Column:
    """One item a value of ``key``, in its order: ``body`` of the value and of its rows, in theirs."""
    values = F.array_sort(F.array_distinct(F.transform(rows, lambda t: t[key])))
    return F.transform(values, lambda v: bound(F.struct(v.alias("v"), F.filter(rows, lambda t: t[key] == v).alias("t")), lambda g: body(g["v"], g["t"])))


def _sum(rows: Column, c: str) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, t: a + t[c])


def _struct(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _months(rows: Column, **names: str) -> Column:
    """The months of the rows with sums and extremes, under the names that a version gives them."""
    shown = lambda t: F.transform(t, lambda r: r["balance"])
    told = lambda m, t: {
        "month": m, "credits": _sum(t, "credit") / 100, "debits": _sum(t, "debit") / 100, "lowest": F.coalesce(F.array_min(shown(t)), F.lit(0)) / 100,
        "highest": F.coalesce(F.array_max(shown(t)), F.lit(0)) / 100, "closing": F.expr("0.07"), "n_rows": F.size(t),
    }
    return _of(rows, "month", lambda m, t: _struct(**{names[k]: v for k, v in told(m, t).items() if k in names}))


def _top(rows: Column, c: str) -> Column:
    """The ten parties of a side by their sums, with those of their months."""
    paid = lambda t: F.filter(t, lambda r: r[c] > 0)
    by_month = lambda t: F.when(F.size(t) > 0, _of(t, "month", lambda m, s: _struct(month=m, amount=_sum(s, c) / 100)))
    parties = F.slice(F.array_sort(_of(rows, "party", lambda p, t: _struct(by=-_sum(t, c), party=p, paid=paid(t)))), 1, 10)
    related = lambda p: F.contains(p, F.lit("BINTANG")) | F.contains(p, F.lit("JAYA"))
    return F.transform(parties, lambda x, i: _struct(rank=i + 1, party_name=x["party"], total_amount=-x["by"] / 100, transaction_count=F.size(x["paid"]), is_related_party=related(x["party"]), monthly_breakdown=by_month(x["paid"])))


def _flat(r: Column, dates: Column) -> Column:
    rows = lambda t: F.transform(t, lambda x: _struct(type=F.when(x["credit"] > 0, "CREDIT").otherwise("debit"), date=x["date"], amount=(x["credit"] + x["debit"]) / 100))
    count = lambda t, c: F.size(F.filter(t, lambda x: x[c] > 0))
    return _struct(
        summary=_struct(company_names=F.array(F.lit(S.COMPANY)), date_range=F.concat(F.array_min(dates), F.lit(" to "), F.array_max(dates))),
        transactions=F.transform(r, lambda t: _struct(account_no=t["account"], bank=t["bank"], date=t["date"], description=t["description"], credit=t["credit"] / 100, debit=t["debit"] / 100, balance=t["balance"] / 100)),
        monthly_summary=_months(r, month="month", credits="total_credit", debits="total_debit", lowest="lowest_balance", highest="highest_balance", closing="ending_balance"),
        counterparty_ledger=_struct(counterparties=_of(r, "party", lambda p, t: _struct(
            counterparty_name=p, total_credits=_sum(t, "credit") / 100, total_debits=_sum(t, "debit") / 100, credit_count=count(t, "credit"), debit_count=count(t, "debit"), transactions=rows(t),
        ))),
    )


def _sectioned(r: Column, dates: Column) -> Column:
    def account(name: Column, t: Column) -> Column:
        shown = F.filter(t, lambda x: x["balance"].isNotNull())
        first, last = F.get(shown, 0), F.try_element_at(shown, F.lit(-1))
        return _struct(
            account_number=name, bank_name=F.coalesce(F.get(F.filter(t, lambda x: x["bank"] != ""), 0)["bank"], F.lit("")), opening_balance=F.coalesce(first["balance"] - first["credit"] + first["debit"], F.lit(0)) / 100,
            closing_balance=F.coalesce(last["balance"], F.lit(0)) / 100, total_credits=_sum(t, "credit") / 100, total_debits=_sum(t, "debit") / 100, transaction_count=F.size(t),
        )

    credits = F.array_sort(F.transform(F.filter(r, lambda t: t["credit"] > 0), lambda t: _struct(by=-t["credit"], pos=t["pos"], t=t)))
    low, high = F.array_min(dates), F.array_max(dates)
    return _struct(
        report_info=_struct(company_name=F.lit(S.COMPANY), period_start=low, period_end=high, total_months=F.size(F.array_distinct(F.transform(r, lambda t: t["month"])))),
        consolidated=_struct(gross_credits=_sum(r, "credit") / 100, gross_debits=_sum(r, "debit") / 100),
        observations=_struct(positive=F.array(high), concerns=F.array(low, F.lit("low"))),
        accounts=_of(r, "account", account),
        monthly_analysis=_months(r, month="month", credits="net_credits", debits="net_debits", lowest="eod_lowest", highest="eod_highest", closing="closing_balance", n_rows="transaction_count"),
        large_credits=F.transform(F.slice(credits, 1, 30), lambda x: _struct(date=x["t"]["date"], description=x["t"]["description"], amount=x["t"]["credit"] / 100, balance=F.coalesce(x["t"]["balance"], F.lit(0)) / 100, account_number=x["t"]["account"])),
        top_parties=_struct(top_payers=_top(r, "credit"), top_payees=_top(r, "debit")),
    )


def reports(spark: SparkSession, d: str) -> DataFrame:
    """report, json: the rows of a report meet once, and its parts are made of them."""
    rows = spark.sql(ROWS.replace("FROM orders", "FROM {t}"), t=S.table(spark, d, "orders"))
    each = rows.groupBy("report").agg(F.sort_array(F.collect_list(F.struct("pos", "account", "bank", "date", "month", "description", "party", "credit", "debit", "balance"))).alias("r"))
    each = each.withColumn("dates", F.transform("r", lambda t: t["date"]))
    printed = lambda form: F.to_json(form(F.col("r"), F.col("dates")))
    return each.select("report", F.when(F.col("report") % 2 == 0, printed(_flat)).otherwise(printed(_sectioned)).alias("json"))


QUERIES = {f"report_{f.__name__}": (lambda spark, d, f=f: f(reports(spark, d))) for f in (R.accounts, R.months, R.totals, R.parties, R.large_credits, R.observations)}


def report_audit(spark, d):
    """Sums that sectioned reports print for an account against those of the rows themselves, which miss some accounts and differ in others."""
    known = R.accounts(reports(spark, d)).select(F.concat_ws("/", "report", "account").alias("file"), "credits", "debits", "opening", "closing")
    parsed = known.where("NOT file LIKE '%1/A1'").select("file", (F.col("credits") + F.when(F.col("file").like("%/A0"), 1).otherwise(2)).alias("credits"), "debits", F.lit(None).cast("long").alias("opening"), "closing")
    return R.audited(known, parsed)


QUERIES["report_audit"] = report_audit

_R = f"WITH r AS ({ROWS}) "
_A = ACCOUNTS.replace("{r}", "r")
_PARTS = f"""SELECT k.report, k.side, k.rank, k.party, k.amount, k.n_rows, k.related, coalesce(string_agg(month || ':' || m, ';' ORDER BY month), '') AS by_month FROM ({RANKED.replace("{r}", "r")}) k
  LEFT JOIN ({BY_SIDE_AND_MONTH.replace("{r}", "r")}) b ON b.report = k.report AND b.side = k.side AND b.party = k.party GROUP BY ALL"""
ORACLES = {
    "report_accounts": _R + _A,
    "report_months": _R + MONTHS.replace("{r}", "r"),
    "report_totals": _R + f"""SELECT report, CASE report % 2 WHEN 0 THEN 'flat' ELSE 'sectioned' END AS version, '{S.COMPANY}' AS company, min(date) AS period_start, max(date) AS period_end, CAST(count(DISTINCT month) AS INT) AS n_months,
      CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits, CAST(round(sum(credit) * 12 / count(DISTINCT month)) AS BIGINT) AS yearly_credits, CAST(round(sum(debit) * 12 / count(DISTINCT month)) AS BIGINT) AS yearly_debits FROM r GROUP BY report""",
    "report_parties": _R + _PARTS,
    "report_large_credits": _R + LARGE.replace("{r}", "r"),
    "report_observations": _R + """SELECT report, 'positive' AS kind, 0 AS place, max(date) AS text FROM r WHERE report % 2 = 1 GROUP BY report
      UNION ALL SELECT report, 'concern', 0, min(date) FROM r WHERE report % 2 = 1 GROUP BY report UNION ALL SELECT DISTINCT report, 'concern', 1, 'low' FROM r WHERE report % 2 = 1""",
    "report_audit": _R + f""", a AS ({_A}), f AS (SELECT report || '/' || account AS file, credits, debits, opening, closing FROM a), p AS (SELECT file, credits + CASE WHEN file LIKE '%/A0' THEN 1 ELSE 2 END AS credits, debits, closing FROM f WHERE NOT file LIKE '%1/A1')
      SELECT f.file, 'credits' AS figure, f.credits AS truth, p.credits AS found, CASE WHEN p.file IS NULL THEN 'NOT_PARSED' WHEN f.file LIKE '%/A0' THEN 'MATCH' ELSE 'DIFFERS' END AS status FROM f LEFT JOIN p USING (file)
      UNION ALL SELECT f.file, 'debits', f.debits, p.debits, CASE WHEN p.file IS NULL THEN 'NOT_PARSED' ELSE 'MATCH' END FROM f LEFT JOIN p USING (file)
      UNION ALL SELECT f.file, 'closing', f.closing, p.closing, CASE WHEN p.file IS NULL THEN 'NOT_PARSED' ELSE 'MATCH' END FROM f LEFT JOIN p USING (file)
      UNION ALL SELECT f.file, 'opening', f.opening, NULL, 'NOT_PARSED' FROM f""",
}
