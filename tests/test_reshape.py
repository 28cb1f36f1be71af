"""Reports of both versions, on literal texts."""

import json

from pyspark.sql import functions as F

from finloom.operators import reshape as R

FLAT = {
    "summary": {"company_names": ["BINTANG JAYA SDN"], "date_range": "2024-01-02 to 2024-02-03"}, "monthly_summary": [{"month": "2024-01", "total_credit": 15.5, "highest_balance": 9, "lowest_balance": -1}, {"month": "2024-03"}],
    "transactions": [
        {"account_no": "A", "date": "2024-01-02", "credit": 10.1, "balance": None, "description": "one"}, {"account_no": "A", "bank": "NB", "date": "2024-01-03", "credit": 5.4, "debit": 0, "balance": 20, "description": "two"},
        {"account_no": "A", "date": "2024-02-03", "debit": 3, "balance": 17.25}, {"account_no": "", "date": "x", "credit": 10.1, "description": "three"}, {"account_no": "B"},
    ],
    "counterparty_ledger": {"counterparties": [
        {"counterparty_name": "Jaya Ltd", "total_credits": 5, "credit_count": 2, "transactions": [{"type": "credit", "date": "2024-02-01", "amount": 2}, {"type": "CREDIT", "date": "2024-01-01", "amount": 1.5}, {"type": "CREDIT", "date": "2024-02-09", "amount": 1.5}, {"type": "DEBIT", "date": "2024-02-09", "amount": 7}]},
        {"counterparty_name": "Other", "total_credits": 5, "total_debits": 1}, {"counterparty_name": None},
    ]},
}
SECTIONED = {
    "report_info": {"company_name": "X", "period_start": "2024-01", "period_end": "2024-02", "total_months": 3}, "consolidated": {"gross_credits": 100, "gross_debits": 1}, "summary": {"company_names": ["not this"]},
    "accounts": [{"account_number": "Q", "opening_balance": 1.25, "transaction_count": 4}], "monthly_analysis": [{"month": "2024-01", "net_credits": 2, "transaction_count": 9}],
    "top_parties": {"top_payers": [{"rank": 1, "party_name": "P", "total_amount": 3, "is_related_party": True, "monthly_breakdown": [{"month": "2024-01", "amount": 3}]}]},
    "large_credits": [{"date": "2024-01-01", "amount": 3, "account_number": "Q"}], "observations": {"positive": ["fine"], "concerns": ["late", "low"]},
}


def _docs(spark):
    more = [{"observations": ["a", {"type": "Good", "message": "b"}, {"text": ""}, {"category": "risk", "observation": "c"}, ""]}, {"observations": None}, []]
    texts = [json.dumps(x) for x in (FLAT, SECTIONED, *more)] + ["{broken", None, ""]
    return spark.createDataFrame(list(enumerate(texts)), "report int, json string").withColumn("pos", F.lit(1))


def test_both_versions_give_one_frame(spark):
    d = _docs(spark)
    got = lambda df, *cs: sorted(tuple(r) for r in df.select(*cs).collect())
    assert got(R.accounts(d), "report", "account", "bank", "opening", "closing", "credits", "debits", "n_rows") == [(0, "A", "NB", 1460, 1725, 1550, 300, 3), (0, "B", "", 0, 0, 0, 0, 1), (1, "Q", "", 125, 0, 0, 0, 4)]
    assert got(R.months(d), "report", "place", "month", "credits", "lowest", "highest", "n_rows") == [(0, 0, "2024-01", 1550, -100, 900, 2), (0, 1, "2024-03", 0, 0, 0, 0), (1, 0, "2024-01", 200, 0, 0, 9)]
    assert got(R.totals(d), "report", "version", "company", "period_start", "period_end", "n_months", "credits", "debits", "yearly_credits") == [
        (0, "flat", "BINTANG JAYA SDN", "2024-01-02", "2024-02-03", 2, 2560, 300, 15360), (1, "sectioned", "X", "2024-01", "2024-02", 3, 10000, 100, 40000),
    ]
    assert got(R.parties(d).where("side = 'payer'"), "report", "rank", "party", "amount", "n_rows", "related", "by_month") == [
        (0, 1, "Jaya Ltd", 500, 2, True, "2024-01:150;2024-02:350"), (0, 2, "Other", 500, 0, False, ""), (0, 3, "", 0, 0, False, ""), (1, 1, "P", 300, 0, True, "2024-01:300"),
    ]
    assert got(R.parties(d, 1).where("side = 'payee'"), "report", "rank", "party", "by_month") == [(0, 1, "Other", "")]
    assert got(R.large_credits(d, 2), "report", "place", "amount", "description", "balance") == [(0, 1, 1010, "one", 0), (0, 2, 1010, "three", 0), (1, 1, 300, None, 0)]
    assert got(R.observations(d), "report", "kind", "place", "text") == [
        (1, "concern", 0, "late"), (1, "concern", 1, "low"), (1, "positive", 0, "fine"), (2, "concern", 0, "a"), (2, "concern", 3, "c"), (2, "concern", 4, ""), (2, "positive", 1, "b"),
    ]
    none = d.where("report > 90")
    assert [f(none).count() for f in (R.accounts, R.months, R.totals, R.parties, R.large_credits, R.observations)] == [0] * 6


def test_figures_by_period_and_truths(spark):
    items = [{"values": {"24": 5}, "values_standard": {"23": 9}}, {"values": {}, "values_standard": {"23": 9}}, {"amount": {"values": {"23": 7}}}, {}, {"values": {"23": None}}]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "i int, json string")
    item = F.from_json("json", "values map<string,double>, values_standard map<string,double>, amount struct<values:map<string,double>>")
    assert [r[0] for r in rows.withColumn("x", item).orderBy("i").select(R.value_at(F.col("x"), F.lit("23"))).collect()] == [0, 9, 7, 0, 0]
    docs = spark.createDataFrame([(json.dumps({"a.pdf": {"total_credit": 10.5, "ending_balance": 1}, "b.pdf": {"total_debit": 2}}),), (None,)], "json string")
    parsed = spark.createDataFrame([("a.pdf", 1051, 7, 0, 103), ("c.pdf", 1, None, None, None)], "file string, credits long, debits long, opening long, closing long")
    assert {(r.file, r.figure): r.status for r in R.audited(R.truths(docs), parsed).collect()} == {
        ("a.pdf", "credits"): "MATCH", ("a.pdf", "debits"): "NO_TRUTH", ("a.pdf", "opening"): "NO_TRUTH", ("a.pdf", "closing"): "DIFFERS", ("b.pdf", "debits"): "NOT_PARSED", ("c.pdf", "credits"): "NO_TRUTH",
    }


def test_reports_are_printed_by_one_exchange_and_read_in_one_pass(spark, sf_dir):
    from finloom.plans import reports as P

    for name, query in P.QUERIES.items():
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        scans = {"report_audit": 2, "report_observations": 3}.get(name, 1)
        assert plan.count("Scan parquet") == scans and plan.count("from_json") >= 1, name
        if scans == 1:
            assert plan.count("Exchange ") == 1 and "Join" not in plan, name
