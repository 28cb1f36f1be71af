"""Rules on literal rows with the results that they call for."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from finloom.functions import text
from finloom.operators import canonical, checks, classify, closure, entities, finstat, parties, tables

ROWS = "row_ord long, description string, counterparty string, credit long, debit long"
#: narrative, party, credit, debit, category
CASES = (
    ("OPENING BALANCE", "", 0, 0, "C25"), ("TRANSFER", "X (OWN PARTY)", 5, 0, "C01"), ("TRANSFER TO NORTH STAR", "", 0, 5, "C02"), ("SALARY JAN", "", 0, 5, "C05"),
    ("SALARY JAN", "", 5, 0, None), ("SALARY COMMISSION", "", 0, 5, None), ("GAJIJANUARI2024", "", 0, 5, "C05"), ("STAFFID0012 PAY", "", 0, 5, "C05"), ("MENGAJI FEE", "", 0, 5, None),
    ("ADVANCE TO JOHN BIN DOE", "", 0, 5, "C04"), ("ANYTHING", "KWSP", 0, 5, "C06"), ("EPF DPE 12", "", 0, 5, "C06"), ("JOMPAY 37234:EPF 123", "", 0, 5, None),
    ("JOMPAY EPF 123", "", 0, 5, "C06"), ("PERKESO", "", 0, 5, "C07"), ("LHDN PCB", "", 0, 5, "C08"), ("HRDF LEVY", "", 0, 5, "C09"), ("LOAN DISBURSEMENT", "", 5, 0, "C10"),
    ("ANY CREDIT", "FACTOR ONE", 5, 0, "C10"), ("TERM LOAN 3", "", 0, 5, "C11"), ("HANDLING CHRG TERM LOAN", "", 0, 5, "C24"), ("PAYMENT", "ALPHA CREDIT", 0, 5, "C11"),
    ("REVERSAL", "", 5, 0, "C13"), ("RETURNED CHQ", "", 0, 5, "C14"), ("RETURNED CHQ", "", 5, 0, "C15"), ("IBG INWARD RETURN", "", 5, 0, "C16"), ("CDM CASH DEPOSIT", "", 5, 0, "C17"),
    ("CASH CHQ DR", "", 0, 5, "C18"), ("HSE CHQ DEPOSIT", "", 5, 0, "C19"), ("HOUSE CHQ DR", "", 0, 5, "C20"), ("STAMP DUTY", "", 0, 5, "C24"), ("PAYMENT", "DELTA SDN BHD", 0, 5, "C27"),
    ("RECEIPT", "DELTA SDN BHD", 5, 0, "C26"), ("RECEIPT", "DELTA SDN BH", 5, 0, "C26"), ("RECEIPT", "DELTA WORKS SB", 5, 0, "C26"), ("RECEIPT", "DELTABERHAD", 5, 0, "C26"),
    ("RECEIPT", "ALI BIN ABU SDN BHD", 5, 0, None), ("RECEIPT", "DELTA", 5, 0, None), ("RECEIPT", "DELTA SDN BHD", 5, 5, None), (None, None, 5, 0, None),
)


def test_ladder_on_literal_rows(spark):
    rows = [(i, *c[:4]) for i, c in enumerate(CASES)]
    got = classify.classified(spark.createDataFrame(rows, ROWS), companies=("NORTH STAR",), related=("JOHN BIN DOE",), factors=("FACTOR ONE",)).collect()
    assert {CASES[r.row_ord]: r.primary for r in got} == {c: c[4] for c in CASES}


@pytest.mark.parametrize("name,corporate", [("A SDN B", False), ("AB SDN", True), ("SDN", False), ("SB WORKS", False), ("LIMBHD", False), ("FELDABERHAD", True), ("X (M) SDN BHD", True), ("ORDINARY NAME", False), (None, False)])
def test_corporate_suffix(spark, name, corporate):
    assert spark.createDataFrame([(name,)], "n string").select(text.is_corporate(F.col("n"))).first()[0] is corporate


@pytest.mark.parametrize("narrative,code_only", [
    ("JOMPAY 1115:3000104301501 C98QYM94", True), ("  JOMPAY 080018375 D2QL5X4B4333", True), ("JOMPAY DEBIT TRANSFER REF 12345", True), ("JOMPAY AIR 5594520000/ / -", False), ("IWK - JOMPAY BA876095", False),
])
def test_biller_code_guard(spark, narrative, code_only):
    assert spark.createDataFrame([(narrative,)], "n string").select(classify.biller_code_only(F.col("n"))).first()[0] is code_only


def test_ghosts_and_cheque_buckets(spark):
    names = spark.createDataFrame([("transfer  fr a/c",), ("INTERBANK PAYMENT FROM A/C",), ("CASH CHQ DR",), ("TRANSFER FR A/C ALPHA",), (None,)], "party string")
    assert {r.party for r in parties.without_ghosts(names).collect()} == {"TRANSFER FR A/C ALPHA", None}
    assert {r.party for r in parties.without_ghosts(names, cheques=False).collect()} == {"TRANSFER FR A/C ALPHA", "CASH CHQ DR", None}


def test_labels_and_fragments(spark):
    rows = spark.createDataFrame([("UNNAMED NORTH TRANSFER (CR)",), ("Unidentified 12",), ("ALPHA",), ("",), (None,), ("JAN FEB",), ("LOAN REPAYMENT",), ("X",), ("12345",)], "n string")
    got = [(r[0], r[1]) for r in rows.select(canonical.is_synthetic(F.col("n")), canonical.is_fragment(F.col("n"))).collect()]
    assert [a for a, _ in got] == [True, True, False, True, True, False, True, False, False]
    assert [b for _, b in got] == [False, False, False, True, True, True, True, True, True]


def test_missing_periods_reports_gaps(spark):
    f = spark.createDataFrame([(1, "2020"), (1, "2021"), (2, "2020"), (3, "2022")], "entity long, period string")
    assert {(r.entity, r.period) for r in finstat.missing_periods(f).collect()} == {(1, "2022"), (2, "2021"), (2, "2022"), (3, "2020"), (3, "2021")}
    assert finstat.missing_periods(f.limit(0)).isEmpty()


def test_closure_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(200)] + [("x", "y")], "a string, b string")
    got = {r.name: r.root for r in closure.least_labels(links).collect()}
    assert len(got) == 203 and all(v == ("n000" if k.startswith("n") else "x") for k, v in got.items())


def test_names_of_one_first_word_stay_apart(spark):
    names = spark.createDataFrame([("ALPHA MAJU SDN BHD", 5, 10), ("ALPHA BETA SDN BHD", 5, 10), ("ALPHA MAJU (M)", 1, 1), ("BANK FEES", 9, 9)], "name string, n_rows long, turnover long")
    assert {r.name: r.survivor for r in entities.merged(names).collect()} == {
        "ALPHA MAJU SDN BHD": "ALPHA MAJU SDN BHD", "ALPHA MAJU (M)": "ALPHA MAJU SDN BHD", "ALPHA BETA SDN BHD": "ALPHA BETA SDN BHD", "BANK FEES": "BANK FEES"}


def test_articulation_can_fail(spark):
    f = spark.createDataFrame([(1, "2020", 100, 1000), (1, "2021", 500, 1500), (1, "2022", 500, 9000)], "entity long, period string, npat long, retained long")
    assert [r.status for r in finstat.equity_articulation(f).orderBy("period").collect()] == ["OK", "DIFFERS"]


@pytest.mark.parametrize("value,benchmark,met", [("1.30", ">= 1.25x", True), ("1.2", ">= 1.25x", False), ("29", "< 30%", True), ("1", "= 1", True), ("1", "n/a", None), (None, "> 1", None)])
def test_benchmarks(spark, value, benchmark, met):
    assert spark.createDataFrame([(value, benchmark)], "v string, b string").select(checks.meets(F.col("v"), F.col("b"))).first()[0] is met


def test_table_functions_on_texts_without_rows(spark):
    row = spark.createDataFrame([("plain",)], "h string").select(
        tables.sliced(F.col("h"), 0), tables.without_first(F.col("h"), 2), F.size(tables.grid(F.col("h"))), tables.aligned(F.col("h"), F.col("h")), F.size(tables.column_types(F.col("h"), 3))
    ).first()
    assert tuple(row) == ("plain", "plain", 0, True, 0)


def test_python_queries_run_from_another_folder(tmp_path):
    """Workers that don't find the package by their path get it from the session."""
    repo = str(Path(__file__).resolve().parent.parent)
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "from finloom.plans import registry as r\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "for n in ('return_pairs_greedy', 'unkeyworded_pairs', 'repetition_flag'):\n"
        "    print(n, r.QUERIES[n](s, '/root/testdata/sf0.001').count() > 0)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.count("True") == 3, out.stderr[-2000:]


def test_narratives_are_summed_before_the_ladder(spark, sf_dir):
    from finloom.operators import classify as C
    from finloom.operators import monthly as M
    from finloom.plans import classification as P

    texts = [("SALARY JAN", "X"), ("KWSP CARUMAN", None), (None, "OMEGA HOLDINGS"), ("OPENING BALANCE", "X"), ("MISC", "ALI SDN BHD")]
    amounts = [(5, 0), (0, 7), (3, 3), (0, 0), (-4, 9), (None, 2)]
    rows = [(a, m, *t, *x) for a in (1, None) for m in ("2024-01", "2024-02") for t in texts for x in amounts for _ in range(2)]
    tx = spark.createDataFrame(rows, "account long, month string, description string, counterparty string, credit long, debit long")
    plain, summed = (M.category_pivot(C.classified(x, factors=("OMEGA HOLDINGS",)), True) for x in (tx, C.narrative_sums(tx)))
    assert sorted(map(str, plain.collect())) == sorted(map(str, summed.collect())) and plain.count() == 4
    for name in ("coverage_semi_anti", "category_pivot"):
        plan = P.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        ladder = [i for i, x in enumerate(plan) if "Generate inline" in x]
        assert ladder and all(any("Aggregate" in x and "description" in x for x in plan[i : i + 5]) for i in ladder)
