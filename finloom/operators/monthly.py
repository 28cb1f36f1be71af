"""Monthly category sums, statutory compliance, credit overlays, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.config import DEFAULT, Settings
from finloom.operators.classify import SIDES


def by_category(rows: DataFrame) -> DataFrame:
    """Per account, month and category: rows and sums, the only pass over the rows (or narrative sums) that the matrices below need."""
    if "n" in rows.columns:
        return rows.groupBy("account", "month", "primary").agg(*[F.sum(c).alias(c) for c in ("n", "amount", "credits", "debits")])
    return rows.groupBy("account", "month", "primary").agg(
        F.count("*").alias("n"), F.sum(F.greatest("credit", "debit")).alias("amount"), F.sum("credit").alias("credits"), F.sum("debit").alias("debits")
    )


def category_pivot(rows: DataFrame, balances: bool = False) -> DataFrame:
    """Per account and month one sum and one count for every category; rows of balances only count if asked for."""
    codes = [c for c in SIDES if balances or c != "C25"]
    real = by_category(rows)
    if not balances:
        real = real.where("primary IS NULL OR primary <> 'C25'")
    cols = []
    for c in codes:
        here = F.col("primary") == c
        cols += [F.sum(F.when(here, F.col("amount")).otherwise(0)).alias(f"{c.lower()}_sum"), F.sum(F.when(here, F.col("n")).otherwise(0)).alias(f"{c.lower()}_n")]
    return real.groupBy("account", "month").agg(
        F.sum("credits").alias("gross_credits"), F.sum("debits").alias("gross_debits"), *cols,
        F.sum(F.when(F.col("primary").isNull(), F.col("n")).otherwise(0)).alias("unclassified"),
    )


def net_totals(pivot: DataFrame) -> DataFrame:
    """Gross less own-party, related, loan, interest, reversal and returned credits; debits less own-party."""
    taken = F.col("c01_sum") + F.col("c03_sum") + F.col("c10_sum") + F.col("c12_sum") + F.col("c13_sum") + F.col("c16_sum")
    return pivot.select(
        "account", "month", "gross_credits", "gross_debits", (F.col("gross_credits") - taken).alias("net_credits"),
        (F.col("gross_debits") - F.col("c02_sum")).alias("net_debits"),
    )


def statutory_matrix(pivot: DataFrame, *keep: str) -> DataFrame:
    return pivot.select(
        "account", "month", F.col("c05_sum").alias("salary"), F.col("c06_sum").alias("epf"), F.col("c07_sum").alias("socso"),
        F.col("c08_sum").alias("tax"), F.col("c09_sum").alias("hrdf"), *keep,
    )


def epf_status(paid, salary, settings: Settings = DEFAULT):
    """OK within a band, WARNING below the first, ABOVE elsewhere; compared on integers."""
    (a, b), (c, d) = settings.epf_bands
    pct = paid * 100
    ok = (pct >= salary * a) & (pct <= salary * b) | (pct >= salary * c) & (pct <= salary * d)
    return F.when(ok, "OK").when(pct < salary * a, "WARNING").otherwise("ABOVE")


def band_runs(matrix: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Months with salary and contribution, their band, and ABOVE runs: STRUCTURAL from the run length on, else CATCH_UP."""
    overlap = matrix.where("salary > 0 AND epf > 0").withColumn("status", epf_status(F.col("epf"), F.col("salary"), settings))
    months = Window.partitionBy("account").orderBy("month")
    same = Window.partitionBy("account", "status").orderBy("month")
    island = overlap.withColumn("island", F.row_number().over(months) - F.row_number().over(same))
    length = F.count("*").over(Window.partitionBy("account", "status", "island"))
    label = F.when(F.col("status") != "ABOVE", F.col("status")).when(length >= settings.structural_run, "STRUCTURAL").otherwise("CATCH_UP")
    return island.select("account", "month", "status", label.alias("label"))


def compliance(matrix: DataFrame, *more: Column, settings: Settings = DEFAULT) -> DataFrame:
    """Per account: months of salary, those covered by EPF and SOCSO, missing months, and the overall status; ``more`` aggregates."""
    pick = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) > 0, F.col("month"))))
    sets = matrix.groupBy("account").agg(
        *[pick(c).alias(f"{c}_months") for c in ("salary", "epf", "socso", "tax", "hrdf")], F.sum("salary").alias("salary_total"), *more
    )
    n = F.size("salary_months")
    covered = lambda c: F.size(F.array_intersect("salary_months", f"{c}_months"))
    out = sets.select(
        "account", n.alias("salary_n"), covered("epf").alias("epf_n"), covered("socso").alias("socso_n"),
        F.array_join(F.array_sort(F.array_except("salary_months", "epf_months")), ",").alias("epf_missing"),
        F.array_join(F.array_sort(F.array_except("salary_months", "socso_months")), ",").alias("socso_missing"),
        F.size("tax_months").alias("tax_n"), F.size("hrdf_months").alias("hrdf_n"), "salary_total",
        ((F.col("salary_total") > 0) & (F.col("salary_total") <= settings.subthreshold_salary)).alias("subthreshold"), *sets.columns[7:],
    )
    status = (
        F.when((F.col("salary_n") > 0) & ((F.col("epf_n") == 0) | (F.col("socso_n") == 0)), F.when(F.col("subthreshold"), "SUB_THRESHOLD").otherwise("CRITICAL"))
        .when((F.col("epf_n") == F.col("salary_n")) & (F.col("socso_n") == F.col("salary_n")), "COMPLIANT")
        .otherwise("GAPS_DETECTED")
    )
    projected = F.when(status == "SUB_THRESHOLD", "COMPLIANT").otherwise(status)
    return out.withColumn("status", status).withColumn("status_shown", projected)


def channel_blind(tx: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Cheque debits against all debits per account."""
    cheque = F.rlike(F.upper("description"), F.lit(r"\bCHEQUE\b|\bCHQ\b"))
    sums = tx.groupBy("account").agg(F.sum(F.when(cheque, F.col("debit")).otherwise(0)).alias("cheque_debits"), F.sum("debit").alias("debits"))
    blind = (F.col("cheque_debits") >= settings.channel_blind_amount) & (F.col("cheque_debits") * 100 >= F.col("debits") * settings.channel_blind_pct)
    return sums.withColumn("channel_blind", blind)


def credit_overlays(tx: DataFrame, eod: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Credits that are large, round, or above a multiple of the month's mean end-of-day balance.

    ``eod`` has account, month, eod_sum and eod_days; the test is on integers.
    """
    joined = tx.where("credit > 0").join(eod.select("account", "month", "eod_sum", "eod_days"), ["account", "month"], "left")
    high = (F.col("eod_sum") > 0) & (F.col("credit").cast("decimal(38,0)") * F.col("eod_days") > F.col("eod_sum").cast("decimal(38,0)") * settings.high_value_times)
    return joined.select(
        "account", "row_ord", "credit", (F.col("credit") >= settings.large_credit).alias("large"),
        ((F.col("credit") >= settings.round_minimum) & (F.col("credit") % settings.round_multiple == 0)).alias("round_figure"),
        F.coalesce(high, F.lit(False)).alias("high_value"),
    )


#: Names of the flags, in order of their numbers.
FLAG_NAMES = (
    "Returned Cheques (Inward)", "Returned Cheques (Outward)", "Round Figure Credits (AML)", "High Value Credits (>3x EOD)", "Cash Deposits (AML)",
    "EPF Compliance", "SOCSO Compliance", "LHDN Tax Payments", "Large Credits (>=RM100K)", "Own Party Transactions", "Related Party Transactions",
    "Loan Activity", "Data Quality", "FX Transactions", "Low Closing Balance", "HRDF Payments",
)


def risk_flags(facts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Sixteen flags per account as rows (account, id, name, detected).

    ``facts`` has one row per account: sums and counts of the categories, overlay
    counts, compliance counts, failed months, FX rows, and the last closing balance.
    """
    f = F.col
    tests = (
        f("c14_n") > 0, f("c15_n") > 0, f("round_n") > 0, f("high_n") > 0, f("c17_n") > 0,
        (f("salary_n") > 0) & (f("epf_n") < f("salary_n")), (f("salary_n") > 0) & (f("socso_n") < f("salary_n")), f("c08_n") > 0, f("large_n") > 0,
        f("c01_n") + f("c02_n") > 0, f("c03_n") + f("c04_n") > 0, f("c10_n") + f("c11_n") > 0, f("failed_months") > 0, f("fx_n") > 0,
        f("last_closing") < settings.low_closing, f("c09_n") > 0,
    )
    flags = F.array(*[
        F.struct(F.lit(i + 1).alias("id"), F.lit(n).alias("name"), F.coalesce(t, F.lit(False)).alias("detected"))
        for i, (n, t) in enumerate(zip(FLAG_NAMES, tests, strict=True))
    ])
    return facts.select("account", F.explode(flags).alias("x")).select("account", "x.id", "x.name", "x.detected")


def observations(flags: DataFrame, most: int = 8) -> DataFrame:
    """Concerns and positives per account: names of flags that fired and didn't, in order, at most eight each."""
    pick = lambda on: F.slice(F.transform(F.filter("f", lambda x: x["detected"] == on), lambda x: x["name"]), 1, most)
    by = flags.groupBy("account").agg(F.sort_array(F.collect_list(F.struct("id", "name", "detected"))).alias("f"))
    return by.select("account", F.array_join(pick(True), "; ").alias("concerns"), F.array_join(pick(False), "; ").alias("positives"))
