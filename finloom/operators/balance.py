"""Balances: running, end of day, openings, reconciliation, account type.

``row_ord`` orders the rows of an account in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finloom.config import DEFAULT, Settings


def in_order():
    return Window.partitionBy("account").orderBy("row_ord")


def with_running_balance(tx: DataFrame, opening: int = 0) -> DataFrame:
    return tx.withColumn("balance", F.lit(opening) + F.sum(F.col("credit") - F.col("debit")).over(in_order()))


def sides_from_deltas(tx: DataFrame) -> DataFrame:
    """Debit and credit of rows that only print a balance; the first row of an account has neither."""
    delta = F.col("balance") - F.lag("balance").over(in_order())
    return tx.withColumn("delta", delta).select(
        "account", "row_ord", "balance",
        F.when(F.col("delta") > 0, F.col("delta")).otherwise(0).alias("credit_seen"),
        F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0).alias("debit_seen"),
    )


def end_of_day(tx: DataFrame) -> DataFrame:
    """The last balance of every account and date; rows without balance don't count."""
    known = tx.where("balance IS NOT NULL")
    return known.groupBy("account", "date", "month").agg(F.max_by("balance", "row_ord").alias("eod_balance"))


def eod_statistics(tx: DataFrame, *by: str) -> DataFrame:
    return end_of_day(tx).groupBy(*by).agg(
        F.count("*").alias("eod_days"), F.min("eod_balance").alias("eod_low"), F.max("eod_balance").alias("eod_high"),
        F.sum("eod_balance").cast("bigint").alias("eod_sum"),
    )


def monthly_balances(tx: DataFrame) -> DataFrame:
    """Per account and month: totals, counts, opening, closing, low, high, swing.

    Opening is the closing of the month before that has one, else computed back from
    the first row.
    """
    by = tx.groupBy("account", "month").agg(
        F.sum("credit").alias("credits"), F.sum("debit").alias("debits"),
        F.count_if(F.col("credit") > 0).alias("credit_rows"), F.count_if(F.col("debit") > 0).alias("debit_rows"),
        F.max_by("balance", "row_ord").alias("closing"), F.min("balance").alias("low"), F.max("balance").alias("high"),
        F.min_by(F.col("balance") - F.col("credit") + F.col("debit"), "row_ord").alias("first_opening"),
    )
    months = Window.partitionBy("account").orderBy("month")
    before = F.last("closing", ignorenulls=True).over(months.rowsBetween(Window.unboundedPreceding, -1))
    return by.withColumn("opening", F.coalesce(before, F.col("first_opening"))).withColumn(
        "swing", F.col("high") - F.col("low")
    ).drop("first_opening")


def reconciled(monthly: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Closing against opening plus credits less debits, within the tolerance."""
    expected = F.col("opening") + F.col("credits") - F.col("debits")
    return monthly.select(
        "account", "month", "opening", "closing", expected.alias("expected_closing"), (F.col("closing") - expected).alias("gap"),
        F.when(F.abs(F.col("closing") - expected) <= settings.reconcile_tolerance, "PASS").otherwise("FAIL").alias("status"),
    )


def month_rollup(tx: DataFrame) -> DataFrame:
    """Sums by account and month, by account, and over all."""
    return tx.rollup("account", "month").agg(
        F.sum("credit").alias("credits"), F.sum("debit").alias("debits"), F.count("*").alias("n_rows")
    )


def account_type_votes(tx: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """How many rows follow current-account and overdraft arithmetic, how many are negative, and the verdict."""
    before = F.lag("balance").over(in_order())
    move = F.col("credit") - F.col("debit")
    voted = tx.withColumn("cr", F.abs(F.col("balance") - before - move) <= settings.od_vote_tolerance).withColumn(
        "od", F.abs(F.col("balance") - before + move) <= settings.od_vote_tolerance
    )
    out = voted.groupBy("account").agg(
        F.count_if("cr").alias("cr_rows"), F.count_if("od").alias("od_rows"), F.count("cr").alias("checked"),
        F.count_if(F.col("balance") < 0).alias("negative"), F.count("balance").alias("with_balance"),
    )
    share = lambda a, b, least: F.col(a) >= F.col(b) * least
    kind = (
        F.when((F.col("checked") > 0) & share("od_rows", "checked", settings.row_match_share) & (F.col("od_rows") > F.col("cr_rows")), "OD")
        .when((F.col("with_balance") > 0) & share("negative", "with_balance", settings.negative_share), "OD")
        .when((F.col("checked") > 0) & share("cr_rows", "checked", settings.row_match_share), "CR")
        .otherwise("UNDETERMINED")
    )
    return out.withColumn("account_type", kind)


def upper_medians(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key, ``name``, n: the upper median of the non-null values of every key, exact, from counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("k"))
    totals = counts.groupBy(key).agg(F.sum("k").alias("n"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = counts.withColumn("upto", F.sum("k").over(upto)).join(totals, key).where(F.col("upto") * 2 > F.col("n"))
    return passed.groupBy(key).agg(F.min(value).alias(name), F.first("n").alias("n"))


def without_outliers(tx: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows whose balance lies within the window around the upper median of the account, if it has enough rows."""
    stats = upper_medians(tx, "account", "balance", "middle")
    near = (F.col("n") < settings.outlier_least_rows) | F.col("balance").isNull() | F.col("n").isNull()
    return (
        tx.join(stats, "account", "left")
        .where(near | (F.abs(F.col("balance") - F.col("middle")) <= settings.outlier_window))
        .drop("middle", "n")
    )


def rolled_years(tx: DataFrame) -> DataFrame:
    """Dates of one printed year brought in order: a fall of more than 30 days starts a new year.

    Each fall counts by the printed dates, so the count is a running sum.
    """
    fall = F.datediff(F.lag("printed").over(in_order()), F.col("printed")) > 30
    years = F.sum(F.when(fall, 1).otherwise(0)).over(in_order())
    return tx.withColumn("years", years).withColumn("rolled", F.add_months("printed", (F.col("years") * 12).cast("int")))


def deduplicated(tx: DataFrame, *keys: str) -> DataFrame:
    """The first row, by row_ord, of every fingerprint of ``keys``."""
    mark = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)
    marked = tx.withColumn("fingerprint", mark)
    first = Window.partitionBy("fingerprint").orderBy("row_ord")
    return marked.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
