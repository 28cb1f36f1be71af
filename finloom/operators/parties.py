"""Counterparties: ledger, top lists, ghosts, related-party signals, name merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finloom.config import DEFAULT, Settings
from finloom.functions.text import is_person, merge_key, repaired_suffix, squash_upper
from finloom.operators.classify import CHEQUE_BUCKETS, GHOSTS


def named(tx: DataFrame) -> DataFrame:
    """Rows with ``party``: the counterparty with its legal form written out."""
    return tx.withColumn("party", repaired_suffix(F.col("counterparty")))


def without_ghosts(rows: DataFrame, name: str = "party", cheques: bool = True) -> DataFrame:
    """Rows whose name is a party; with ``cheques`` false, cheque and cash buckets stay.  Null names stay."""
    gone = GHOSTS + (CHEQUE_BUCKETS if cheques else ())
    return rows.where(~F.coalesce(squash_upper(F.col(name)).isin(*gone), F.lit(False)))


def ledger(tx: DataFrame) -> DataFrame:
    """Per party: totals and counts by side, net position, months.  Sums start before the shuffle."""
    return named(tx).groupBy("party").agg(
        F.sum("credit").alias("credits"), F.sum("debit").alias("debits"), F.sum(F.col("credit") - F.col("debit")).alias("net"),
        F.count_if(F.col("credit") > 0).alias("credit_rows"), F.count_if(F.col("debit") > 0).alias("debit_rows"), F.count("*").alias("n_rows"),
        F.count_distinct("month").alias("months"),
    )


def month_breakdown(tx: DataFrame) -> DataFrame:
    """Per party: an array of (month, credits, debits, rows) in order of month."""
    by = named(tx).groupBy("party", "month").agg(F.sum("credit").alias("credits"), F.sum("debit").alias("debits"), F.count("*").alias("n_rows"))
    return by.groupBy("party").agg(F.sort_array(F.collect_list(F.struct("month", "credits", "debits", "n_rows"))).alias("months"))


def top(book: DataFrame, amount: str, n: int = 10) -> DataFrame:
    """The n parties of largest ``amount``, ties by name; ghosts stay out."""
    best = without_ghosts(book).where(F.col(amount) > 0).orderBy(F.col(amount).desc(), "party").limit(n)
    return best.select(F.row_number().over(Window.orderBy(F.col(amount).desc(), "party")).alias("place"), "party", F.col(amount).alias("amount"))


def related_signals(tx: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Weighted signals of a related party, score and confidence, per party."""
    rows = without_ghosts(named(tx))
    total = tx.agg(F.sum("debit").alias("gross_debits"))
    round_dr = (F.col("debit") >= settings.rp_round_minimum) & (F.col("debit") % settings.rp_round == 0)
    benefit = (F.col("debit") > 0) & F.rlike(F.upper("description"), F.lit(r"\b(DIRECTOR|ADVANCE|ALLOWANCE|CLAIM)\b"))
    salary = (F.col("debit") > 0) & F.rlike(F.upper("description"), F.lit(r"\b(SALARY|GAJI|PAYROLL)\b"))
    by = rows.groupBy("party").agg(
        F.sum("credit").alias("credits"), F.sum("debit").alias("debits"), F.count_if(F.col("credit") > 0).alias("cr_n"), F.count_if(F.col("debit") > 0).alias("dr_n"),
        F.count_distinct(F.when(F.col("debit") > 0, F.col("month"))).alias("dr_months"), F.count_if(round_dr).alias("round_n"),
        F.count_distinct(F.when(round_dr, F.col("month"))).alias("round_months"), F.count_if(benefit).alias("benefit_n"), F.count_if(salary).alias("salary_n"),
        F.sum(F.when(salary, F.col("debit")).otherwise(0)).alias("salary_sum"),
    )
    # one row of totals
    by = by.crossJoin(F.broadcast(total)).where(~((F.col("salary_n") >= 2) & (F.col("salary_sum") * 100 >= F.col("debits") * settings.salary_recipient_pct)))
    weight = lambda test, w: F.when(test, w).otherwise(0)
    concentrated = (F.col("gross_debits") > 0) & (F.col("debits") * 100 >= F.col("gross_debits") * settings.rp_concentration_pct)
    both = (F.col("cr_n") >= 2) & (F.col("dr_n") >= 2) & (F.least("credits", "debits") * 100 >= F.greatest("credits", "debits") * 5)
    rounds = F.when((F.col("round_n") >= 5) & (F.col("round_months") >= 4), 2).when(F.col("round_n") >= 2, 1).otherwise(0)
    score = weight(concentrated, 2) + weight(F.col("dr_months") >= settings.rp_recurrence_months, 1) + weight(both, 2) + rounds + weight(F.col("benefit_n") > 0, 2)
    person = is_person(F.col("party"))
    level = F.when((F.col("score") >= 3) & (person | (F.col("benefit_n") > 0)), "HIGH").when(F.col("score") >= 2, "MEDIUM").otherwise("LOW")
    return by.withColumn("score", score).withColumn("person", person).withColumn("confidence", level).select(
        "party", "credits", "debits", "dr_months", "round_n", "benefit_n", "score", "person", "confidence"
    )


def merge_links(names: DataFrame) -> DataFrame:
    """name, root: names of equal merge key share the longest spelling, ties by text."""
    keyed = names.withColumn("key", merge_key(F.col("name"))).where("key <> ''")
    best = keyed.groupBy("key").agg(F.max(F.struct(F.length("name"), "name"))["name"].alias("root"))
    return keyed.join(best, "key").select("name", "key", "root")


def own_party(names: DataFrame, root: str) -> DataFrame:
    """Names that hold the company's root, or lie within it with six characters or more."""
    key = F.col("name")
    return names.where(key.contains(root) | ((F.length(key) >= 6) & F.lit(root).contains(key)))
