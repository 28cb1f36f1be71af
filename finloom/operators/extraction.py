"""Counterparty names from narratives, by an ordered table of rules.

Every rule has a priority, a pattern, and either a fixed result or the group that
holds the name; the first hit wins.  The table becomes one Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.functions.text import repaired_suffix, squash_upper
from finloom.operators import classify as C


@dataclass(frozen=True)
class NameRule:
    pattern: str
    result: str | None = None
    group: int = 0
    method: str = "pattern"


#: Special buckets come first, then rails with a name behind them, then transfers.
RULES = (
    NameRule(C.CASH_IN, "CASH DEPOSIT", method="special"),
    NameRule(C.CHEQUE_IN, "CHEQUE DEPOSIT", method="special"),
    NameRule(C.CHEQUE_OUT, "CHEQUE ISSUE", method="special"),
    NameRule(C.CASH_OUT, "CASH WITHDRAWAL", method="special"),
    NameRule(C.RETURNED, "RETURNED CHEQUE", method="special"),
    NameRule(C.INWARD_RETURN, "INWARD RETURN", method="special"),
    NameRule(C.REVERSAL, "REVERSAL", method="special"),
    NameRule(r"\b(FD|FIXED DEPOSIT|INTEREST|PROFIT) (CREDIT|PAID|EARNED)\b", "FD/INTEREST", method="special"),
    NameRule(C.FEES, "BANK FEES", method="special"),
    NameRule(C.SALARY, "BULK SALARY", method="special"),
    NameRule(C.DISBURSEMENT, "LOAN DISBURSEMENT", method="special"),
    NameRule(C.REPAYMENT, "LOAN REPAYMENT", method="special"),
    NameRule(C.TAX, "LHDN", method="special"),
    NameRule(C.EPF, "KWSP", method="special"),
    NameRule(C.SOCSO, "SOCSO", method="special"),
    NameRule(C.HRDF, "HRDF", method="special"),
    NameRule(r"^JOMPAY\s+[0-9]+", "JOMPAY BILLER"),
    NameRule(r"^DUITNOW\s+(TRANSFER|PAYMENT|QR)\s+(.+)$", group=2),
    NameRule(r"^(IBG|GIRO|FPX|RENTAS)\s+(PAYMENT|CREDIT|TRANSFER)\s+(.+)$", group=3),
    NameRule(r"^(TRANSFER|PAYMENT)\s+(TO|FROM|FR)\s+(.+)$", group=3),
    NameRule(r"^ADVANCE\s+TO\s+(.+)$", group=1),
)
#: Priority notes that banks add behind the narrative.
TRAILING = r"\s+([1-5]-[A-Z ]+|[0-9]{5,})$"


def extracted(tx: DataFrame, rules: tuple[NameRule, ...] = RULES) -> DataFrame:
    """row_ord, name, method; what no rule fits keeps its narrative as a raw name."""
    t = F.regexp_replace(squash_upper(F.col("description")), TRAILING, "")
    hit: Column | None = None
    for r in rules:
        name = F.lit(r.result) if r.result else repaired_suffix(F.regexp_extract("_t", r.pattern, r.group))
        out = F.struct(name.alias("name"), F.lit(r.method).alias("method"))
        test = F.rlike("_t", F.lit(r.pattern))
        hit = F.when(test, out) if hit is None else hit.when(test, out)
    hit = hit.otherwise(F.struct(F.col("_t").alias("name"), F.lit("raw").alias("method")))
    return tx.withColumn("_t", t).withColumn("_h", hit).select("row_ord", "_h.name", "_h.method")


def statistics(names: DataFrame) -> DataFrame:
    return names.groupBy("method").agg(F.count("*").alias("n_rows"), F.count_distinct("name").alias("n_names"))
