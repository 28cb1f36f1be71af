"""Financial-statement checks: recompute and compare, on integers.

Input is one row per entity and period with figures in cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 200


def profit_chain(f: DataFrame) -> DataFrame:
    """Gross profit, EBIT, profit before and after tax."""
    g = f.withColumn("gross_profit", F.col("revenue") - F.col("cost")).withColumn("ebit", F.col("gross_profit") - F.col("expenses"))
    return g.withColumn("pbt", F.col("ebit") - F.col("interest")).withColumn("npat", F.col("pbt") - F.col("tax"))


def compared(recomputed: Column, shown: Column, tolerance: int = TOLERANCE) -> Column:
    return F.when(recomputed.isNull() | shown.isNull(), "MISSING").when(F.abs(recomputed - shown) <= tolerance, "OK").otherwise("DIFFERS")


def quotient(part: Column, whole: Column) -> Column:
    """part / whole rounded down, exact on integers of any size; null for an empty whole."""
    sign = F.when(whole < 0, -1).otherwise(1)
    p, q = (part * sign).cast("decimal(38,0)"), F.nullif((whole * sign).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return ((p - F.pmod(p, q)) / q).cast("bigint")


def ratio_bp(part: Column, whole: Column) -> Column:
    """A ratio in ten-thousandths, rounded down; null for an empty whole."""
    return quotient(part.cast("decimal(38,0)") * 10000, whole)


def ratios(chain: DataFrame) -> DataFrame:
    """Margins and cover per entity and period, in ten-thousandths."""
    r, named = F.col("revenue"), []
    for name in ("gross_profit", "ebit", "pbt", "npat"):
        named.append(ratio_bp(F.col(name), r).alias(f"{name}_margin"))
    return chain.select("entity", "period", *named, ratio_bp(F.col("ebit"), F.col("interest")).alias("interest_cover"))


def day_counts(f: DataFrame, days: int = 365) -> DataFrame:
    """Tax payable as days of revenue and cost, as debtor and creditor days are."""
    return f.select("entity", "period", *[
        quotient(F.col("tax").cast("decimal(38,0)") * days, F.col(b)).alias(n) for n, b in (("debtor_days", "revenue"), ("creditor_days", "cost"))
    ])


def debt_service(chain: DataFrame) -> DataFrame:
    """EBIT against interest and the fall of borrowings since the period before; a rise counts as no principal."""
    periods = Window.partitionBy("entity").orderBy("period")
    principal = F.greatest(F.coalesce(F.lag("cost").over(periods) - F.col("cost"), F.lit(0)), F.lit(0))
    out = chain.withColumn("principal", principal).withColumn("service", F.col("interest") + F.col("principal"))
    return out.select("entity", "period", "principal", "service", ratio_bp(F.col("ebit"), F.col("service")).alias("dscr"))


def equity_articulation(chain: DataFrame) -> DataFrame:
    """Shown ``retained`` earnings against those shown for the period before, plus the period's profit."""
    periods = Window.partitionBy("entity").orderBy("period")
    rolled = chain.withColumn("opening", F.lag("retained").over(periods))
    return rolled.where("opening IS NOT NULL").select(
        "entity", "period", "opening", "npat", "retained", compared(F.col("opening") + F.col("npat"), F.col("retained")).alias("status")
    )


def missing_periods(f: DataFrame) -> DataFrame:
    """Entity and period combinations without figures: all periods, one small row, less the entity's own."""
    every = f.agg(F.collect_set("period").alias("every"))
    own = f.groupBy("entity").agg(F.collect_set("period").alias("own"))
    return own.join(every).select("entity", F.explode(F.array_except("every", "own")).alias("period"))


def movement(f: DataFrame, item: str) -> DataFrame:
    """Change of an item since the period before, in ten-thousandths of it."""
    periods = Window.partitionBy("entity").orderBy("period")
    before = F.lag(item).over(periods)
    return f.withColumn("before", before).select("entity", "period", F.col(item), "before", ratio_bp(F.col(item) - F.col("before"), F.col("before")).alias("change"))
