"""Statement checks on shown figures: sums, identities, ratios, cross sections, structure.

Statements are long rows (entity, period, item, value) in cents; ``shown`` figures are
compared with those recomputed, never trusted.  ``wide`` turns a bounded list of items
into columns, one group per entity and period.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.operators.finstat import TOLERANCE, compared, quotient, ratio_bp

#: Identities of the balance sheet, total = sum of the others.
IDENTITIES = (
    ("total_assets", "non_current_assets", "current_assets"), ("total_liabilities", "non_current_liabilities", "current_liabilities"),
    ("total_equity_and_liabilities", "equity", "total_liabilities"),
)
#: Ratios by name: dividend, divisor.
RATIOS = {
    "current": ("current_assets", "current_liabilities"), "quick": ("quick_assets", "current_liabilities"), "cash": ("cash", "current_liabilities"),
    "liabilities_equity": ("total_liabilities", "equity"), "liabilities_assets": ("total_liabilities", "total_assets"), "gearing": ("borrowings", "equity"),
    "interest_cover": ("ebit", "interest"), "gross_margin": ("gross_profit", "revenue"), "ebit_margin": ("ebit", "revenue"), "pbt_margin": ("pbt", "revenue"),
    "net_margin": ("npat", "revenue"), "ebitda_margin": ("ebitda", "revenue"), "roa": ("npat", "total_assets"), "roe": ("npat", "equity"),
}
RATIO_TOLERANCE = 100


def wide(items: DataFrame, names: Sequence[str]) -> DataFrame:
    return items.groupBy("entity", "period").agg(*[F.max(F.when(F.col("item") == n, F.col("value"))).alias(n) for n in names])


def section_sums(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Shown section totals against the sum of their lines; a total without lines is NOT_ITEMISED unless it is nothing."""
    added = lines.groupBy("entity", "period", "section").agg(F.sum("value").alias("added"), F.count("value").alias("n_lines"))
    joined = totals.join(added, ["entity", "period", "section"], "left")
    bare = F.coalesce(F.col("n_lines"), F.lit(0)) == 0
    status = F.when(bare, F.when(F.abs("shown") > TOLERANCE, "NOT_ITEMISED").otherwise("OK")).otherwise(compared(F.col("added"), F.col("shown")))
    return joined.select("entity", "period", "section", "shown", "added", status.alias("status"))


def identities(sheet: DataFrame) -> DataFrame:
    """The identities, and that both sides balance, as rows with a status; MISSING where a figure isn't shown."""
    rows = [F.struct(F.lit(t).alias("check"), F.col(t).alias("shown"), (F.col(a) + F.col(b)).alias("computed")) for t, a, b in IDENTITIES]
    rows.append(F.struct(F.lit("balances").alias("check"), F.col("total_assets").alias("shown"), F.col("total_equity_and_liabilities").alias("computed")))
    each = sheet.select("entity", "period", F.inline(F.array(*rows)))
    return each.withColumn("status", compared(F.col("computed"), F.col("shown")))


def restated(sheet: DataFrame, copy: DataFrame, *names: str) -> DataFrame:
    """Figures that a copy of the statement gives otherwise than the statement does."""
    both = sheet.alias("s").join(copy.alias("c"), ["entity", "period"])
    rows = F.array(*[F.struct(F.lit(n).alias("item"), F.col(f"s.{n}").alias("stated"), F.col(f"c.{n}").alias("restated")) for n in names])
    return both.select("entity", "period", F.inline(rows)).where(compared(F.col("restated"), F.col("stated")) == "DIFFERS")


def ratio_values(sheet: DataFrame) -> DataFrame:
    """The fourteen ratios of every entity and period in ten-thousandths; null for an empty divisor."""
    return sheet.select("entity", "period", F.inline(F.array(*[F.struct(F.lit(n).alias("ratio"), ratio_bp(F.col(a), F.col(b)).alias("value")) for n, (a, b) in RATIOS.items()])))


def ratio_drift(computed: DataFrame, shown: DataFrame, tolerance: int = RATIO_TOLERANCE) -> DataFrame:
    """Shown ratios with their status against those recomputed."""
    both = computed.join(shown.withColumnRenamed("value", "shown"), ["entity", "period", "ratio"])
    return both.withColumn("status", compared(F.col("value"), F.col("shown"), tolerance))


def turnover_days(sheet: DataFrame) -> DataFrame:
    """Debtor, creditor and inventory days by 365 and by the days that the period has."""
    days = F.when((F.col("period").cast("int") % 4 == 0) & ((F.col("period").cast("int") % 100 != 0) | (F.col("period").cast("int") % 400 == 0)), 366).otherwise(365)
    of = lambda a, b, n: quotient(F.col(a).cast("decimal(38,0)") * n, F.col(b))
    kinds = (("debtor", "receivables", "revenue"), ("creditor", "payables", "cost"), ("inventory", "inventory", "cost"))
    return sheet.select("entity", "period", *[of(a, b, F.lit(365)).alias(f"{k}_days") for k, a, b in kinds], *[of(a, b, days).alias(f"{k}_days_actual") for k, a, b in kinds])


def cross_section(sheet: DataFrame) -> DataFrame:
    """Operating working capital, tangible net worth, funding gap and EBITDA from their parts, each with what is shown."""
    parts = {
        "owc": F.col("receivables") + F.col("inventory") - F.col("payables"), "tnw": F.col("equity") - F.col("intangibles"),
        "funding_gap": F.col("current_assets") - F.col("current_liabilities") - F.col("borrowings"), "ebitda": F.col("ebit") + F.col("depreciation"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("figure"), c.alias("computed"), F.col(f"shown_{n}").alias("shown")) for n, c in parts.items()])
    return sheet.select("entity", "period", F.inline(rows)).withColumn("status", compared(F.col("computed"), F.col("shown")))


def retained(sheet: DataFrame) -> DataFrame:
    """Shown retained earnings against those of the period before, plus profit, less dividends; only pairs of audited periods."""
    order = Window.partitionBy("entity").orderBy("period")
    x = sheet.withColumn("opening", F.lag("retained").over(order)).withColumn("both", F.col("audited") & F.lag("audited").over(order))
    rolled = F.col("opening") + F.col("npat") - F.col("dividends")
    return x.where("both").select("entity", "period", "opening", rolled.alias("rolled"), "retained", compared(rolled, F.col("retained")).alias("status"))


def service_cover(sheet: DataFrame) -> DataFrame:
    """EBITDA over interest and term principal; principal is what is shown, else the fall of term loans since the period before."""
    order = Window.partitionBy("entity").orderBy("period")
    fall = F.greatest(F.coalesce(F.lag("term_loans").over(order) - F.col("term_loans"), F.lit(0)), F.lit(0))
    x = sheet.withColumn("fall", fall)
    paid = F.coalesce("principal_shown", "fall")
    missing = F.col("principal_shown").isNull() & (F.col("fall") > TOLERANCE)
    return x.select("entity", "period", paid.alias("principal"), missing.alias("principal_missing"), ratio_bp(F.col("ebitda"), F.col("interest") + paid).alias("dscr"))


def period_key(period: Column) -> Column:
    """One spelling of a period: FY2024, 2024 (audited) and fy-24 are 2024."""
    digits = F.regexp_extract(period, r"(\d{2,4})", 1)
    return F.when(F.length(digits) == 2, F.concat(F.lit("20"), digits)).otherwise(F.left(digits, F.lit(4)))


def matched_periods(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Figures of two tables on one spelling of the period, unmatched ones of both sides included."""
    a = left.select("entity", period_key(F.col("period")).alias("key"), F.col("value").alias("left_value"))
    b = right.select("entity", period_key(F.col("period")).alias("key"), F.col("value").alias("right_value"))
    l, r = F.col("left_value"), F.col("right_value")
    status = F.when(l.isNull(), "RIGHT_ONLY").when(r.isNull(), "LEFT_ONLY").when(F.abs(l - r) <= tolerance, "OK").otherwise("DIFFERS")
    return a.join(b, ["entity", "key"], "full_outer").withColumn("status", status)


def meets(value: Column, benchmark: Column) -> Column:
    """Whether a value meets a printed benchmark such as ``>= 1.25x`` or ``< 30%``; null for other texts."""
    sign, bound = F.regexp_extract(benchmark, r"^\s*(>=|<=|>|<|=)", 1), F.regexp_extract(benchmark, r"(-?\d+(?:\.\d+)?)", 1).cast("decimal(18,4)")
    v = value.cast("decimal(18,4)")
    return F.when(sign == ">=", v >= bound).when(sign == "<=", v <= bound).when(sign == ">", v > bound).when(sign == "<", v < bound).when(sign == "=", v == bound)


def structure(found: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """Per entity: required items that are missing, items that nobody knows, and the verdict."""
    have = found.groupBy("entity").agg(F.collect_set("item").alias("have"))
    known = lambda xs: F.array(*[F.lit(x) for x in xs])
    text = lambda a: F.array_join(F.array_sort(a), ",")
    lacking = F.array_except(known(required), F.col("have"))
    return have.select("entity", text(lacking).alias("missing"), text(F.array_except("have", known([*required, *optional]))).alias("unknown"), (F.size(lacking) == 0).alias("valid"))


def line_shape(lines: DataFrame) -> DataFrame:
    """Lines with a fault: no label, no value, a borrowing or tax label outside its section, one line that is most of a broad section."""
    label = F.lower("label")
    whole = F.sum(F.abs("value")).over(Window.partitionBy("entity", "period", "section"))
    faults = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("label", F.lit(""))) == "", "NO_LABEL"), F.when(F.col("value").isNull(), "NO_VALUE"),
        F.when(F.rlike(label, F.lit("loan|borrowing|hire purchase")) & ~F.col("section").isin("borrowings"), "BORROWING_ELSEWHERE"),
        F.when(F.rlike(label, F.lit("other|sundry|misc")) & (F.abs("value") * 2 > F.col("whole")), "COARSE"),
    ))
    return lines.withColumn("whole", whole).select("entity", "period", "section", "label", F.array_join(faults, ",").alias("faults")).where("faults <> ''")


def parity(actual: DataFrame, expected: DataFrame, tolerance: int = 0) -> DataFrame:
    """Cells (entity, period, item) that one side lacks or gives otherwise."""
    both = actual.withColumnRenamed("value", "actual").join(expected.withColumnRenamed("value", "expected"), ["entity", "period", "item"], "full_outer")
    kind = F.when(F.col("actual").isNull(), "MISSING").when(F.col("expected").isNull(), "EXTRA").when(F.abs(F.col("actual") - F.col("expected")) > tolerance, "DIFFERS")
    return both.withColumn("kind", kind).where("kind IS NOT NULL")


def suite(**checks: DataFrame) -> DataFrame:
    """check, status, n: how often every check gave each status."""
    each = [c.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(n).alias("check"), "status", "n") for n, c in checks.items()]
    return reduce(DataFrame.unionByName, each)
