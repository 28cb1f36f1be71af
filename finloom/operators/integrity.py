"""Document-integrity layers over tables of metadata, spans and totals.

Metadata: file, bank, creator, producer, created, modified (timestamps), eof_count,
pages, file_size, page_size.  Spans: file, page, text, font, size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finloom.operators.balance import upper_medians

# Programs that edit finished documents.
EDITORS = ("PHOTOSHOP", "ILLUSTRATOR", "ACROBAT PRO", "FOXIT", "NITRO", "PDFELEMENT", "SEJDA", "SMALLPDF", "ILOVEPDF", "CANVA", "INKSCAPE", "LIBREOFFICE")
SEVERITY = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def _findings(*tests: tuple[Column, str, str]) -> Column:
    made = F.array(*[F.when(t, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for t, s, m in tests])
    return F.explode(F.array_compact(made))


def metadata_findings(meta: DataFrame) -> DataFrame:
    """Editors, gaps between making and changing, and more than two ends of file."""
    tool = F.upper(F.concat_ws(" ", "creator", "producer"))
    edited = reduce(lambda a, b: a | b, [tool.contains(e) for e in EDITORS])
    gap = F.unix_timestamp("modified") - F.unix_timestamp("created")
    day = 86400
    found = _findings(
        (edited, "HIGH", "made or changed by an editor"), (gap > 30 * day, "HIGH", "changed more than 30 days later"),
        ((gap > day) & (gap <= 30 * day), "MEDIUM", "changed more than a day later"), (F.col("eof_count") > 2, "MEDIUM", "several incremental saves"),
        (gap < 0, "MEDIUM", "changed before it was made"),
    )
    return meta.select("file", F.lit("metadata").alias("layer"), found.alias("f")).select("file", "layer", "f.severity", "f.message")


def font_findings(spans: DataFrame, least_pct: int = 85) -> DataFrame:
    """Files whose money spans share their commonest font by less than ``least_pct``; ties by name."""
    money = spans.where(F.rlike("text", F.lit(r"[0-9]+\.[0-9]{2}")))
    fonts = money.groupBy("file", "font").agg(F.count("*").alias("n"))
    best = Window.partitionBy("file").orderBy(F.col("n").desc(), "font")
    top = fonts.withColumn("total", F.sum("n").over(Window.partitionBy("file"))).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return top.where(F.col("n") * 100 < F.col("total") * least_pct).select(
        "file", F.lit("fonts").alias("layer"), F.lit("MEDIUM").alias("severity"), F.lit("mixed fonts in amounts").alias("message")
    )


def batch_outliers(meta: DataFrame, times: int = 3) -> DataFrame:
    """Files above ``times`` the upper median of bytes per page of their bank, but for thin small ones."""
    per = meta.where("pages > 0").withColumn("per_page", F.floor(F.col("file_size") / F.col("pages")))
    middle = upper_medians(per, "bank", "per_page", "middle").drop("n").join(upper_medians(per, "bank", "pages", "usual_pages").drop("n"), "bank")
    thin = (F.col("pages") <= 2) & (F.col("usual_pages") >= 4) & (F.col("file_size") < 600_000)
    return per.join(middle, "bank").where((F.col("per_page") > F.col("middle") * times) & ~thin).select("file", "bank", "per_page", "middle")


def dominant_profile(meta: DataFrame) -> DataFrame:
    """Files whose producer isn't the commonest of their bank; ties by name."""
    counts = meta.groupBy("bank", "producer").agg(F.count("*").alias("n"))
    best = Window.partitionBy("bank").orderBy(F.col("n").desc(), "producer")
    usual = counts.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("bank", F.col("producer").alias("usual"))
    return meta.join(usual, "bank").where("producer <> usual").select("file", "bank", "producer", "usual")


def arithmetic_findings(rows: DataFrame) -> DataFrame:
    """Rows whose printed balance isn't the one before plus credit less debit, per account."""
    order = Window.partitionBy("account").orderBy("row_ord")
    expected = F.lag("balance").over(order) + F.col("credit") - F.col("debit")
    return rows.withColumn("expected", expected).where(F.abs(F.col("balance") - F.col("expected")) > 1).select("account", "row_ord", "balance", "expected")


def repeated_lines(spans: DataFrame, least: int = 40) -> DataFrame:
    """Long lines that occur more than once in a file."""
    return spans.where(F.length("text") >= least).groupBy("file", "text").agg(F.count("*").alias("n")).where("n > 1")


def summary(findings: DataFrame) -> DataFrame:
    """Per file: the worst severity and how many findings there are of each."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    return findings.groupBy("file").agg(
        F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.max(rank).cast("int")).alias("worst"), F.count("*").alias("n_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"{s.lower()}_n") for s in SEVERITY],
    )
