"""Report sinks: JSON documents, sheets, persisted reports, reminders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: Column, kind: str) -> Column:
    """NaN and infinities as null, which JSON lacks."""
    if kind not in ("double", "float"):
        return c
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def cleaned(df: DataFrame) -> DataFrame:
    return df.select(*[clean(F.col(c), kind).alias(c) for c, kind in df.dtypes])


def section(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """One row per key: the rows of a report section as an array of structs in order."""
    rest = [c for c in cleaned(df).columns if c not in (key, order)]
    rows = F.sort_array(F.collect_list(F.struct(order, *rest)))
    return cleaned(df).groupBy(key).agg(rows.alias(name))


def document(accounts: DataFrame, key: str, sections: list[DataFrame]) -> DataFrame:
    """key, report: every section of an account in one JSON text."""
    out = accounts
    for s in sections:
        out = out.join(s, key, "left")
    return out.select(key, F.to_json(F.struct(*[c for c in out.columns if c != key])).alias("report"))


def write_documents(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def write_sheets(sheets: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """One folder per sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").format(kind).save(f"{path}/{name}")


def persist(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def due_reminders(reports: DataFrame, now: Column, after: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Reports older than an hour, with an address, that nobody was reminded of."""
    return reports.where((F.col("created_at") <= now - F.expr(after)) & F.col("reminder_sent_at").isNull() & F.col("email").isNotNull())
