"""Statement files: binary listing, lines, and the registry of line formats.

A format is data: a pattern with the groups of a transaction line, the form of its
date, and how it prints sides.  One projection parses the lines of every format, so
that a new bank is a row of the registry.  Formats without a side print balances
only; their sides follow from the balance's change (``balance.sides_from_deltas``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.functions.money import parsed_cents
from finloom.functions.text import squash

MONEY = r"-?[\d,]+\.\d{2}"


@dataclass(frozen=True)
class LineFormat:
    """Groups of ``pattern``: date, description, amount, balance.

    ``side``: "sign" (a trailing + or -), "suffix" (CR or DR after the amount) or
    "delta" (by the change of the balance).
    """

    bank: str
    pattern: str
    date_form: str
    side: str


FORMATS = (
    LineFormat("signed", rf"^(\d{{2}}/\d{{2}}/\d{{4}})\s+(.+?)\s+({MONEY}\s*[+-])\s+({MONEY})$", "dd/MM/yyyy", "sign"),
    LineFormat("suffixed", rf"^(\d{{2}}-\d{{2}}-\d{{4}})\s+(.+?)\s+({MONEY}\s*(?:CR|DR))\s+({MONEY})$", "dd-MM-yyyy", "suffix"),
    LineFormat("balanced", rf"^(\d{{2}} [A-Z][a-z]{{2}} \d{{4}})\s+(.+?)\s+({MONEY})\s+({MONEY})$", "dd MMM yyyy", "delta"),
)


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of every file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line of text statements."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def _groups(line: Column, bank: Column, formats: tuple[LineFormat, ...]) -> Column:
    """The four groups of the bank's pattern as an array."""
    out = F.lit(None).cast("array<string>")
    for f in formats:
        out = F.when(bank == f.bank, F.array(*[F.regexp_extract(line, f.pattern, i) for i in range(1, 5)])).otherwise(out)
    return out


def _cells(groups: Column, bank: Column, formats: tuple[LineFormat, ...]) -> Column:
    """date, description, amount, balance and side from the four groups."""
    date, side = F.lit(None).cast("date"), F.lit(None).cast("string")
    for f in formats:
        here = bank == f.bank
        date = F.when(here, F.try_to_timestamp(groups[0], F.lit(f.date_form)).cast("date")).otherwise(date)
        if f.side != "delta":
            mark = "+" if f.side == "sign" else "CR"
            side = F.when(here, F.when(groups[2].endswith(mark), "CR").otherwise("DR")).otherwise(side)
    return F.struct(
        date.alias("date"), squash(groups[1]).alias("description"), F.abs(parsed_cents(groups[2])).alias("amount"),
        parsed_cents(groups[3]).alias("balance"), side.alias("side"),
    )


def parsed(rows: DataFrame, formats: tuple[LineFormat, ...] = FORMATS) -> DataFrame:
    """The columns of ``rows`` (bank, line, ...) with date, description, amount, balance, side; other lines go.

    The line and its groups are bound in lambdas, so that each is evaluated once.
    """
    bank = F.col("bank")
    fits = lambda x: reduce(lambda a, b: a | b, [(bank == f.bank) & F.rlike(x, F.lit(f.pattern)) for f in formats])
    groups = F.transform(F.array("line"), lambda x: _groups(x, bank, formats))
    cells = F.element_at(F.transform(groups, lambda g: _cells(g, bank, formats)), 1)
    return rows.where(F.exists(F.array("line"), fits)).withColumn("cells", cells).select(*rows.columns, "cells.*")
