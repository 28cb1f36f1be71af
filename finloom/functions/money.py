"""Money as BIGINT cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(c: Column) -> Column:
    """Cents of an amount in units; the one place where floats are rounded."""
    return F.round(c * 100).cast("bigint")


def parsed_cents(c: Column) -> Column:
    """Cents of printed money: commas, RM, brackets, trailing signs, DR and CR; null if it is none."""
    s = F.upper(F.trim(c))
    negative = F.rlike(s, F.lit(r"^\(.*\)$|-$|^-|DR$"))
    digits = F.regexp_replace(s, r"RM|CR$|DR$|[,\s()+-]", "")
    value = F.when(F.rlike(digits, F.lit(r"^([0-9]+(\.[0-9]*)?|\.[0-9]+)$")), digits.cast("decimal(18,2)"))
    whole = (value * 100).cast("bigint")
    return F.when(negative, -whole).otherwise(whole)


def share_pct(part: Column, whole: Column) -> Column:
    """Hundredths of a percent, rounded half up on integers; null for an empty whole."""
    return F.when(whole != 0, F.floor((part * 20000 + whole) / (whole * 2)).cast("bigint"))
