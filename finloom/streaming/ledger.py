"""Streaming forms of batch operators over transaction streams.

Input is a streaming DataFrame with account, row_ord, ts (timestamp), credit and debit.
Watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamped(tx: DataFrame, late: str = "1 day") -> DataFrame:
    return tx.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def daily_close(tx: DataFrame, late: str = "1 day") -> DataFrame:
    """The last balance of every account and day, once the day is beyond the watermark."""
    day = F.window("ts", "1 day")
    return stamped(tx, late).groupBy("account", day.alias("w")).agg(F.max_by("balance", "row_ord").alias("eod_balance")).select(
        "account", F.col("w.start").cast("date").alias("date"), "eod_balance"
    )


def activity(tx: DataFrame, late: str = "1 day", slide: str | None = None, width: str = "1 day") -> DataFrame:
    """Sums per account and tumbling or sliding window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stamped(tx, late).groupBy("account", w.alias("w")).agg(
        F.sum("credit").alias("credits"), F.sum("debit").alias("debits"), F.count("*").alias("n_rows")
    ).select("account", F.col("w.start").alias("start"), "credits", "debits", "n_rows")


def sessions(tx: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return stamped(tx, late).groupBy("account", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_rows")).select(
        "account", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n_rows"
    )


def deduplicated(tx: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return stamped(tx, late).dropDuplicatesWithinWatermark(keys)


def running_balance(tx: DataFrame) -> DataFrame:
    """account, row_ord, balance in order of arrival; one long of state per account."""

    def carry(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        balance = state.get[0] if state.exists else 0
        for f in frames:
            f = f.sort_values("row_ord")
            run = balance + (f["credit"] - f["debit"]).cumsum()
            balance = int(run.iloc[-1]) if len(run) else balance
            yield pd.DataFrame({"account": key[0], "row_ord": f["row_ord"], "balance": run})
        state.update((balance,))

    return tx.groupBy("account").applyInPandasWithState(
        carry, "account long, row_ord long, balance long", "balance long", "append", "NoTimeout"
    )


def returned_transfers(tx: DataFrame, days: int = 9, late: str = "1 day") -> DataFrame:
    """Interval join of outward debits with later credits of the same account and amount."""
    d = stamped(tx, late).where("debit > 0").select(F.col("account").alias("da"), F.col("row_ord").alias("debit_row"), F.col("debit").alias("amount"), F.col("ts").alias("debit_ts"))
    c = stamped(tx, late).where("credit > 0").select("account", F.col("row_ord").alias("credit_row"), "credit", F.col("ts").alias("credit_ts"))
    near = f"account = da AND credit = amount AND credit_ts >= debit_ts AND credit_ts <= debit_ts + INTERVAL {days} DAYS"
    return d.join(c, F.expr(near)).select("account", "debit_row", "credit_row", "amount")
