"""Value changes as a stream: each signal's last value, equal to the batch answer over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_values(changes: DataFrame) -> DataFrame:
    """(sig, t, v) with the greatest (t, v) of each signal; for update or complete mode.

    A built-in aggregate, so the state is one row a signal and late rows are handled by their time, not by arrival.
    """
    return changes.groupBy("sig").agg(F.max(F.struct("t", "v")).alias("m")).select("sig", "m.t", "m.v")


def counts(changes: DataFrame, ticks: int, late: int) -> DataFrame:
    """Changes per signal and window of ``ticks`` microseconds, windows being dropped ``late`` microseconds after their end."""
    at = changes.withColumn("at", F.timestamp_micros("t")).withWatermark("at", f"{late} microseconds")
    rows = at.groupBy("sig", F.window("at", f"{ticks} microseconds").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("sig", F.unix_micros("w.start").alias("start"), "n")
