"""An addition to the batch operators: windowed sums over a stream of ledger files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum for each key and event-time window; rows later than the watermark are left out of finished windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
