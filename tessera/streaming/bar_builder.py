"""Bars from a stream of ticks: a bar is emitted once the watermark has passed its end, so never while it is open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, rule: str = "1 hour", late: str = "10 minutes", complete: int | None = None) -> DataFrame:
    """ticks: (series, ts timestamp, seq, px). Ties of a time are ordered by seq. complete: bars of fewer ticks are left out."""
    at = F.struct("ts", "seq")
    out = ticks.withWatermark("ts", late).groupBy("series", F.window("ts", rule).alias("w")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.count("*").alias("n")
    )
    out = out.select("series", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")
    return out.filter(F.col("n") >= complete) if complete else out
