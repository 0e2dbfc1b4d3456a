"""Cleansing, completeness and strict resampling of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
HOUR = 3600


def normalize_ohlc(df: DataFrame, seq: str) -> DataFrame:
    """Names in any case to lower case, doubles, the last row by seq of a timestamp, then no nulls and no incoherent bars."""
    lower = {c.lower(): c for c in df.columns}
    if missing := [c for c in (*PRICES, "ts") if c not in lower]:
        raise ValueError(f"missing columns: {missing}")
    cols = [F.nanvl(F.col(lower[c]).cast("double"), F.lit(None)).alias(c) for c in (*PRICES, *(["volume"] if "volume" in lower else []))]
    series = F.col("series") if "series" in lower else F.lit("all")
    rows = df.select(series.alias("series"), F.col(lower["ts"]).alias("ts"), *cols, F.col(seq).alias("_s")).filter("ts IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("series", "ts").orderBy(F.desc("_s")))
    rows = rows.withColumn("_r", last).filter("_r = 1").drop("_r", "_s").dropna(subset=list(PRICES))
    return rows.filter((F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")))


def epoch(ts="ts"):
    """Seconds since 1970 of a timestamp without zone (which is UTC)."""
    return F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts)


def at_epoch(seconds):
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def gap_report(bars: DataFrame, step: int = HOUR) -> DataFrame:
    gap = epoch() - F.lag(epoch()).over(Window.partitionBy("series").orderBy("ts"))
    return bars.select("series", "ts", gap.alias("gap")).groupBy("series").agg(
        F.count("*").alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("gap") > step).alias("n_gaps"),
        F.coalesce(F.max(F.when(F.col("gap") > step, F.col("gap"))), F.lit(0)).alias("max_gap_seconds"),
    )


def missing_bars(bars: DataFrame, step: int = HOUR) -> DataFrame:
    """Times of the grid from first to last that no bar has."""
    ends = bars.groupBy("series").agg(F.min(epoch()).alias("a"), F.max(epoch()).alias("b"))
    grid = ends.select("series", F.explode(F.sequence("a", "b", F.lit(step).cast("bigint"))).alias("s")).select("series", at_epoch("s").alias("ts"))
    return grid.join(bars.select("series", "ts"), ["series", "ts"], "left_anti")


def session_missing(bars: DataFrame, holidays=(), weekdays=(2, 3, 4, 5, 6)) -> DataFrame:
    """Business days (Spark's dayofweek, 1 is Sunday) from first to last without a bar, holidays apart."""
    ends = bars.groupBy("series").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    days = ends.select("series", F.explode(F.sequence("a", "b")).alias("day")).filter(F.dayofweek("day").isin(*weekdays))
    if holidays:
        days = days.filter(~F.col("day").isin(*holidays))
    return days.join(bars.select("series", F.to_date("ts").alias("day")).distinct(), ["series", "day"], "left_anti")


def session_grid(days: DataFrame, start: str, end: str, zone: str, step: int, bar_label: str = "start") -> DataFrame:
    """The bars that sessions have: (series, day) to (series, ts) from the session's start to its end by a market's clock, in
    UTC, so across changes of its offset. bar_label start leaves the end out, end leaves the start out."""
    if bar_label not in ("start", "end"):
        raise ValueError("bar_label is start or end")
    at = lambda clock: F.to_utc_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.lit(clock)).cast("timestamp_ntz").cast("timestamp"), zone)
    a, b = F.unix_timestamp(at(start)), F.unix_timestamp(at(end))
    first, last = (a, b - step) if bar_label == "start" else (a + step, b)
    return days.select("series", F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))).alias("s")).select("series", at_epoch("s").alias("ts"))


def business_days(bars: DataFrame, zone: str = "UTC", holidays=(), weekdays=(2, 3, 4, 5, 6)) -> DataFrame:
    """(series, day) of each series' first to last day by a market's clock, without weekends and holidays."""
    local = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))
    ends = bars.groupBy("series").agg(F.min(local).alias("a"), F.max(local).alias("b"))
    days = ends.select("series", F.explode(F.sequence("a", "b")).alias("day")).filter(F.dayofweek("day").isin(*weekdays))
    return days.filter(~F.col("day").isin(*holidays)) if holidays else days


def completeness(bars: DataFrame, grid: DataFrame) -> dict[str, DataFrame]:
    """missing, unexpected and duplicated times against a grid, clipped to the bars' first and last time, and a summary
    with nat_rows (times that aren't) and is_complete. bars may hold all of these faults."""
    known = bars.filter("ts IS NOT NULL").select("series", "ts")
    ends = known.groupBy("series").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    clipped = grid.join(F.broadcast(ends), "series").filter("ts >= _a AND ts <= _b").select("series", "ts")
    found = {"missing": clipped.join(known, ["series", "ts"], "left_anti"), "unexpected": known.distinct().join(clipped, ["series", "ts"], "left_anti"), "duplicated": duplicated(known)}
    out = bars.groupBy("series").agg(F.count_if(F.col("ts").isNull()).alias("nat_rows"))
    for name, df in found.items():
        out = out.join(df.groupBy("series").agg(F.count("*").alias(f"n_{name}")), "series", "left").fillna(0, [f"n_{name}"])
    return found | {"summary": out.withColumn("is_complete", F.expr("nat_rows + n_missing + n_unexpected + n_duplicated = 0"))}


def hour_grid(bars: DataFrame, step: int = HOUR) -> DataFrame:
    """Every step from a series' first time to its last."""
    ends = bars.filter("ts IS NOT NULL").groupBy("series").agg(F.min(epoch()).alias("a"), F.max(epoch()).alias("b"))
    return ends.select("series", F.explode(F.sequence("a", "b", F.lit(step).cast("bigint"))).alias("s")).select("series", at_epoch("s").alias("ts"))


def duplicated(df: DataFrame) -> DataFrame:
    return df.groupBy("series", "ts").agg(F.count("*").alias("n")).filter("n > 1")


def recovered(missing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing times that new data has, and those still missing."""
    return missing.join(new.select("series", "ts"), ["series", "ts"], "left_semi"), missing.join(new.select("series", "ts"), ["series", "ts"], "left_anti")


def merge_datasets(old: DataFrame, new: DataFrame, prefer: str = "old") -> DataFrame:
    order = F.col("_p") if prefer == "old" else F.desc("_p")
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("series", "ts").orderBy(order))).filter("_r = 1").drop("_r", "_p")


def _bucketed(bars: DataFrame, rule: int) -> DataFrame:
    return bars.withColumn("_b", epoch() - F.pmod(epoch(), F.lit(rule)))


def _aggregated(df: DataFrame) -> DataFrame:
    return df.groupBy("series", "_b").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("n"),
    )


def resample_loose(bars: DataFrame, rule: int) -> DataFrame:
    """Partial buckets stay: the last one may look ahead of its close."""
    return _aggregated(_bucketed(bars, rule)).select("series", at_epoch("_b").alias("ts"), *PRICES, "volume", "n")


def resample_strict(bars: DataFrame, rule: int, base: int = HOUR) -> DataFrame:
    """Buckets since the epoch with every bar there; nothing is filled."""
    if rule % base:
        raise ValueError("rule must be a multiple of base")
    aligned = _bucketed(bars.filter(F.pmod(epoch(), F.lit(base)) == 0), rule)
    return _aggregated(aligned).filter(F.col("n") == rule // base).select("series", at_epoch("_b").alias("ts"), *PRICES, "volume")


def resample_report(bars: DataFrame, rule: int, base: int = HOUR) -> DataFrame:
    k = rule // base
    marked = _bucketed(bars, rule).withColumn("_ok", F.pmod(epoch(), F.lit(base)) == 0)
    blocks = marked.groupBy("series", "_b").agg(F.count_if("_ok").alias("n"), F.count_if(~F.col("_ok")).alias("off"))
    hole = F.col("_b") - F.lag("_b").over(Window.partitionBy("series").orderBy("_b")) > rule
    some = F.col("n") > 0
    expected = ((F.max(F.when(some, F.col("_b"))) - F.min(F.when(some, F.col("_b")))) / rule + 1).cast("bigint")
    out = blocks.withColumn("_h", hole).groupBy("series").agg(
        F.sum(F.col("n") + F.col("off")).alias("n_source"), F.sum("off").alias("n_misaligned"), expected.alias("blocks_expected"), F.count_if(F.col("n") == k).alias("blocks_complete"),
        F.count_if(some & (F.col("n") < k)).alias("blocks_incomplete"), (expected - F.count_if(some)).alias("blocks_without_data"),
        F.coalesce(F.sum(F.when(F.col("n") == k, F.col("n"))), F.lit(0)).alias("rows_used"), F.count_if("_h").alias("n_time_holes"),
    )
    return out.withColumn("pct_discarded", F.round(100.0 * (F.col("blocks_expected") - F.col("blocks_complete")) / F.col("blocks_expected"), 8))
