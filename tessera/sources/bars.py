"""Bar sources. Bars are (series, ts, t, open, high, low, close, volume); t counts bars of a series from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.quality import normalize_ohlc, resample_strict

#: Loaders by name: (spark, location) to bars. Register a new source here.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def source(name: str):
    def add(f):
        SOURCES[name] = f
        return f

    return add


def load(spark: SparkSession, name: str, location: str, base: int | None = None, rule: int | None = None) -> DataFrame:
    """Bars of a source; resampled strictly from base to rule seconds where they differ."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {sorted(SOURCES)}")
    bars = SOURCES[name](spark, location)
    if base and rule and base != rule:
        bars = numbered(resample_strict(bars, rule, base))
    return bars


def numbered(df: DataFrame) -> DataFrame:
    """Adds t, the place of a bar in its series. The order of one series is one partition's work."""
    w = Window.partitionBy("series").orderBy("ts")
    return df.withColumn("t", (F.row_number().over(w) - 1).cast("bigint"))


def _walk(events: DataFrame, series, unit: str = "hour") -> DataFrame:
    """Hourly bars, or of another unit, of a running price. Sums run inside hours, and over hours of sums: no series of events is one task's."""
    e = events.select(
        series.alias("series"), "ts", "event_id", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("hour"),
        F.round((F.col("value") - 50) * 100).cast("bigint").alias("d"), F.col("value"),
    )
    hours = e.groupBy("series", "hour").agg(F.sum("d").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("series")
    before = F.coalesce(F.sum("s").over(w.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select("series", "hour", (F.floor(20000 * F.sqrt(F.sum("n").over(w))) + before).alias("base"))
    run = F.sum("d").over(Window.partitionBy("series", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    px = e.join(hours, ["series", "hour"]).withColumn("px", (F.col("base") + run) / F.lit(100.0))
    at = F.struct("ts", "event_id")
    out = px.groupBy("series", "hour").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return numbered(out.withColumnRenamed("hour", "ts")).select("series", "ts", "t", "open", "high", "low", "close", "volume")


@source("walk")
def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark.read.parquet(f"{sf_dir}/events.parquet"), F.lit("all"))


@source("minute")
def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark.read.parquet(f"{sf_dir}/events.parquet"), F.lit("all"), "minute")


@source("type")
def type_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type"))


@source("daily")
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("ts"), "o_orderkey", F.col("o_totalprice").cast("double").alias("px"))
    out = o.groupBy("ts").agg(
        F.min_by("px", "o_orderkey").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return numbered(out.withColumn("series", F.lit("orders"))).select("series", "ts", "t", "open", "high", "low", "close", "volume")


@source("csv")
def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """The date is the first column named date, datetime or timestamp, else the first one."""
    raw = spark.read.csv(path, header=True)
    names = [c for c in raw.columns if c.lower() in ("date", "datetime", "timestamp")] or raw.columns[:1]
    raw = raw.withColumn("_seq", F.monotonically_increasing_id()).withColumn("ts", F.col(names[0]).try_cast("timestamp_ntz"))
    return numbered(normalize_ohlc(raw.withColumn("series", F.lit(path)), "_seq"))


@source("kline")
def kline_bars(spark: SparkSession, path: str) -> DataFrame:
    """Exchange archives, a folder of files: 12 columns, with names or without; a file with an open time above 1e14 has
    microseconds, any other milliseconds. Of a time that several files have, the last file's bar stays."""
    raw = spark.read.csv(path).withColumn("_file", F.input_file_name()).filter(F.col("_c0").rlike(r"^\d"))
    raw = raw.withColumn("_at", F.col("_c0").cast("bigint"))
    micros = raw.groupBy("_file").agg((F.max("_at") > F.lit(10**14)).alias("_micros"))
    raw = raw.join(F.broadcast(micros), "_file")
    ts = F.when(F.col("_micros"), F.timestamp_micros("_at")).otherwise(F.timestamp_millis("_at")).cast("timestamp_ntz")
    cols = [F.col(f"_c{i}").cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)]
    return numbered(normalize_ohlc(raw.select(F.lit(path).alias("series"), ts.alias("ts"), F.struct("_file", F.monotonically_increasing_id()).alias("_seq"), *cols), "_seq"))


@source("download")
def download(spark: SparkSession, location: str) -> DataFrame:
    """A place for a client of a price service: without one, bars come from files that another job has landed."""
    raise NotImplementedError("no client is installed; land the files and load them with csv, kline or parquet")


@source("parquet")
def parquet_bars(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.parquet(path).drop("t"))
