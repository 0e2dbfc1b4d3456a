"""Timeline segments: half-open ranges of bars, as small tables that are broadcast (a row a segment, not a bar)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "fold int, segment string, start long, end long"


def chronological_split(n: int, train: float = 0.30, validation: float = 0.35):
    a, b = round(n * train), round(n * (train + validation))
    return [(0, "TRAIN", 0, a), (0, "VALIDATION", a, b), (0, "TEST", b, n)]


@dataclass(frozen=True)
class Folds:
    """Walk-forward ranges, told backwards from the holdout: VALIDATION k of count ends (count - 1 - k) lengths before it."""

    bars: int
    holdout_at: int
    count: int
    train: int
    val: int
    anchored: bool = False

    def validation(self, k: int) -> tuple[int, int]:
        end = self.holdout_at - (self.count - 1 - k) * self.val
        return end - self.val, end

    def rows(self):
        for k in range(self.count):
            a, b = self.validation(k)
            yield k, "TRAIN", 0 if self.anchored else a - self.train, a
            yield k, "VALIDATION", a, b
        yield -1, "HOLDOUT", self.holdout_at, self.bars


def make_folds(n: int, folds: int = 10, ratio: float = 3.0, holdout: float = 0.15, horizon: int = 1, train_bars: int | None = None, val_bars: int | None = None, anchored: bool = False):
    """Rows (fold, segment, start, end). Lengths are given in bars, or follow from how many folds of a ratio fit."""
    dev = n - round(n * holdout)
    by_bars = bool(train_bars and val_bars)
    val = val_bars if by_bars else int(dev // (folds + ratio))
    train = train_bars if by_bars else round(val * ratio)
    count = (dev - train) // val if by_bars else folds
    for wrong, message in ((count < 1, "no fold fits"), (val < 2 * horizon, "VALIDATION is shorter than two horizons")):
        if wrong:
            raise ValueError(message)
    return list(Folds(n, dev, count, train, val, anchored).rows())


def rolling(n: int, train: int, val: int):
    """TRAIN and VALIDATION ranges from the first bar on, as long as both fit."""
    return [row for k in range(max(0, (n - train) // val)) for row in ((k, "TRAIN", k * val, k * val + train), (k, "VALIDATION", k * val + train, k * val + train + val))]


def calendar(spark: SparkSession, rows) -> DataFrame:
    """(fold, segment, from, to) of dates, which hold for every series."""
    return spark.createDataFrame(rows, "fold int, segment string, `from` timestamp_ntz, `to` timestamp_ntz")


def calendar_of(bars: DataFrame, segments: DataFrame) -> DataFrame:
    """The dates of segments of one series' bars: a segment runs from its first bar's time to the next one's, or on."""
    own = assign(bars.select("t", "ts"), segments).groupBy("fold", "segment", "start").agg(F.min("ts").alias("from"))
    after = bars.select((F.col("t") - 1).alias("_last"), F.col("ts").alias("to"))
    ends = segments.select("fold", "segment", (F.col("end") - 1).alias("_last")).join(after, "_last", "left")
    return own.join(ends, ["fold", "segment"]).select("fold", "segment", "from", "to")


def on_calendar(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Segments by dates as ranges of each series' bars (series, fold, segment, start, end): bars at or after from, before to."""
    at = (F.col("ts") >= F.col("from")) & (F.col("to").isNull() | (F.col("ts") < F.col("to")))
    inside = bars.select("series", "t", "ts").join(F.broadcast(dates), at)
    return inside.groupBy("series", "fold", "segment").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"))


def holdout_cut(bars: DataFrame, cut) -> DataFrame:
    """The bars before a date; what follows isn't looked at."""
    return bars.filter(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))


def blocks(n: int, count: int):
    edges = [int(n * i / count) for i in range(count + 1)]
    return [(i, f"B{i}", a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(int(f), s, int(a), int(b)) for f, s, a, b in rows], SCHEMA)


def per_series(bars: DataFrame, rule) -> DataFrame:
    """rule(number of bars) to rows, for each series by its own number of bars: (series, fold, segment, start, end)."""
    counts = {r["series"]: r["n"] for r in bars.groupBy("series").agg((F.max("t") + 1).alias("n")).collect()}
    rows = [(s, int(f), name, int(a), int(b)) for s, n in counts.items() for f, name, a, b in rule(n)]
    return bars.sparkSession.createDataFrame(rows, f"series string, {SCHEMA}")


def assign(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows of df in each segment that holds their t; of their series', where segments have one."""
    inside = (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))
    if "series" not in segments.columns:
        return df.join(F.broadcast(segments), inside)
    own = segments.withColumnRenamed("series", "_series")
    return df.join(F.broadcast(own), (F.col("series") == F.col("_series")) & inside).drop("_series")


def fold_of_bars(t: DataFrame, folds: DataFrame) -> DataFrame:
    """fold of each row by its t: that of the VALIDATION range it is in, else -1."""
    val = folds.filter("segment = 'VALIDATION'").select(F.col("fold").alias("_f"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    out = t.join(F.broadcast(val), (F.col("t") >= F.col("_a")) & (F.col("t") < F.col("_b")), "left")
    return out.withColumn("fold", F.coalesce("_f", F.lit(-1))).drop("_f", "_a", "_b")
