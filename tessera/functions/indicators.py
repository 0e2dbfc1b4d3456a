"""Operands: columns over W = partitionBy(series).orderBy(t), and one grouped pass for the recursive ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.cluster import ship
from tessera.operators.quality import PRICES, epoch


def W():
    """Bars of a series in order."""
    return Window.partitionBy("series").orderBy("t")


def sma(p: int, x: str = "close") -> Column:
    w = W().rowsBetween(-(p - 1), 0)
    return F.when(F.count(x).over(w) >= p, F.avg(x).over(w))


def returns(n: int) -> Column:
    return F.col("close") / F.lag("close", n).over(W()) - 1


def candle(part: str) -> Column:
    """body, range, upper_wick, lower_wick, or one of them with _ratio: over the range, null where that is 0."""
    rng = F.col("high") - F.col("low")
    parts = {
        "body": F.abs(F.col("close") - F.col("open")), "range": rng, "upper_wick": F.col("high") - F.greatest("open", "close"), "lower_wick": F.least("open", "close") - F.col("low"),
    }
    name = part.removesuffix("_ratio")
    return parts[name] / F.when(rng > 0, rng) if part.endswith("_ratio") else parts[name]


def true_range() -> Column:
    c = F.lag("close").over(W())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c))


def affine_scan(x: np.ndarray, alpha: float, periods: int) -> np.ndarray:
    """y = a x + (1 - a) y', from the first value on; NaN until periods values."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=periods).mean().to_numpy()


def ema(x, p):
    return affine_scan(np.asarray(x, float), 2 / (p + 1), p)


def wilder(x, p):
    return affine_scan(np.asarray(x, float), 1 / p, p)


def _rsi(pdf, p):
    delta = pdf["close"].diff().to_numpy()
    gain = wilder(np.where(np.isnan(delta), np.nan, np.maximum(delta, 0)), p)
    loss = wilder(np.where(np.isnan(delta), np.nan, np.maximum(-delta, 0)), p)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + gain / loss)
    out[(loss == 0) & (gain > 0)] = 100.0
    out[(loss == 0) & (gain == 0)] = 50.0
    return out


def _atr(pdf, p):
    before = pdf["close"].shift()
    tr = pd.concat([pdf["high"] - pdf["low"], (pdf["high"] - before).abs(), (pdf["low"] - before).abs()], axis=1).max(axis=1)
    return wilder(tr.to_numpy(), p)


def _macd(pdf, fast, slow, signal):
    line = ema(pdf["close"], fast) - ema(pdf["close"], slow)
    sig = ema(line, signal)
    return line, sig, line - sig


def _htf(pdf, tf, n, base=3600):
    """As with_htf_trend, over one series."""
    at = pdf["ts"].to_numpy("datetime64[s]").astype(np.int64)
    new = np.concatenate([[True], np.diff(at // tf) != 0])
    run = np.cumsum(new) - 1
    close = pdf["close"].to_numpy()[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    trend = close / pd.Series(close).rolling(n).mean().to_numpy() - 1
    k = np.where((at + base) % tf == 0, run, run - 1)
    return (np.where(k >= 0, trend[np.maximum(k, 0)], np.nan),)


#: name: (function, outputs). A specification is (name, *parameters); more can be registered.
RECURSIVE = {
    "ema": (lambda pdf, p: (ema(pdf["close"], p),), ("",)), "rsi": (lambda pdf, p: (_rsi(pdf, p),), ("",)), "atr": (lambda pdf, p: (_atr(pdf, p),), ("",)),
    "sma": (lambda pdf, p: (pdf["close"].rolling(p).mean().to_numpy(),), ("",)), "macd": (_macd, ("_line", "_signal", "_hist")), "htf": (_htf, ("",)),
}


def column_names(spec) -> list[str]:
    return ["_".join(map(str, spec)) + o for o in RECURSIVE[spec[0]][1]]


def with_recursive(bars: DataFrame, *specs) -> DataFrame:
    """Adds a column for each output of each specification, all in one pass over each series."""
    ship(bars.sparkSession)
    names = [c for s in specs for c in column_names(s)]
    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        pdf = table.select([c for c in ("ts", *PRICES) if c in table.column_names]).to_pandas()
        for s in specs:
            for name, values in zip(column_names(s), RECURSIVE[s[0]][0](pdf, *s[1:])):
                table = table.append_column(name, pa.array(np.asarray(values, float), from_pandas=True))
        return table

    return bars.groupBy("series").applyInArrow(run, schema)


def with_htf_trend(bars: DataFrame, tf: int, n: int, base: int, name: str) -> DataFrame:
    """Last completed candle's close of the higher time frame over the mean of the last n, less 1. A run of bars
    of one bucket is a candle; a bar closes it if it is its bucket's last of the grid."""
    bucket = F.floor(epoch() / tf)
    marked = bars.withColumn("_b", bucket)
    marked = marked.withColumn("_k", F.dense_rank().over(Window.partitionBy("series").orderBy("_b")).cast("bigint"))
    candles = marked.groupBy("series", "_k").agg(F.max_by("close", "t").alias("_c"))
    w = Window.partitionBy("series").orderBy("_k").rowsBetween(-(n - 1), 0)
    trend = candles.select("series", F.col("_k").alias("_j"), F.when(F.count("_c").over(w) >= n, F.col("_c") / F.avg("_c").over(w) - 1).alias(name))
    closes = F.pmod(epoch() + base, F.lit(tf)) == 0
    marked = marked.withColumn("_j", F.when(closes, F.col("_k")).otherwise(F.col("_k") - 1))
    return marked.join(trend, ["series", "_j"], "left").drop("_b", "_k", "_j")
