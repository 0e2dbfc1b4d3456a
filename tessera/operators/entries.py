"""Signals to entries: purge at a segment's end, then no overlap. Keys are (series, condition_id, fold, segment)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.cluster import ship

from .segments import assign

KEY = ["series", "condition_id", "fold", "segment"]


def long_signals(signals: DataFrame, names: list[str]) -> DataFrame:
    """(series, t, condition_id) of true signals alone."""
    each = F.explode(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return signals.select("series", "t", each.alias("condition_id")).filter("condition_id IS NOT NULL")


def candidates(signals: DataFrame, segments: DataFrame, horizon: int) -> DataFrame:
    """Signals inside segments, with fits: whether the information interval t to t + horizon ends inside."""
    return assign(signals, segments).withColumn("fits", F.col("t") <= F.col("end") - 1 - horizon)


def greedy(t: np.ndarray, free_from: np.ndarray) -> np.ndarray:
    """Places of the candidates that are accepted: the chain from the first one, each to the first at or after its
    free_from. Links are found for all at once; the chain's members by doubling the links."""
    n = len(t)
    if not n:
        return np.zeros(0, int)
    link = np.append(np.maximum(np.searchsorted(t, free_from), np.arange(1, n + 1)), n)
    on = np.zeros(n + 1, bool)
    on[0] = True
    while True:  # after k rounds link jumps 2^k ahead and the chain's first 2^k members are known
        reached = link[on]
        if on[reached].all():
            return np.flatnonzero(on[:n])
        on[reached] = True
        link = link[link]


def select(found: DataFrame, outcomes: DataFrame | None = None, cooldown: int = 1, valid: DataFrame | None = None) -> DataFrame:
    """Accepted entries (KEY, t, e). With outcomes until exit: a signal on the exit bar or later is accepted next;
    without, cooldown bars lie between two, and valid tells the entries whose levels are. One group is one condition in
    one segment."""
    fit = found.filter("fits").select(*KEY, "t", (F.col("t") + 1).alias("e"))
    if valid is not None:
        fit = fit.join(valid.filter("outcome IS NOT NULL").select("series", "e"), ["series", "e"], "left_semi")
    if outcomes is not None:
        ends = outcomes.filter("outcome IS NOT NULL").select("series", "e", (F.col("e") + F.col("exit_offset")).alias("free"))
        fit = fit.join(ends, ["series", "e"])
    else:
        fit = fit.withColumn("free", F.col("t") + max(cooldown, 1))
    ship(fit.sparkSession)
    fit = fit.select(*KEY, "t", "e", F.col("free").cast("bigint"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pdf.iloc[greedy(pdf["t"].to_numpy(), pdf["free"].to_numpy())][[*KEY, "t", "e"]]

    return fit.groupBy(*KEY).applyInPandas(run, T.StructType([fit.schema[c] for c in (*KEY, "t", "e")]))


def counters(found: DataFrame, accepted: DataFrame) -> DataFrame:
    raw = found.groupBy(*KEY).agg(F.count("*").alias("n_raw_signals"), F.count_if(~F.col("fits")).alias("n_dropped_horizon"))
    n = accepted.groupBy(*KEY).agg(F.count("*").alias("n_entries"))
    out = raw.join(n, KEY, "left").fillna(0, ["n_entries"])
    return out.withColumn("n_dropped_cooldown", F.col("n_raw_signals") - F.col("n_dropped_horizon") - F.col("n_entries"))


def trade_intervals(rows: DataFrame, horizon: int) -> DataFrame:
    """Signal, entry and exit bars of entries (with exit_offset), and the last bar that their outcome was read from."""
    return rows.withColumns({"signal_bar": F.col("t"), "entry_bar": F.col("e"), "exit_bar": F.col("e") + F.col("exit_offset"), "info_end": F.col("t") + horizon})


def fits(start: str = "signal_bar", stop: str = "info_end"):
    """Whether a trade interval lies within its segment's bars."""
    return (F.col(start) >= F.col("start")) & (F.col(stop) < F.col("end"))
