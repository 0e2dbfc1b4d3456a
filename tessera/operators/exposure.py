"""Exposure rules: daily long or flat positions from an operand, their cost and lift."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import operands as O
from tessera.functions.indicators import W

from . import audit, inference
from .outcomes import SCENARIOS


def side_cost(scenario: str = "typical") -> float:
    s = SCENARIOS[scenario]
    return s["fee"] + s["spread"] / 2 + s["slippage"]


@dataclass(frozen=True)
class ExposureRule:
    """In the market while an operand is above, or below, a threshold; not where it isn't known."""

    name: str
    operand: O.Operand
    op: str
    threshold: float

    def state(self) -> Column:
        x = F.col(f"`{self.operand}`")
        return F.coalesce(x > self.threshold if self.op == ">" else x < self.threshold, F.lit(False))

    def positions(self, bars: DataFrame) -> DataFrame:
        return positions(O.materialise(bars, [self.operand]), self.state())


#: The rules under study.
RULES = (
    ExposureRule("trend_20d", O.operand("htf", 86_400, 20), ">", 0.0), ExposureRule("trend_100d", O.operand("htf", 86_400, 100), ">", 0.0),
    ExposureRule("calm", O.operand("relvol", 24, 240), "<", 1.0),
)


def causality(bars: DataFrame, rule: ExposureRule, cuts: list[int]) -> DataFrame:
    """Positions up to each cut, with what follows cut off or disturbed."""
    return audit.check(bars, rule.positions, ["pos"], cuts)


def positions(df: DataFrame, state: Column) -> DataFrame:
    """pos changes at a day's first bar alone, to the state of the bar before; 0 before the first."""
    day = F.to_date("ts")
    df = df.withColumns({"_state": F.coalesce(state, F.lit(False)).cast("int"), "_start": day != F.lag(day).over(W())}).withColumn("_set", F.when(F.col("_start"), F.lag("_state").over(W())))
    out = df.withColumn("pos", F.coalesce(F.last("_set", ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return out.drop("_state", "_start", "_set")


def evaluate(df: DataFrame, size: int, scenario: str = "typical") -> DataFrame:
    """Per bar: window (of size bars), r, switches (the last bar of all sells), cost, gross_lift, net, net_lift."""
    whole = Window.partitionBy("series")
    df = df.withColumn("window", F.floor(F.col("t") / size))
    own = Window.partitionBy("series", "window").orderBy("t")
    r = F.coalesce(F.lead("open").over(own), F.col("close")) / F.col("open") - 1
    last = (F.col("t") == F.max("t").over(whole)).cast("int") * F.col("pos")
    df = df.withColumns({"r": r, "switches": F.abs(F.col("pos") - F.lag("pos", 1, 0).over(W())) + last, "_e": F.avg("pos").over(whole)})
    df = df.withColumn("cost", F.col("switches") * side_cost(scenario))
    return df.withColumns({"gross_lift": (F.col("pos") - F.col("_e")) * F.col("r"), "net": F.col("pos") * F.col("r") - F.col("cost")}).withColumn("net_lift", F.col("net") - F.col("_e") * F.col("r")).drop("_e")


def per_window(df: DataFrame) -> DataFrame:
    return df.groupBy("series", "window").agg(*[F.sum(c).alias(c) for c in ("gross_lift", "net", "net_lift", "cost")])


def max_drawdown(df: DataFrame, x: str) -> DataFrame:
    """Of the simple sum of x, which starts at 0."""
    run = W().rowsBetween(Window.unboundedPreceding, 0)
    eq = df.withColumn("_eq", F.sum(x).over(run))
    return eq.withColumn("_top", F.greatest(F.lit(0.0), F.max("_eq").over(run))).groupBy("series").agg(F.min(F.col("_eq") - F.col("_top")).alias("max_drawdown"))


def summarize(df: DataFrame) -> DataFrame:
    entered = (F.col("pos") == 1) & (F.lag("pos", 1, 0).over(W()) == 0)
    bars = df.withColumn("_in", entered).groupBy("series").agg(
        F.count("*").alias("n_bars"), F.avg("pos").alias("exposure"), F.count_if("_in").alias("n_entries"), F.sum("switches").alias("n_sides_paid"), F.sum("r").alias("buy_hold_sum"),
        F.sum("net").alias("rule_net_sum"), F.sum("net_lift").alias("net_lift_sum"), F.sum("cost").alias("cost_sum"),
    )
    w = per_window(df).withColumn("block", F.ntile(5).over(Window.partitionBy("series").orderBy("window")))
    b = w.groupBy("series", "block").agg(F.sum("net_lift").alias("s")).groupBy("series").agg(F.count_if(F.col("s") > 0).alias("blocks_positive"))
    sd = F.stddev_samp("net_lift")
    t = w.groupBy("series").agg(F.count("*").alias("n_windows"), (F.avg("net_lift") / F.when(sd > 0, sd / F.sqrt(F.count("net_lift")))).alias("t_windows_net_lift"))
    return bars.join(t, "series").join(b, "series").join(max_drawdown(df, "net").withColumnRenamed("max_drawdown", "max_drawdown_rule"), "series")


def pool_mean(df: DataFrame, key: str, x: str) -> DataFrame:
    """Mean over the series that have a value at each key."""
    return df.groupBy(key).agg(F.avg(x).alias("pooled"), F.count(x).alias("n_series"))


def correlation(df: DataFrame, key: str, x: str) -> DataFrame:
    a, b = df.select(key, F.col("series").alias("a"), F.col(x).alias("x")), df.select(key, F.col("series").alias("b"), F.col(x).alias("y"))
    return a.join(b, key).filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))


def scenario_sums(df: DataFrame, size: int, names=("optimistic", "typical", "conservative")) -> DataFrame:
    """Per series the sums of cost, net and net lift in each scenario, and windows with a positive net lift."""
    out = None
    for name in names:
        w = per_window(evaluate(df, size, name)).groupBy("series")
        one = w.agg(F.sum("cost").alias(f"cost_sum_{name}"), F.sum("net").alias(f"rule_net_sum_{name}"), F.sum("net_lift").alias(f"net_lift_sum_{name}"), F.count_if(F.col("net_lift") > 0).alias(f"windows_net_lift_gt0_{name}"))
        out = one if out is None else out.join(one, "series")
    return out


def sharpe(x: str, per_year: int = 24 * 365) -> Column:
    sd = F.stddev_samp(x)
    return F.avg(x) / F.when(sd > 0, sd) * math.sqrt(per_year)


def benchmarks(df: DataFrame) -> DataFrame:
    """Of evaluate() rows: constant exposure of the rule's mean, buy and hold, gross sums, Sharpe ratios and episodes."""
    mean = F.avg("pos").over(Window.partitionBy("series"))
    df = df.withColumn("_b", mean * F.col("r"))
    out = df.groupBy("series").agg(
        F.sum("_b").alias("benchmark_sum"), F.sum(F.col("pos") * F.col("r")).alias("rule_gross_sum"), F.sum("gross_lift").alias("gross_lift_sum"), sharpe("net").alias("sharpe_rule"), sharpe("r").alias("sharpe_buy_hold"), F.sum("pos").alias("_in"),
    )
    episodes = summarize(df).select("series", "n_entries")
    out = out.join(episodes, "series").withColumn("mean_episode_hours", F.col("_in") / F.nullif("n_entries", F.lit(0))).drop("_in", "n_entries")
    down = max_drawdown(df, "_b").withColumnRenamed("max_drawdown", "max_drawdown_benchmark").join(max_drawdown(df, "r").withColumnRenamed("max_drawdown", "max_drawdown_buy_hold"), "series")
    return out.join(down, "series")


def criteria(df: DataFrame, size: int, threshold: float, lags: int = 3) -> DataFrame:
    """C1 to C6, candidate (all of them) and evaluable (C6) for each series of positions."""
    typical = evaluate(df, size)
    w = per_window(typical)
    sd = F.stddev_samp("net_lift")
    one = w.groupBy("series").agg(F.avg("net_lift").alias("_m"), (F.avg("net_lift") / F.when(sd > 0, sd / F.sqrt(F.count("net_lift")))).alias("_t"))
    hac = inference.newey_west_t(w, lags, t="window", x="net_lift").select("series", "hac_t")
    rows = one.join(hac, "series").join(summarize(typical).select("series", "blocks_positive", "n_entries"), "series").join(scenario_sums(df, size), "series")
    c = {
        "C1": (F.col("_m") > 0) & (F.col("_t") >= threshold), "C2": F.col("hac_t") >= 2, "C3": F.col("blocks_positive") >= 4, "C4": F.col("net_lift_sum_conservative") > 0,
        "C5": (F.col("rule_net_sum_typical") > 0) & (F.col("rule_net_sum_conservative") > 0), "C6": F.col("n_entries") >= 30,
    }
    rows = rows.select("series", *[F.coalesce(x, F.lit(False)).alias(k) for k, x in c.items()])
    return rows.withColumns({"candidate": F.expr("C1 AND C2 AND C3 AND C4 AND C5 AND C6"), "evaluable": F.col("C6")})


def pooled_criteria(windows: DataFrame, threshold: float, lags: int = 3) -> DataFrame:
    """Over the series' mean net lift of each window: mean, t, robust t and the share of series with a positive sum."""
    pooled = pool_mean(windows, "window", "net_lift")
    one = inference.newey_west_t(pooled.withColumn("series", F.lit("pool")), lags, t="window", x="pooled").agg(F.max("mean").alias("mean"), F.max("hac_t").alias("hac_t")).withColumn("_k", F.lit(1))
    sd = F.stddev_samp("pooled")
    t = pooled.agg((F.avg("pooled") / F.when(sd > 0, sd / F.sqrt(F.count("pooled")))).alias("t")).withColumn("_k", F.lit(1))
    own = windows.groupBy("series").agg(F.sum("net_lift").alias("_s")).agg(F.avg((F.col("_s") > 0).cast("double")).alias("share_positive")).withColumn("_k", F.lit(1))
    rows = one.join(t, "_k").join(own, "_k").drop("_k")
    return rows.withColumn("confirmed", F.coalesce((F.col("mean") > 0) & (F.col("t") >= threshold) & (F.col("hac_t") >= 2) & (F.col("share_positive") > 0.5), F.lit(False)))
