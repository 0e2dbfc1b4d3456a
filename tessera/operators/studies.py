"""Comparisons of runs: economics of trades, decompositions, identity of reruns, random references, calibration, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments as S
from . import stats
from .inference import newey_west_t

#: Hours of a year and of a condition's window.
YEAR_HOURS, WINDOW_HOURS = 8766, 720


def economics(rows: DataFrame, bars: int, conditions: int, windows: int, base_hours: int = 1, scenario: str = "typical", keys=()) -> DataFrame:
    """Per trade and per condition and window: gross, net, cost; trades a year and per 1,000 bars; the share of profits
    among the resolved, and what it is for a random walk between levels tp_frac and sl_frac."""
    net = F.col(f"net_{scenario}")
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg("gross_return").alias("gross_per_trade"), F.avg(net).alias("net_per_trade"), F.avg(F.col("exit_offset") + 1).alias("mean_duration"),
        F.count_if(F.col("outcome") == "TP_FIRST").alias("_tp"), F.count_if(F.col("outcome") == "SL_FIRST").alias("_sl"), F.avg("tp_frac").alias("_a"), F.avg("sl_frac").alias("_b"),
    )
    per = F.col("trades") / F.lit(max(1, conditions * windows))
    return g.withColumn("cost_per_trade", F.col("gross_per_trade") - F.col("net_per_trade")).withColumns(
        {
            "trades_per_window": per, "gross_per_window": per * F.col("gross_per_trade"), "net_per_window": per * F.col("net_per_trade"), "cost_per_window": per * F.col("cost_per_trade"),
            "trades_per_year": F.col("trades") * YEAR_HOURS / F.lit(bars * base_hours), "trades_per_1000_bars": F.col("trades") * 1000 / F.lit(bars), "hours_between": F.lit(WINDOW_HOURS) / per,
            "tp_share_of_resolved": F.col("_tp") / F.nullif(F.col("_tp") + F.col("_sl"), F.lit(0)), "tp_share_random_walk": F.col("_b") / (F.col("_a") + F.col("_b")),
        }
    ).drop("_tp", "_sl", "_a", "_b")


def turnover(a: DataFrame, b: DataFrame) -> DataFrame:
    """The change of net per window from a to b (economics() rows) as turnover and per-trade parts: gross and cost."""
    x, y = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("trades_per_window", "gross_per_trade", "cost_per_trade", "net_per_trade", "net_per_window")]).withColumn("_k", F.lit(1)) for df, p in ((a, "a"), (b, "b")))
    more = F.col("b_trades_per_window") - F.col("a_trades_per_window")
    parts = {
        "d_net": F.col("b_net_per_window") - F.col("a_net_per_window"), "by_turnover": more * F.col("a_net_per_trade"),
        "by_gross": F.col("b_trades_per_window") * (F.col("b_gross_per_trade") - F.col("a_gross_per_trade")), "by_cost": -F.col("b_trades_per_window") * (F.col("b_cost_per_trade") - F.col("a_cost_per_trade")),
    }
    return x.join(y, "_k").select(*[v.alias(k) for k, v in parts.items()])


def differences(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """(column, n_different) of the numeric columns that a rerun shares with a saved run; nulls and NaN equal themselves, a
    row that only one of them has differs in all."""
    numeric = lambda df: {f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "long", "integer", "short")} - set(keys)
    shared = sorted(numeric(old) & numeric(new))
    a = old.select(*keys, *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"a{i}") for i, c in enumerate(shared)], F.lit(True).alias("_a"))
    b = new.select(*keys, *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"b{i}") for i, c in enumerate(shared)], F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    same = lambda i: F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) | F.coalesce(F.abs(F.col(f"a{i}") - F.col(f"b{i}")) <= tolerance, F.lit(False))
    counts = both.agg(*[F.count_if(alone | ~same(i)).alias(f"n{i}") for i in range(len(shared))])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, shared)), F.array(*[F.col(f"n{i}") for i in range(len(shared))]))).alias("column", "n_different"))


def random_windows(rows: DataFrame, bars: int, size: int, reps: int = 30, seed: int = 0, x: str = "net_typical") -> DataFrame:
    """Mean and spread of x over entries in reps seeded random windows of size bars."""
    spark = rows.sparkSession
    starts = spark.range(reps).select(F.col("id").cast("int").alias("fold"), F.lit("W").alias("segment"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, bars - size + 1))).alias("start"))
    windows = starts.withColumn("end", F.col("start") + size)
    per = S.assign(rows, windows).groupBy("fold").agg(F.avg(x).alias("m"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_windows"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.avg("n").alias("mean_entries"))


def geometry_baseline(accepted: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Of entries as often as the exits allow (a signal at every bar): number, mean return, share of profits, holding."""
    rows = accepted.join(outcomes.drop("t"), ["series", "e"])
    return rows.groupBy("fold", "segment").agg(F.count("*").alias("max_trades"), F.avg("net_typical").alias("mean_net"), F.avg((F.col("outcome") == "TP_FIRST").cast("double")).alias("p_tp"), F.avg(F.col("exit_offset") + 1).alias("mean_hold"))


def overlap_calibration(returns: DataFrame, horizon: int, reps: int = 200, seed: int = 0, step: int = 1) -> DataFrame:
    """How often |t| > 1.96 for entries at every step bars under a null of shuffled signs: the plain t and the robust one.

    returns: (t, x) of non-overlapping returns; an entry's outcome is the sum of horizon of them. A replicate is a key."""
    signed = returns.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    signed = signed.withColumn("x", F.col("x") * F.when(F.pmod(F.xxhash64(F.lit(seed), "rep", "t"), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    ahead = Window.partitionBy("rep").orderBy("t").rowsBetween(0, horizon - 1)
    full = signed.withColumns({"x": F.sum("x").over(ahead), "_n": F.count("*").over(ahead)}).filter((F.col("_n") == horizon) & (F.col("t") % step == 0))
    plain = full.groupBy("rep").agg(stats.fold_t(F.col("x")).alias("plain"))
    robust = newey_west_t(full, 3 * horizon, keys=("rep",)).select("rep", "hac_t")
    both = plain.join(robust, "rep")
    return both.agg(F.avg((F.abs("plain") > 1.96).cast("double")).alias("plain_rejects"), F.avg((F.abs("hac_t") > 1.96).cast("double")).alias("hac_rejects"), F.count("*").alias("reps"))


def to_hour_grid(series: DataFrame, hours: DataFrame, width: int = 4) -> DataFrame:
    """A series (ts, x, covered) of width-hour bars on the hourly grid: x at its own hour, covered over all of them."""
    own = series.select("ts", "x")
    cover = series.filter("covered").select(F.explode(F.sequence("ts", F.col("ts") + F.expr(f"INTERVAL {width - 1} HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("ts")).distinct().withColumn("_c", F.lit(True))
    return hours.select("ts").join(own, "ts", "left").join(cover, "ts", "left").select("ts", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("_c", F.lit(False)).alias("covered"))


def paired_t(x: Column, population: bool = False) -> Column:
    """t of differences, for more than two; by the population's deviation where asked for."""
    sd = F.stddev_pop(x) if population else F.stddev_samp(x)
    return F.when(F.count(x) > 2, F.avg(x) / F.when(sd > 0, sd / F.sqrt(F.count(x))))


def decide(rows: DataFrame, rules: list[tuple[str, Column]], scenarios: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """Adds a boolean column for each rule, and scenario: the first whose condition over the rules' columns holds."""
    out = rows.withColumns({name: F.coalesce(rule, F.lit(False)) for name, rule in rules})
    pick = F.lit(otherwise)
    for name, holds in reversed(scenarios):
        pick = F.when(holds, name).otherwise(pick)
    return out.withColumn("scenario", pick)
