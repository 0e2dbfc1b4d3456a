"""Statistics of entries: one hash aggregate a key, exact percentiles, lift against entering at every bar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
Z95 = 1.959963984540054
QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
MFE_THRESHOLDS = (0.01, 0.02, 0.05, 0.10)
MAE_THRESHOLDS = (0.01, 0.02, 0.05)
KINDS = ("TP_FIRST", "SL_FIRST", "NONE", "AMBIGUOUS")


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    n = F.nullif(n, F.lit(0)).cast("double")
    p, z = k / n, Z95
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def compute(rows: DataFrame, keys: list[str], scenarios=("optimistic", "typical"), scenario: str = "typical") -> DataFrame:
    """Counts, shares, means, medians and quantiles of entries by key. All of a column's quantiles come from one exact
    percentile, which holds its different values of a key."""
    net = F.col(f"net_{scenario}")
    aggs = [F.count("*").alias("n_entries"), *[F.count_if(F.col("outcome") == k).alias(f"{k}_count") for k in KINDS]]
    aggs += [F.avg("gross_return").alias("mean_gross_return"), F.avg(net).alias("mean_net_return"), F.stddev_samp(net).alias("std_net_return")]
    aggs += [F.avg((net > 0).cast("double")).alias("win_rate_net"), F.avg(F.col("exit_offset") + 1).alias("mean_holding_bars"), F.avg("mfe").alias("mean_MFE"), F.avg("mae").alias("mean_MAE")]
    aggs += [F.avg(F.when(F.col("outcome") != "AMBIGUOUS", net)).alias("mean_net_return_excl_ambiguous"), *[F.avg(f"net_{s}").alias(f"mean_net_return_{s}") for s in scenarios]]
    aggs += [F.avg((F.col("mfe") >= x).cast("double")).alias(f"P_MFE_ge_{x:g}") for x in MFE_THRESHOLDS]
    aggs += [F.avg((F.col("mae") <= -x).cast("double")).alias(f"P_MAE_le_-{x:g}") for x in MAE_THRESHOLDS]
    ranked = {"gross_return": [0.5], "mfe": QUANTILES, "mae": QUANTILES, **{f"net_{s}": [0.5] for s in scenarios}, f"net_{scenario}": QUANTILES}
    aggs += [F.percentile(c, F.array(*map(F.lit, qs))).alias(f"_q_{c}") for c, qs in ranked.items()]
    out = rows.groupBy(*keys).agg(*aggs)
    at = lambda c, q: F.get(f"_q_{c}", F.lit(list(ranked[c]).index(q)))
    quantiles = {"median_gross_return": at("gross_return", 0.5), "median_net_return": at(f"net_{scenario}", 0.5), "median_MFE": at("mfe", 0.5), "median_MAE": at("mae", 0.5)}
    quantiles |= {f"median_net_return_{s}": at(f"net_{s}", 0.5) for s in scenarios}
    quantiles |= {f"{n}_q{q:g}": at(c, q) for c, n in (("mfe", "MFE"), ("mae", "MAE"), (f"net_{scenario}", "net_return")) for q in QUANTILES}
    n = F.col("n_entries")
    low, high = wilson(F.col("TP_FIRST_count"), n)
    se = F.col("std_net_return") / F.sqrt(n)
    shares = {("P_" + k): F.col(f"{k}_count") / F.nullif(n, F.lit(0)) for k in KINDS} | {"P_TP_FIRST_ci95_low": low, "P_TP_FIRST_ci95_high": high, "se_mean_net_return": se}
    out = out.withColumns(quantiles | shares | {"expected_return": F.col("mean_gross_return"), "net_expected_return": F.col("mean_net_return")}).drop(*(f"_q_{c}" for c in ranked))
    return out.withColumn("t_mean_net_return", F.col("mean_net_return") / F.when(F.col("se_mean_net_return") > 0, F.col("se_mean_net_return")))


def run_parameters(rows: DataFrame, parameters: dict) -> DataFrame:
    """The run's settings as a column each."""
    return rows.withColumns({k: F.lit(v) for k, v in parameters.items()})


LIFTS = ("P_TP_FIRST", "mean_gross_return", "mean_net_return", "mean_MFE", "mean_MAE")


def add_lift(stats: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """baseline: one row a segment, so it is joined on its keys."""
    base = baseline.select(*keys, *[F.col(c).alias(f"base_{c}") for c in LIFTS])
    return stats.join(base, keys).withColumns({f"lift_{c}": F.col(c) - F.col(f"base_{c}") for c in LIFTS}).drop(*(f"base_{c}" for c in LIFTS))


def min_cases(bars: int, fraction: float = 0.01, least: int = 30) -> int:
    return max(least, -int(-fraction * bars // 1))


@dataclass(frozen=True)
class Rule:
    """A bound that a column has to reach, or to exceed where strict; mode: in which of the filter's modes it counts."""

    mode: str
    column: str
    shown: str
    bound: float
    strict: bool

    def broken(self) -> Column:
        x = F.col(self.column)
        return ~F.coalesce(x > self.bound if self.strict else x >= self.bound, F.lit(False))

    @property
    def reason(self) -> str:
        return f"{self.shown}{'<=' if self.strict else '<'}{self.bound:g}"


def rules(mode: str = "both", p_tp: float = 0.5, mean: float = 0.0, lift_p: float = 0.0, lift_mean: float = 0.0, basis: str = "net") -> list[Rule]:
    every = [
        Rule("absolute", "P_TP_FIRST", "P_TP", p_tp, False), Rule("absolute", f"mean_{basis}_return", f"mean_{basis}_return", mean, True),
        Rule("lift", "lift_P_TP_FIRST", "lift_P_TP", lift_p, False), Rule("lift", f"lift_mean_{basis}_return", f"lift_mean_{basis}_return", lift_mean, True),
    ]
    if mode not in ("absolute", "lift", "both"):
        raise ValueError("mode is absolute, lift or both")
    return [r for r in every if mode in (r.mode, "both")]


def filters(stats: DataFrame, need: Column, **bounds) -> DataFrame:
    """passed and reject_reasons by rules(**bounds), after enough entries; what isn't known fails."""
    broken = [F.when(F.col("n_entries") < need, F.concat(F.lit("n<"), need.cast("string"))), *(F.when(r.broken(), r.reason) for r in rules(**bounds))]
    return stats.withColumn("reject_reasons", F.concat_ws(";", *broken)).withColumn("passed", F.col("reject_reasons") == "")


def survivors(rows: DataFrame) -> DataFrame:
    """Conditions that pass in TEST where it was evaluated, else in VALIDATION."""
    last = rows.agg(F.when(F.max((F.col("segment") == "TEST").cast("int")) == 1, "TEST").otherwise("VALIDATION").alias("_last"))
    return rows.join(F.broadcast(last), F.col("segment") == F.col("_last")).filter("passed").drop("_last")


def pool(stats: DataFrame, need: int, top: int) -> DataFrame:
    """Conditions for the second stage: enough entries and some lift, the best first."""
    good = stats.filter((F.col("n_entries") >= need) & ((F.col("lift_P_TP_FIRST") > 0) | (F.col("lift_mean_gross_return") > 0)))
    return good.orderBy(F.desc("lift_P_TP_FIRST"), "condition_id").limit(top)


def pooled(mean: str, n: str) -> Column:
    return F.sum(F.when(F.col(mean).isNotNull(), F.col(mean) * F.col(n))) / F.nullif(F.sum(F.when(F.col(mean).isNotNull(), F.col(n))), F.lit(0))


def pooled_t(df: DataFrame, keys=()) -> DataFrame:
    """t of the pooled sample, from (n, mean, std) of its parts: sums of squares about the pooled mean."""
    n, m, s = F.col("n"), F.col("mean"), F.coalesce("std", F.lit(0.0))
    a = df.filter("n > 0").groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * m).alias("_s"), F.sum((n - 1) * s * s + n * m * m).alias("_q"))
    mean = F.col("_s") / F.col("n")
    var = (F.col("_q") - F.col("n") * mean * mean) / F.when(F.col("n") > 1, F.col("n") - 1)
    return a.select(*keys, "n", mean.alias("mean"), (mean / F.sqrt(F.when(var > 0, var) / F.col("n"))).alias("t"))


def fold_t(x: Column) -> Column:
    sd = F.stddev_samp(x)
    return F.avg(x) / F.when(sd > 0, sd / F.sqrt(F.count(x)))


def oos_series(rows: DataFrame, scenario: str = "typical") -> DataFrame:
    """Per entry bar: counts and sums, by outcome too."""
    net = F.col(f"net_{scenario}")
    by = [F.count_if(F.col("outcome") == k).alias(f"x_cnt_{k}") for k in KINDS] + [F.coalesce(F.sum(F.when(F.col("outcome") == k, net)), F.lit(0.0)).alias(f"x_sum_{k}_{scenario}") for k in KINDS]
    return rows.groupBy("series", "fold", "e").agg(F.count("*").alias("cnt"), F.sum(net).alias(f"sum_{scenario}"), F.sum("gross_return").alias("sum_gross"), F.sum(F.col("exit_offset") + 1).alias("hold_sum"), *by)


def exit_table(rows: DataFrame, scenario: str = "typical") -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("series"))
    out = rows.groupBy("series", "outcome").agg(F.count("*").alias("n"), F.avg(f"net_{scenario}").alias("mean_net"))
    return out.withColumns({"share": F.col("n") / total, "contribution": F.col("n") / total * F.col("mean_net")})
