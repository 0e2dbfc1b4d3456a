"""Multiple testing: HAC t, stationary bootstrap Reality Check, CSCV/PBO, Student tails."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lags that are columns of one window; more are a join.
LAG_COLUMNS = 128


def newey_west_t(series: DataFrame, lags: int, keys=("series",), t: str = "t", x: str = "x") -> DataFrame:
    """t of the mean of x with Bartlett weights. Up to LAG_COLUMNS lags are columns of one ordered pass; more come from an
    equi-join of the centred series with itself, shifted by each lag: lags rows a bar, never all pairs."""
    keys = list(keys)
    whole, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(t)
    u = series.filter(F.col(x).isNotNull()).withColumns({"_m": F.avg(x).over(whole), "_n": F.count(x).over(whole)}).withColumn("_u", F.col(x) - F.col("_m"))
    used = F.least(F.lit(lags), F.col("_n") - 1)
    if lags <= LAG_COLUMNS:
        terms = [F.when(F.lit(j) <= used, 2 * (1 - F.lit(j) / (used + 1.0)) * F.coalesce(F.lag("_u", j).over(ordered), F.lit(0.0))).otherwise(0.0) for j in range(1, lags + 1)]
        u = u.withColumns({f"_l{j}": term for j, term in enumerate(terms)})
        total = sum((F.col(f"_l{j}") for j in range(len(terms))), F.col("_u"))
        out = u.groupBy(*keys).agg(F.first("_n").alias("n"), F.first("_m").alias("mean"), (F.sum(F.col("_u") * total) / F.first("_n")).alias("_o"))
    else:
        u = u.withColumn("_t", F.row_number().over(ordered)).select(*keys, "_t", "_u", "_m", "_n")
        shifted = u.select(*keys, F.col("_u").alias("_v"), "_t", "_n", "_m", F.explode(F.sequence(F.lit(0), used.cast("int"))).alias("_j")).withColumn("_t", F.col("_t") + F.col("_j"))
        w = F.when(F.col("_j") == 0, 1.0).otherwise(2 * (1 - F.col("_j") / (used + 1.0)))
        both = shifted.join(u.select(*keys, "_t", "_u"), [*keys, "_t"])
        out = both.groupBy(*keys).agg(F.first("_n").alias("n"), F.first("_m").alias("mean"), (F.sum(w * F.col("_u") * F.col("_v")) / F.first("_n")).alias("_o"))
    return out.select(*keys, "n", "mean", F.when((F.col("n") >= 3) & (F.col("_o") > 0), F.col("mean") / F.sqrt(F.col("_o") / F.col("n"))).alias("hac_t"))


def cscv(blocks: DataFrame, min_trades: int = 30, max_combinations: int | None = None, seed: int = 0) -> DataFrame:
    """blocks: (block, rule, sum, cnt), an even number of blocks. Per split: the best rule inside, its rank outside
    as a logit; a split whose best rule has fewer than min_trades outside goes. Splits are a table of C(S, S/2) rows
    times S (or of a seeded draw of max_combinations), joined on the block."""
    spark = blocks.sparkSession
    ids = sorted(r[0] for r in blocks.select("block").distinct().collect())
    if len(ids) % 2:
        raise ValueError("an even number of blocks is needed")
    every = list(combinations(ids, len(ids) // 2))
    if max_combinations and len(every) > max_combinations:
        every = [every[i] for i in sorted(np.random.default_rng(seed).choice(len(every), max_combinations, replace=False))]
    rows = [(k, b, b in chosen) for k, chosen in enumerate(every) for b in ids]
    splits = spark.createDataFrame(rows, "split int, block int, inside boolean")
    part = lambda c, i: F.coalesce(F.sum(F.when(F.col("inside") == i, F.col(c))), F.lit(0))
    g = blocks.join(splits, "block").groupBy("split", "rule").agg(part("sum", True).alias("si"), part("cnt", True).alias("ci"), part("sum", False).alias("so"), part("cnt", False).alias("co"))
    g = g.withColumns({"mi": F.when(F.col("ci") >= min_trades, F.col("si") / F.nullif("ci", F.lit(0))), "mo": F.when(F.col("co") >= min_trades, F.col("so") / F.nullif("co", F.lit(0)))})
    w = Window.partitionBy("split")
    # the best inside is picked before anything is asked outside
    g = g.withColumns({"_best": F.row_number().over(w.orderBy(F.desc_nulls_last("mi"), "rule")), "_rank": F.rank().over(w.orderBy(F.asc_nulls_last("mo"))), "_valid": F.count("mo").over(w)})
    omega = F.col("_rank") / (F.col("_valid") + 1.0)
    return g.filter("_best = 1 AND mi IS NOT NULL AND mo IS NOT NULL").select("split", F.col("rule").alias("best"), F.col("mi").alias("mean_is"), F.col("mo").alias("mean_oos"), F.log(omega / (1 - omega)).alias("lambda"))


def pbo(splits: DataFrame) -> DataFrame:
    return splits.agg(
        F.avg((F.col("lambda") <= 0).cast("double")).alias("pbo"), F.count("*").alias("n_combinations"), F.avg("mean_is").alias("mean_is_best"), F.avg("mean_oos").alias("mean_oos_best"),
        F.avg((F.col("mean_oos") < 0).cast("double")).alias("prob_oos_loss"), F.regr_slope("mean_oos", "mean_is").alias("slope_oos_on_is"),
    )


def draw_weights(spark, n: int, n_boot: int, p: float, seed: int) -> DataFrame:
    """(b, _i, w): of each replicate the share of visits of each time, by a stationary bootstrap with blocks of mean length
    1 / p on a circle. A replicate has a seed of its own, so a lost task draws the same again."""

    def draw(pdfs):
        for pdf in pdfs:
            for b in pdf["id"]:
                rng = np.random.default_rng([seed, int(b)])
                fresh = rng.random(n) < p
                fresh[0] = True
                at = np.flatnonzero(fresh)
                run = np.arange(n) - at[np.cumsum(fresh) - 1]
                visits = np.bincount((rng.integers(0, n, len(at))[np.cumsum(fresh) - 1] + run) % n, minlength=n)
                seen = np.flatnonzero(visits)
                yield pd.DataFrame({"b": int(b), "_i": seen, "w": visits[seen] / n})

    return spark.range(n_boot).repartition(min(n_boot, 64)).mapInPandas(draw, "b long, _i long, w double")


def reality_check(perf: DataFrame, n_boot: int = 200, mean_block: float | None = None, seed: int = 0, studentised: bool = True, weights: DataFrame | None = None) -> DataFrame:
    """perf: (t, rule, x), the same t for every rule. Maximum over rules of the mean, over its bootstrap deviation where
    studentised, against centred bootstrap means: one row, whose p_value is null where no rule varies.

    The weighted means of all rules are a join with the replicates' visits and an aggregate. weights: given instead of
    drawn, as of draw_weights().
    """
    spark = perf.sparkSession
    times = perf.select("t").distinct()
    placed = perf.join(times.withColumn("_i", F.row_number().over(Window.orderBy("t")) - 1), "t")  # times alone are numbered in one place
    n = times.count()
    block = max(1.0, mean_block or n ** (1 / 3))
    weights = draw_weights(spark, n, n_boot, 1 / block, seed) if weights is None else weights
    means = placed.groupBy("rule").agg(F.avg("x").alias("m"))
    boot = placed.join(weights, "_i").groupBy("b", "rule").agg(F.sum(F.col("w") * F.col("x")).alias("bm")).join(means, "rule")
    sd = boot.groupBy("rule").agg(F.stddev_samp(F.col("bm") - F.col("m")).alias("sd")).filter("sd > 1e-15")
    unit = F.col("sd") if studentised else F.lit(1.0)
    best = means.join(sd, "rule").withColumn("s", F.col("m") / unit)
    best = best.agg(F.max("s").alias("stat"), F.max_by("rule", "s").alias("best"), F.max_by("m", "s").alias("best_mean"), F.count("*").alias("n_live")).first()
    top = boot.join(sd, "rule").groupBy("b").agg(F.max((F.col("bm") - F.col("m")) / unit).alias("x"))
    above = F.count_if(F.col("x") >= F.lit(best["stat"]).cast("double"))
    kind = perf.schema["rule"].dataType
    return top.agg(F.when(F.lit(best["n_live"]) > 0, (1 + above) / (F.lit(n_boot) + 1)).alias("p_value")).select(
        "p_value", F.lit(best["stat"]).cast("double").alias("stat"), F.lit(best["best"]).cast(kind).alias("best"), F.lit(best["best_mean"]).cast("double").alias("best_mean"),
        F.lit(means.count()).alias("n_rules"), F.lit(best["n_live"]).alias("n_live"), F.lit(block).alias("mean_block"),
    )


def student_t_sf(t: float, df: float) -> float:
    """P(T > t): Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    if math.isinf(df):
        return 0.5 * math.erfc(t / math.sqrt(2))
    end, n = math.atan(abs(t) / math.sqrt(df)), 2000
    f = lambda a: math.cos(a) ** (df - 1)
    h = end / n
    area = h / 3 * (f(0) + f(end) + 4 * sum(f(h * i) for i in range(1, n, 2)) + 2 * sum(f(h * i) for i in range(2, n, 2))) if end else 0.0
    total = math.sqrt(math.pi) * math.exp(math.lgamma(df / 2) - math.lgamma((df + 1) / 2))
    return 0.5 - area / total if t >= 0 else 0.5 + area / total


def bonferroni_t_threshold(k: int, df: float, alpha: float = 0.05) -> float:
    low, high = 0.0, 1e3
    while high - low > 1e-10:
        mid = (low + high) / 2
        low, high = (mid, high) if k * student_t_sf(mid, df) > alpha else (low, mid)
    return high
