"""Look-ahead audits: values up to bar k must not change when what follows k is cut off or disturbed.

Operands, conditions, entries, exit levels, resampled bars and positions are all audited by check(): what is audited is
a function from bars to columns by (series, t).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .conditions import evaluate
from .quality import PRICES, epoch


def truncate(bars: DataFrame, k: int) -> DataFrame:
    return bars.filter(F.col("t") <= k)


def perturb_future(bars: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Prices after k times a hashed factor of a bar, from 0.5 to 1.5, and volumes times one from 0.2 to 5; a bar stays coherent."""
    share = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "series", "t"), F.lit(1000)) / 1000.0
    factors = {"open": 0.5 + share(0), "high": 0.5 + share(0), "low": 0.5 + share(0), "close": 0.5 + share(0), "volume": 0.2 + 4.8 * share(1)}
    return bars.withColumns({c: F.when(F.col("t") > k, F.col(c) * f).otherwise(F.col(c)) for c, f in factors.items() if c in bars.columns})


MODES = {"truncate": truncate, "perturb": perturb_future}


def _failures(both: DataFrame, columns: list[str], rtol: float, atol: float) -> DataFrame:
    same = lambda c: F.coalesce(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= atol + rtol * F.abs(F.col(f"{c}_b")), F.col(f"{c}_a").isNull() & F.col(f"{c}_b").isNull())
    counts = both.agg(*[F.count_if(~same(c)).alias(c) for c in columns])
    return counts.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("column", "failures"))


def check(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: list[str], cuts: list[int], rtol: float = 1e-9, atol: float = 1e-12, settled: int = 0) -> DataFrame:
    """(mode, k, column, failures) for each way, cut and column, over the bars up to settled before the cut."""
    whole = compute(bars).select("series", "t", *[F.col(c).cast("double").alias(f"{c}_a") for c in columns])
    out = None
    for mode, change in MODES.items():
        for k in cuts:
            other = compute(change(bars, k)).select("series", "t", *[F.col(c).cast("double").alias(f"{c}_b") for c in columns])
            both = whole.join(other, ["series", "t"], "full").filter(F.col("t") <= k - settled)
            one = _failures(both, columns, rtol, atol).select(F.lit(mode).alias("mode"), F.lit(k).alias("k"), "column", "failures")
            out = one if out is None else out.unionByName(one)
    return out


def check_conditions(bars: DataFrame, prepare: Callable[[DataFrame], DataFrame], trees: dict, cuts: list[int]) -> DataFrame:
    """Signals of trees over prepare(bars)."""
    return check(bars, lambda b: evaluate(prepare(b), trees), list(trees), cuts)


def check_entries(bars: DataFrame, accepted: Callable[[DataFrame], DataFrame], cuts: list[int], settled: int) -> DataFrame:
    """Entries up to settled bars before each cut (an entry until exit needs its outcome): accepted(bars) has (series, t)."""

    def marks(b):
        own = accepted(b).select("series", "t").distinct().withColumn("entry", F.lit(1.0))
        return b.select("series", "t").join(own, ["series", "t"], "left").fillna(0.0, ["entry"])

    return check(bars, marks, ["entry"], cuts, settled=settled)


def check_exit_levels(bars: DataFrame, levels: Callable[[DataFrame], DataFrame], cuts: list[int]) -> DataFrame:
    """Profit and stop levels of the bars up to each cut: levels(bars) has (series, t, tp, sl)."""
    return check(bars, levels, ["tp", "sl"], cuts)


def check_resample(bars: DataFrame, resample: Callable[[DataFrame], DataFrame], rule: int, cuts: list[int], base: int = 3600) -> DataFrame:
    """Buckets that are closed by bar k must not change with what follows it. A loose resampling fails: it keeps open ones."""

    def closed(b):
        own = resample(b).withColumn("_close", epoch() + rule)
        at = b.select("series", "t", (epoch() + base).alias("_now"))
        last = at.join(own, "series").filter("_close <= _now").groupBy("series", "t").agg(F.max("_close").alias("_close"))
        return last.join(own, ["series", "_close"]).select("series", "t", *PRICES)

    return check(bars, closed, list(PRICES), cuts)


def startup_sensitivity(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: list[str], starts: list[int], after: int, rtol: float = 1e-6) -> DataFrame:
    """(start, column, failures): values from after bars past each start that hang on what lies before the start."""
    whole = compute(bars).select("series", "t", *[F.col(c).cast("double").alias(f"{c}_a") for c in columns])
    out = None
    for s in starts:
        other = compute(bars.filter(F.col("t") >= s)).select("series", "t", *[F.col(c).cast("double").alias(f"{c}_b") for c in columns])
        both = whole.join(other, ["series", "t"], "full").filter(F.col("t") >= s + after)
        one = _failures(both, columns, rtol, 0.0).select(F.lit(s).alias("start"), "column", "failures")
        out = one if out is None else out.unionByName(one)
    return out


def by_family(found: DataFrame, pattern: str = r"^([a-z]+)") -> DataFrame:
    """Numbers and failures of audited columns by the family that their names begin with."""
    family = F.regexp_extract("column", pattern, 1)
    return found.groupBy(family.alias("family")).agg(F.count_distinct("column").alias("n"), F.sum("failures").alias("failures"))
