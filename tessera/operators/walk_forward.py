"""Walk-forward: the search in each fold's TRAIN, judged in its VALIDATION. Folds are a key, not a loop over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.sinks import save_results

from . import inference, search, stats
from . import segments as S


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def fold_summary(bars: DataFrame, segments: DataFrame, rows: DataFrame, base: DataFrame) -> DataFrame:
    """A row a fold. rows: condition rows of TRAIN and VALIDATION; base: baseline statistics of VALIDATION by fold."""
    at = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c)))
    out = segments.filter("fold >= 0").groupBy("fold").agg(
        at("TRAIN", "start").alias("train_start"), at("TRAIN", "end").alias("train_end"), at("VALIDATION", "start").alias("val_start"), at("VALIDATION", "end").alias("val_end")
    )
    price = lambda t, name: bars.select(t.alias("_t"), F.col("close").alias(name))
    first, last = price(F.col("t"), "_first"), price(F.col("t") + 1, "_last")
    out = out.join(first, out["val_start"] == first["_t"]).drop("_t").join(last, out["val_end"] == last["_t"]).drop("_t")
    out = out.withColumn("val_price_change", F.col("_last") / F.col("_first") - 1).drop("_first", "_last")
    train = rows.filter("segment = 'TRAIN'").groupBy("fold").agg(F.count("*").alias("n_evaluated"), F.count_if("passed").alias("selected_in_train"))
    b = base.select("fold", F.col("P_TP_FIRST").alias("base_val_P_TP"), F.col("mean_net_return").alias("base_val_mean_net"))
    val = rows.filter("segment = 'VALIDATION'").join(b, "fold")
    net, n = F.col("mean_net_return"), F.col("n_entries")
    val = val.groupBy("fold").agg(
        F.count_if("passed").alias("passed_val"), F.sum(n).alias("oos_entries"), stats.pooled("P_TP_FIRST", "n_entries").alias("oos_pooled_P_TP"), stats.pooled("mean_net_return", "n_entries").alias("oos_pooled_mean_net"),
        F.median(net).alias("oos_median_cond_mean_net"), _share(F.when(n > 0, net > 0)).alias("oos_frac_cond_net_gt0"), _share(F.when(n > 0, net > F.col("base_val_mean_net"))).alias("oos_frac_cond_beat_base"),
        stats.pooled("lift_mean_net_return", "n_entries").alias("oos_pooled_lift_net"),
    )
    return out.join(train, "fold", "left").join(b, "fold", "left").join(val, "fold", "left").fillna(0, ["selected_in_train", "passed_val", "oos_entries", "n_evaluated"])


def aggregate(summary: DataFrame, series: DataFrame, horizon: int) -> DataFrame:
    """One row over all folds. series: (t, x) of the whole procedure, for the autocorrelation-robust t of 3 horizons."""
    net, base, n = F.col("oos_pooled_mean_net"), F.col("base_val_mean_net"), F.col("oos_entries")
    out = summary.agg(
        F.count("*").alias("n_folds"), F.count_if(F.col("selected_in_train") > 0).alias("folds_with_selected"), stats.pooled("oos_pooled_mean_net", "oos_entries").alias("oos_pooled_mean_net_all_folds"),
        F.avg(base).alias("base_val_mean_net_avg"), F.count_if(net > 0).alias("folds_oos_net_gt0"), F.count_if(net > base).alias("folds_oos_beat_base"), stats.fold_t(net).alias("oos_fold_level_t"),
        F.sum(n).alias("oos_total_entries"), F.sum("n_evaluated").alias("total_conditions_evaluated"),
    )
    hac = inference.newey_west_t(series.withColumn("series", F.lit("all")), 3 * horizon).agg(F.max("hac_t").alias("oos_hac_t_3H"))
    return out.withColumn("_k", F.lit(1)).join(hac.withColumn("_k", F.lit(1)), "_k").drop("_k")


def oos_series(bars: DataFrame, folds: DataFrame, rows: DataFrame, scenario: str = "typical") -> DataFrame:
    """Per bar of a VALIDATION range (fold, t, covered): entries and sums at the entry bar, by outcome, and net less baseline."""
    val = folds.filter("segment = 'VALIDATION'")
    grid = S.assign(bars.select("series", "t"), val).select("series", "fold", "t")
    own = stats.oos_series(rows, scenario).withColumnRenamed("e", "t")
    out = grid.join(own, ["series", "fold", "t"], "left")
    counted = [c for c in own.columns if c not in ("series", "fold", "t")]
    return out.fillna(0, counted).withColumn("covered", F.lit(True))


def procedure_series(oos: DataFrame, base: DataFrame | None = None, scenario: str = "typical") -> DataFrame:
    """(series, fold, t, x): the mean net return of the entries at a bar, 0 where there is none; less the fold's baseline
    where base (fold, base_mean) is given."""
    x = F.col(f"sum_{scenario}") / F.when(F.col("cnt") > 0, F.col("cnt"))
    if base is not None:
        oos, x = oos.join(F.broadcast(base.select("fold", "base_mean")), "fold"), x - F.col("base_mean")
    return oos.select("series", "fold", "t", F.coalesce(x, F.lit(0.0)).alias("x"))


def entry_series(bars: DataFrame, rows: DataFrame, benchmark: float, scenario: str = "typical") -> DataFrame:
    """(series, t, x): net return less a benchmark at an entry's bar, else 0."""
    own = rows.groupBy("series", F.col("e").alias("t")).agg(F.sum(F.col(f"net_{scenario}") - F.lit(benchmark)).alias("x"))
    return bars.select("series", "t").join(own, ["series", "t"], "left").fillna(0.0, ["x"])


def per_condition_series(series: DataFrame, summary: DataFrame) -> DataFrame:
    """x over the number of conditions that the fold selected; 0 where it selected none."""
    n = F.col("selected_in_train")
    return series.join(F.broadcast(summary.select("fold", "selected_in_train")), "fold").withColumn("x", F.when(n > 0, F.col("x") / n).otherwise(0.0)).drop("selected_in_train")


def condition_blocks(features: DataFrame, outcomes: DataFrame, trees: dict, bars: int, count: int, horizon: int, cooldown: int | None = None, scenario: str = "typical") -> DataFrame:
    """(block, rule, sum, cnt) of each condition's entries in each block, purged as a segment: what cscv() takes."""
    own = S.frame(features.sparkSession, S.blocks(bars, count))
    found = search.entries(features, outcomes, {k: (t, None) for k, t in trees.items()}, own, horizon, cooldown)
    rows = search.entry_rows(found, outcomes)
    some = rows.groupBy(F.col("fold").alias("block"), F.col("condition_id").alias("rule")).agg(F.sum(f"net_{scenario}").alias("sum"), F.count("*").alias("cnt"))
    every = found.select(F.col("fold").alias("block"), F.col("condition_id").alias("rule")).distinct()
    return every.join(some, ["block", "rule"], "left").fillna(0, ["sum", "cnt"])


def covered_by_all(series: DataFrame, variants: int) -> DataFrame:
    """The bars that all variants cover. series: (variant, t, covered)."""
    return series.filter("covered").groupBy("t").agg(F.count_distinct("variant").alias("_n")).filter(F.col("_n") == variants).select("t")


def side_metrics(summary: DataFrame, series: DataFrame, lift: DataFrame, horizon: int) -> DataFrame:
    """The block that two variants are compared by; series and lift: (t, x) of the procedure, net and less baseline."""
    one = lambda df, name: inference.newey_west_t(df.withColumn("series", F.lit("all")), 3 * horizon).agg(F.max("hac_t").alias(name)).withColumn("_k", F.lit(1))
    net, d = F.col("oos_pooled_mean_net"), F.col("oos_pooled_mean_net") - F.col("base_val_mean_net")
    out = summary.agg(
        F.count("*").alias("folds"), F.count_if(F.col("oos_entries") > 0).alias("folds_with_trades"), stats.pooled("oos_pooled_mean_net", "oos_entries").alias("oos_pooled_mean_net"),
        F.avg(net).alias("mean_fold_net"), F.avg(d).alias("mean_fold_lift"), stats.fold_t(net).alias("t_folds_net"), stats.fold_t(d).alias("t_folds_lift"),
        F.count_if(net > 0).alias("folds_net_gt0"), F.count_if(d > 0).alias("folds_beat_base"), F.sum("oos_entries").alias("oos_entries"), F.sum("selected_in_train").alias("selected_in_train_total"),
        F.sum("passed_val").alias("passed_val_total"), F.avg("oos_frac_cond_net_gt0").alias("mean_frac_cond_net_gt0"), F.avg("oos_frac_cond_beat_base").alias("mean_frac_cond_beat_base"),
    ).withColumn("_k", F.lit(1))
    return out.join(one(series, "hac_t_3H_net"), "_k").join(one(lift, "hac_t_3H_lift"), "_k").drop("_k")


def run(bars: DataFrame, outcomes: DataFrame, folds: DataFrame, horizon: int, plan: search.Plan, given=None) -> dict[str, DataFrame]:
    """Tables of a walk-forward: conditions, summary, oos_series, aggregate. outcomes should be stored."""
    own = folds.filter("fold >= 0")
    rows, counts = search.run(bars, own, outcomes, horizon, plan, given=given)
    rows = rows.cache()
    val = search.in_segment(own, "VALIDATION")
    base = stats.compute(search.baseline_rows(outcomes, val, horizon), ["fold"])
    summary = fold_summary(bars, own, rows, base)
    trees: dict = {}
    for r in rows.filter("segment = 'TRAIN' AND passed").select("fold", "condition_id").distinct().collect():
        trees.setdefault(r["condition_id"], (counts["trees"][r["condition_id"]], []))[1].append(r["fold"])
    entered = search.entry_rows(search.entries(bars, outcomes, trees, val, horizon, plan.cooldown), outcomes)
    oos = oos_series(bars, own, entered)
    series = procedure_series(oos).groupBy("t").agg(F.sum("x").alias("x"))
    counts = {k: v for k, v in counts.items() if k != "trees"}
    return {"conditions": rows, "summary": summary, "oos_series": oos, "aggregate": aggregate(summary, series, horizon), "counts": counts}


def save(spark, path: str, tables: dict) -> None:
    """Tables partitioned by fold where they have one, and the counts as a manifest."""
    save_results(spark, path, {k: v for k, v in tables.items() if isinstance(v, DataFrame)}, tables.get("counts", {}), partition_by="fold")


def median_from_histogram(hist: DataFrame, value: str, n: str, keys=()) -> DataFrame:
    """The first value whose cumulative share reaches a half."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    share = F.sum(n).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(n).over(w)
    return hist.withColumn("_s", share).filter("_s >= 0.5").groupBy(*keys).agg(F.min(value).alias("median"))
