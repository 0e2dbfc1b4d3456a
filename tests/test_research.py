"""Search, walk-forward, costs, sources, sinks and studies on small bars with exact answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import operands as P
from tessera.functions.indicators import W
from tessera.operators import audit, costs, entries, exposure, inference, outcomes, quality, search, segments, stats, studies
from tessera.operators import walk_forward as wf
from tessera.operators.conditions import Compare, Cross, condition_id, evaluate, operands_of, to_dict
from tessera.sources import bars as B
from tessera.sources import sinks


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(1)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 500)))
    rows = [("s", t, float(o), float(max(o, c) * 1.004), float(min(o, c) * 0.996), float(c), 1.0) for t, (o, c) in enumerate(zip(np.append(100, close[:-1]), close))]
    df = spark.createDataFrame(rows, "series string, t long, open double, high double, low double, close double, volume double")
    return df.withColumn("ts", quality.at_epoch(F.col("t") * 3600)).cache()


@pytest.fixture(scope="module")
def table(bars):
    return outcomes.build(bars, outcomes.Trade(tp=0.01, sl=0.01, horizon=8)).cache()


TREES = [Cross(P.operand("price", "close"), P.operand("sma", 9)), Compare(P.operand("rsi", 7), "<", 35.0), Compare(P.operand("return", 2), ">", 0.5)]


@pytest.mark.parametrize("cooldown", [None, 1, 12])
def test_one_pass_finds_the_entries_of_the_plain_way(spark, bars, table, cooldown):
    seg = segments.frame(spark, segments.chronological_split(500))
    features = P.materialise(bars, operands_of(TREES))
    found = search.entries(bars, table, {condition_id(t): (t, None) for t in TREES}, seg, 8, cooldown)
    got = {(r["condition_id"], r["segment"], t) for r in found.collect() for t in r["entries"]}
    signals = entries.long_signals(evaluate(features, {condition_id(t): t for t in TREES}), [condition_id(t) for t in TREES])
    plain = entries.select(entries.candidates(signals, seg, 8), table if cooldown is None else None, cooldown or 1)
    assert got == {(r["condition_id"], r["segment"], r["t"]) for r in plain.collect()} and len(got) > 40
    counts = {(r["condition_id"], r["segment"]): r for r in found.collect()}
    assert len(counts) == 9 and all(r["n_raw_signals"] == r["n_dropped_horizon"] + r["n_dropped_cooldown"] + len(r["entries"]) for r in counts.values())
    rows = search.evaluate(found, table, seg, 8, search.Plan(least=1)).collect()
    assert len(rows) == 9 and {r["passed"] for r in rows if r["n_entries"] == 0} == {False}


def test_arrays_of_operands_are_their_columns(spark, bars):
    ops = [P.operand("price", "open"), P.operand("sma", 7), P.operand("ema", 5), P.operand("rsi", 6), P.operand("atr", 5), P.operand("atr_pct", 5), P.operand("macd", 3, 8, 4, "hist")]
    ops += [P.operand("return", 3), P.operand("candle", "body_ratio"), P.operand("candle", "lower_wick"), P.operand("relvol", 4, 9), P.operand("htf", 4 * P.HOUR, 5)]
    pdf = P.materialise(bars, ops).toPandas().sort_values("t").reset_index(drop=True)
    for name, values in P.arrays(pdf, ops).items():
        assert values == pytest.approx(pdf[name].to_numpy(float), nan_ok=True), name
    # and the completed candles are those of the columns' form
    from tessera.functions import indicators as I

    htf = I.with_htf_trend(bars, 4 * P.HOUR, 5, 3600, "x").select("t", "x").toPandas().sort_values("t")
    assert htf["x"].to_numpy(float) == pytest.approx(pdf["htf_14400_5"].to_numpy(float), nan_ok=True)


def test_draws_are_seeded_different_and_of_one_scale(spark, bars):
    train = segments.frame(spark, [(0, "TRAIN", 0, 200), (1, "TRAIN", 100, 300)])
    for plan in (search.Plan(n_simple=30, regime=True), search.Plan(n_simple=12, structured=True), search.Plan(n_simple=12, structured=True, side="SHORT")):
        a, counts = search.generate(bars, train, plan)
        b, _ = search.generate(bars, train, plan)
        assert {f: [t.key for t in x] for f, x in a.items()} == {f: [t.key for t in x] for f, x in b.items()}
        assert set(a) == {0, 1} and all(len({t.key for t in x}) == plan.n_simple for x in a.values()) and counts["attempts"] >= plan.n_simple
        assert plan.structured == all(t.type == "context" for t in a[0])
    # a threshold is the quantile of its fold's TRAIN, to three digits
    x = P.operand("return", 2)
    got = search.quantiles(bars, train, {(x, 0.3)})
    two = search.quantiles(bars.unionByName(bars.withColumn("series", F.lit("u"))), train, {(x, 0.3)})
    close = np.array([r["close"] for r in bars.orderBy("t").collect()])
    ret = np.append([np.nan, np.nan], close[2:] / close[:-2] - 1)
    assert got[1]["return_2", 0.3] == pytest.approx(np.nanquantile(ret[100:300], 0.3))
    assert two[1]["return_2", 0.3] == pytest.approx(np.nanquantile(np.tile(ret[100:300], 2), 0.3))
    assert [search.round_sig(v, 3) for v in (0.0012345, 123456.0, -0.5, 0.0)] == [0.00123, 123000.0, -0.5, 0.0]
    deep = search.complex_trees(search.Grammar(search.Plan(n_complex=25, max_depth=3)), TREES)
    assert len({t.key for t in deep}) == len(deep) > 5 and all(2 <= t.depth <= 4 and len(set(search.leaves(t))) == len(search.leaves(t)) for t in deep)
    assert search.grid(["LONG", "SHORT"], [1], [2], [3, 4])[-1] == ("SHORT", 1, 2, 4)


def test_walk_forward_tables(spark, bars, table, tmp_path):
    folds = segments.frame(spark, segments.make_folds(500, folds=3, horizon=8))
    out = wf.run(bars, table, folds, 8, search.Plan(least=1, fraction=0.0, bounds={"mode": "lift", "lift_p": -1.0, "lift_mean": -1.0}), given=TREES[:2])
    summary = {r["fold"]: r for r in out["summary"].collect()}
    agg = out["aggregate"].first()
    assert len(summary) == agg["n_folds"] == 3 and all(r["selected_in_train"] == 2 for r in summary.values())
    assert agg["oos_total_entries"] == sum(r["oos_entries"] for r in summary.values()) == out["oos_series"].agg(F.sum("cnt")).first()[0]
    val = {r["fold"]: (r["start"], r["end"]) for r in folds.filter("segment = 'VALIDATION'").collect()}
    assert out["oos_series"].count() == sum(b - a for a, b in val.values())
    for f, (a, b) in val.items():
        close = [r["close"] for r in bars.filter(f"t in ({a}, {b - 1})").orderBy("t").collect()]
        assert summary[f]["val_price_change"] == pytest.approx(close[1] / close[0] - 1)
    series = wf.per_condition_series(wf.procedure_series(out["oos_series"]), out["summary"]).filter("x <> 0")
    assert series.count() > 0
    base = spark.createDataFrame([(f, 0.001) for f in val], "fold int, base_mean double")
    lift = wf.procedure_series(out["oos_series"], base).groupBy("t").agg(F.sum("x").alias("x"))
    m = wf.side_metrics(out["summary"], wf.procedure_series(out["oos_series"]).select("t", "x"), lift, 8).first()
    assert m["folds"] == 3 and m["selected_in_train_total"] == 6 and m["hac_t_3H_net"] is not None
    wf.save(spark, str(tmp_path / "run_a"), out)
    assert sinks.load_results(spark, str(tmp_path / "run_a"), "summary").count() == 3 and sinks.load_manifest(spark, str(tmp_path / "run_a"))["n_passed_train"] == 6
    assert {r["run"] for r in sinks.load_folds(spark, str(tmp_path / "run_*"), "summary").collect()} == {"run_a"}
    total = search.grid_summary([(("LONG", 0.01, 0.01, 8), out["conditions"])]).first()
    assert (total["evaluated"], total["passed_TRAIN".lower()]) == (6, 6)
    assert stats.survivors(out["conditions"]).filter("segment <> 'VALIDATION'").count() == 0
    assert stats.run_parameters(out["summary"], {"seed": 42}).first()["seed"] == 42
    assert "selected_in_train" in sinks.report(out["summary"], ["fold", "selected_in_train", "base_val_mean_net"], "fold", 2).split("\n")[0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-01 00:00:00,1,2,0.5,1.5,9\n2024-01-01 01:00:00,1.5,2,1,1.8,9\n2024-01-01 01:00:00,1.5,2.5,1,2.2,9\nnone,1,1,1,1,1\n2024-01-01 02:00:00,2,1,1,2,9\n")
    got = B.load(spark, "csv", str(tmp_path / "a.csv")).orderBy("t").collect()
    assert [(r["t"], r["close"]) for r in got] == [(0, 1.5), (1, 2.2)]
    folder = tmp_path / "k"
    folder.mkdir()
    line = lambda at, c: f"{at},1,3,0.5,{c},7,0,0,0,0,0,0\n"
    (folder / "2024-01.csv").write_text("open_time,o,h,l,c,v,a,b,c2,d,e,f\n" + line(1_704_067_200_000, 2) + line(1_704_070_800_000, 2.5))
    (folder / "2025-01.csv").write_text(line(1_704_070_800_000_000, 2.6) + line(1_735_689_600_000_000, 2))
    got = B.load(spark, "kline", str(folder)).orderBy("t").collect()
    assert [(str(r["ts"]), r["close"]) for r in got] == [("2024-01-01 00:00:00", 2.0), ("2024-01-01 01:00:00", 2.6), ("2025-01-01 00:00:00", 2.0)]
    with pytest.raises(NotImplementedError):
        B.load(spark, "download", "x")
    with pytest.raises(ValueError):
        B.load(spark, "nothing", "x")
    rows = spark.range(8).select(F.lit("s").alias("series"), quality.at_epoch(F.col("id") * 3600).alias("ts"), *[F.col("id").cast("double").alias(c) for c in (*quality.PRICES, "volume")])
    rows.write.parquet(f"{tmp_path}/bars")
    assert [r["volume"] for r in B.load(spark, "parquet", f"{tmp_path}/bars", 3600, 4 * 3600).orderBy("t").collect()] == [6.0, 22.0]
    sinks.save_csv(rows, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 8
    trees = {condition_id(t): to_dict(t) for t in TREES}
    sinks.save_trees(spark, str(tmp_path), trees)
    assert sinks.load_trees(spark, str(tmp_path)) == trees
    sinks.save_results(spark, f"{tmp_path}/r", {"x": rows.withColumn("segment", F.lit("A"))}, {"seed": 1})
    assert sinks.load_results(spark, f"{tmp_path}/r", "x").first()["segment"] == "A" and sinks.load_manifest(spark, f"{tmp_path}/r") == {"seed": 1}
    assert sinks.run_tag("BTC", "1h", "LONG", 42, "fixed", 30, "x") == "run_BTC_1h_LONG_seed42_fixed_H30_x"


def test_sessions_follow_the_markets_clock(spark):
    """New York's offset changes on 2024-03-10: its sessions begin an hour earlier in UTC from then on."""
    days = spark.createDataFrame([("s", "2024-03-08"), ("s", "2024-03-11")], "series string, day string").withColumn("day", F.to_date("day"))
    at = lambda label: [str(r["ts"]) for r in quality.session_grid(days, "09:30:00", "11:30:00", "America/New_York", 3600, label).orderBy("ts").collect()]
    assert at("start") == ["2024-03-08 14:30:00", "2024-03-08 15:30:00", "2024-03-11 13:30:00", "2024-03-11 14:30:00"]
    assert at("end") == ["2024-03-08 15:30:00", "2024-03-08 16:30:00", "2024-03-11 14:30:00", "2024-03-11 15:30:00"]
    with pytest.raises(ValueError):
        at("middle")
    b = spark.createDataFrame([("s", t) for t in ("2024-03-08 14:30:00", "2024-03-08 15:30:00", "2024-03-11 14:30:00")], "series string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    own = quality.business_days(b, "America/New_York")
    assert [str(r["day"]) for r in own.orderBy("day").collect()] == ["2024-03-08", "2024-03-11"]
    found = quality.completeness(b, quality.session_grid(own, "09:30:00", "11:30:00", "America/New_York", 3600))
    assert [str(r["ts"]) for r in found["missing"].collect()] == ["2024-03-11 13:30:00"] and found["unexpected"].count() == 0 and not found["summary"].first()["is_complete"]
    new = b.filter("ts > '2024-03-09'")
    assert quality.merge_datasets(b.withColumn("v", F.lit(1)), new.withColumn("v", F.lit(2)), prefer="new").filter("v = 2").count() == 1


def test_cost_models(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    p, x = F.lit(100.0), F.lit(105.0)
    for name in ("optimistic", "typical", "conservative"):
        for side in ("LONG", "SHORT"):
            for passive in (True, False):
                vol = F.lit(0.02) if name == "conservative" else None
                assert one(costs.scenario(name).net_return(side, p, x, F.lit(passive), vol, vol)) == pytest.approx(one(outcomes.net_return(side, name, p, x, F.lit(passive), vol, vol)))
    assert one(costs.VolatilitySlippage(0.001, 0.05).at(None)) == pytest.approx(0.0015) and costs.ExchangeFee("spot_bnb").rate(True) == 0.00075
    a = costs.scenario("custom", {"fee": 0.001, "spread": 0.0005, "slippage": 0.0002})
    assert one(a.net_return("LONG", p, x, F.lit(False))) == pytest.approx(one(costs.market_only("LONG", p, x, 0.001, 0.0005, 0.0002)))
    with pytest.raises(ValueError):
        costs.scenario("none")


def test_inference_edges(spark):
    blocks = spark.createDataFrame([(b, "A", 1.0, 50) for b in range(4)] + [(0, "B", 9.0, 50), (1, "B", 9.0, 50), (2, "B", 0.0, 0), (3, "B", 0.0, 0)], "block int, rule string, sum double, cnt long")
    got = {r["split"]: r["best"] for r in inference.cscv(blocks, min_trades=1).collect()}
    assert 0 not in got and len(got) == 5  # inside blocks 0 and 1 the best is B, which has no trade outside
    assert inference.cscv(blocks, min_trades=1, max_combinations=3).count() <= 3
    flat = spark.createDataFrame([(t, "r", 0.0) for t in range(10)], "t long, rule string, x double")
    row = inference.reality_check(flat, 10).first()
    assert row["p_value"] is None and (row["n_rules"], row["n_live"]) == (1, 0)
    rng = np.random.default_rng(0)
    x = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(rng.normal(0.1, 1, 200))], "series string, t long, x double")
    assert inference.reality_check(x.withColumnRenamed("series", "rule"), 40, 3, studentised=False).first()["n_live"] == 1
    few = inference.newey_west_t(x, 20).first()["hac_t"]
    old, inference.LAG_COLUMNS = inference.LAG_COLUMNS, 1
    try:
        assert inference.newey_west_t(x, 20).first()["hac_t"] == pytest.approx(few)
    finally:
        inference.LAG_COLUMNS = old
    assert inference.newey_west_t(x.limit(2), 5).first()["hac_t"] is None


def test_studies(spark, bars, table):
    rows = table.filter("outcome IS NOT NULL").withColumn("t", F.col("e") - 1).withColumns({"tp_frac": F.lit(0.01), "sl_frac": F.lit(0.02)})
    a = studies.economics(rows.filter("e % 3 = 0"), 500, 2, 3)
    b = studies.economics(rows, 500, 2, 3, scenario="optimistic")
    t = studies.turnover(a, b).first()
    assert t["d_net"] == pytest.approx(t["by_turnover"] + t["by_gross"] + t["by_cost"]) and a.first()["tp_share_random_walk"] == pytest.approx(2 / 3)
    w = [studies.random_windows(rows, 500, 100, 12, seed=s).first() for s in (1, 1, 2)]
    assert w[0] == w[1] != w[2] and w[0]["n_windows"] == 12
    seg = segments.frame(spark, [(0, "A", 0, 500)])
    every = entries.select(entries.candidates(bars.select("series", "t", F.lit("all").alias("condition_id")), seg, 8), table)
    g = studies.geometry_baseline(every, table).first()
    assert 50 < g["max_trades"] < 500 and g["mean_hold"] == pytest.approx(500 / g["max_trades"], rel=0.1)
    ret = bars.select("t", (F.col("close") / F.col("open") - 1).alias("x"))
    c = studies.overlap_calibration(ret, 8, reps=60).first()
    assert c["reps"] == 60 and c["plain_rejects"] > c["hac_rejects"]  # overlapping outcomes make the plain t reject too often
    d = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    v = np.array([1, 2, 4.0])
    assert d.agg(studies.paired_t(F.col("x"), True)).first()[0] == pytest.approx(v.mean() / (v.std() / 3**0.5)) and d.limit(2).agg(studies.paired_t(F.col("x"))).first()[0] is None
    rules = [("R1", F.col("x") > 1), ("R2", F.col("x") > 3)]
    got = studies.decide(d, rules, [("A", F.expr("R1 AND R2")), ("B", F.col("R1"))], "D").orderBy("x").collect()
    assert [r["scenario"] for r in got] == ["D", "B", "A"]
    w = exposure.per_window(exposure.evaluate(exposure.RULES[2].positions(bars), 50)).withColumn("series", F.lit("s"))
    assert exposure.pooled_criteria(w, 2.0).first()["confirmed"] in (True, False)
    one = exposure.benchmarks(exposure.evaluate(exposure.RULES[2].positions(bars), 50)).first()
    assert one["sharpe_buy_hold"] is not None and one["max_drawdown_buy_hold"] <= 0
    assert exposure.causality(bars, exposure.ExposureRule("r", P.operand("sma", 9), ">", 100.0), [100]).agg(F.sum("failures")).first()[0] == 0


def test_audits_find_what_looks_ahead(spark, bars):
    leak = lambda b: b.withColumn("x", F.lead("close").over(W()))
    got = audit.check_conditions(bars, leak, {"bad": Compare("x", ">", "close"), "good": Compare("close", ">", 100.0)}, [250, 251, 252, 253])
    by = {r["column"]: r["n"] for r in got.groupBy("column").agg(F.sum("failures").alias("n")).collect()}
    assert by["good"] == 0 and by["bad"] > 0
    assert {r["family"]: r["failures"] > 0 for r in audit.by_family(got, "^([a-z]+)").collect()} == {"bad": True, "good": False}
    late = audit.startup_sensitivity(bars, lambda b: P.materialise(b, [P.operand("ema", 30), P.operand("sma", 5)]), ["ema_30", "sma_5"], [100], 5, 1e-9)
    assert {r["column"]: r["failures"] > 0 for r in late.collect()} == {"ema_30": True, "sma_5": False}
    names = outcomes.favourable("LONG", 10, [{"kind": "reach", "p": 0.02, "bars": 5}, {"kind": "at_horizon", "p": 0.01, "bars": 20}, {"kind": "down_then_up", "p1": 0.01, "p2": 0.02}, {"kind": "up_then_down", "p1": 0.01, "p2": 0.02}])
    assert list(names) == ["reach_0.02_5", "down_then_up_0.01_0.02", "up_then_down_0.01_0.02"]
    assert outcomes.with_window(bars, 10).select(*[c.alias(k) for k, c in names.items()]).count() == 500
    whole = entries.trade_intervals(spark.createDataFrame([("s", 5, 6, 3, 0, 20)], "series string, t long, e long, exit_offset int, start long, end long"), 8).withColumn("ok", entries.fits()).first()
    assert (whole["exit_bar"], whole["info_end"], whole["ok"]) == (9, 13, True)
