"""Registered queries of search, walk-forward, costs, calendars, comparisons and audits, with their DuckDB forms."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import indicators as I
from tessera.functions import operands as P
from tessera.operators import audit, costs, exposure, inference, outcomes, quality, search, segments, stats, studies
from tessera.operators import walk_forward as wf
from tessera.operators.conditions import condition_id
from tessera.sources import bars as B

from . import oracles as O
from . import queries as Q
from .queries import BELOW_, CROSS_, H, LONG, featured, query, rounded

#: The given conditions and their signals in SQL.
GIVEN = {"cross": (CROSS_, "v2 AND d2"), "below": (BELOW_, "v3 AND d2")}
PLAN = search.Plan(fraction=0.0, least=3, bounds={"mode": "lift"})
TREES = {condition_id(t): (t, None) for t, _ in GIVEN.values()}


def _entries_sql(segments_sql: str):
    """Parts ending in er: the entries of both conditions, with their outcomes."""
    parts = [*O.SIGNALS, O.outcomes(), segments_sql]
    for i, (_, signal) in enumerate(GIVEN.values()):
        parts.append(re.sub(r"\b(raw|cand|nx|ent)\b", rf"\g<1>{i}", O.entries(cond=signal)))
    ids = [condition_id(t) for t, _ in GIVEN.values()]
    union = " UNION ALL ".join(f"SELECT '{k}' AS condition_id, series, segment, t FROM ent{i}" for i, k in enumerate(ids))
    return [*parts, f"ent AS ({union})", "er AS (SELECT ent.condition_id, ent.segment, ent.t, oc.* FROM ent JOIN oc ON oc.series = ent.series AND oc.e = ent.t + 1)"]


_WF_SEG = Q._FOLD + ", seg AS (SELECT 'T' || fold AS segment, dev - (6 - fold) * val - 3 * val AS start, dev - (6 - fold) * val AS stop FROM fd UNION ALL SELECT 'V' || fold, dev - (6 - fold) * val, dev - (5 - fold) * val FROM fd)"


def _folds(bars):
    return segments.frame(bars.sparkSession, [r for r in segments.make_folds(Q.n_bars(bars), folds=6, horizon=H) if r[0] >= 0])


def _judged(bars, seg):
    table = outcomes.build(bars, LONG)
    found = search.entries(featured(bars), table, TREES, seg, H)
    return table, found


_WF_PARTS = [
    *_entries_sql(_WF_SEG), Q.ALL, "cs AS (SELECT condition_id, segment, count(*) AS n, avg(CAST(outcome = 'TP_FIRST' AS DOUBLE)) AS p, avg(net_typical) AS m FROM er GROUP BY ALL)",
    "bs AS (SELECT segment, avg(CAST(outcome = 'TP_FIRST' AS DOUBLE)) AS p, avg(net_typical) AS m FROM ar GROUP BY segment)",
    "ls AS (SELECT cs.*, n >= 3 AND cs.p >= bs.p AND cs.m > bs.m AS passed, bs.m AS base, CAST(substr(segment, 2) AS INTEGER) AS fold FROM cs JOIN bs USING (segment))",
]


@query("wf_conditions", O.q("SELECT fold, condition_id, segment[1] = 'T' AS train, n AS n_entries, round(m, 8) AS mean_net, round(m - base, 8) AS lift_net, passed FROM ls", *_WF_PARTS))
def wf_conditions(spark, d):
    """Each given condition in TRAIN and VALIDATION of each fold, by one pass over the bars for all of them."""
    bars = B.walk_bars(spark, d)
    seg = _folds(bars)
    table, found = _judged(bars, seg)
    rows = search.evaluate(found, table, seg, H, PLAN).filter("n_entries > 0")
    out = rows.select("fold", "condition_id", (F.col("segment") == "TRAIN").alias("train"), "n_entries", F.col("mean_net_return").alias("mean_net"), F.col("lift_mean_net_return").alias("lift_net"), "passed")
    return rounded(out, "mean_net", "lift_net")


@query("wf_fold_summary", O.q(
    "SELECT fd.fold, dev - (6 - fd.fold) * val AS val_start, dev - (5 - fd.fold) * val AS val_end, coalesce(tr.k, 0) AS selected_in_train, coalesce(vl.n, 0) AS oos_entries, round(vl.m, 8) AS oos_pooled_mean_net, round(b.m, 8) AS base_val_mean_net FROM fd "
    "LEFT JOIN (SELECT fold, count(*) AS k FROM ls WHERE segment[1] = 'T' AND passed GROUP BY fold) tr ON tr.fold = fd.fold LEFT JOIN bs b ON b.segment = 'V' || fd.fold "
    "LEFT JOIN (SELECT v.fold, CAST(sum(v.n) AS BIGINT) AS n, sum(v.n * v.m) / sum(v.n) AS m FROM ls v JOIN ls t ON t.condition_id = v.condition_id AND t.fold = v.fold AND t.segment[1] = 'T' AND t.passed WHERE v.segment[1] = 'V' GROUP BY v.fold) vl ON vl.fold = fd.fold", *_WF_PARTS))  # fmt: skip
def wf_fold_summary(spark, d):
    """A walk-forward of the given conditions: what passes in a fold's TRAIN is judged in its VALIDATION."""
    bars = B.walk_bars(spark, d)
    seg = _folds(bars)
    table, found = _judged(bars, seg)
    rows = search.evaluate(found, table, seg, H, PLAN)
    chosen = rows.filter("segment = 'TRAIN' AND passed").select("fold", "condition_id")
    rows = rows.filter("segment = 'TRAIN'").unionByName(rows.filter("segment = 'VALIDATION'").join(chosen, ["fold", "condition_id"], "left_semi"))
    base = stats.compute(search.baseline_rows(table, seg.filter("segment = 'VALIDATION'"), H), ["fold"])
    out = wf.fold_summary(bars, seg, rows, base)
    cols = ["oos_pooled_mean_net", "base_val_mean_net"]
    return rounded(out.select("fold", "val_start", "val_end", "selected_in_train", "oos_entries", *cols), *cols)


@query("search_run")
def search_run(spark, d):
    """Drawn conditions: simple ones in TRAIN, trees over the best, and what passes in VALIDATION. Drawn by numpy, so without SQL."""
    bars = B.walk_bars(spark, d)
    n = Q.n_bars(bars)
    seg = segments.frame(spark, segments.chronological_split(n))
    plan = search.Plan(n_simple=40, n_complex=10, pool_size=20, least=3, fraction=0.0, bounds={"mode": "lift"})
    rows, _ = search.run(bars, seg, outcomes.build(bars, outcomes.Trade(tp=0.01, sl=0.01, horizon=12)).cache(), 12, plan)
    cols = ["mean_net_return", "lift_P_TP_FIRST", "lift_mean_net_return"]
    return rounded(rows.select("condition_id", "stage", "segment", "n_raw_signals", "n_entries", "passed", "reject_reasons", *cols), *cols)


_BLOCKS = "mx AS (SELECT max(t) + 1 AS n FROM bars), seg AS (SELECT CAST(i AS VARCHAR) AS segment, CAST(floor(n * i / 4.0) AS BIGINT) AS start, CAST(floor(n * (i + 1) / 4.0) AS BIGINT) AS stop FROM mx, (SELECT unnest(generate_series(0, 3)) AS i))"


@query("condition_blocks", O.q("SELECT CAST(s.segment AS INTEGER) AS block, k.condition_id AS rule, round(coalesce(sum(er.net_typical), 0), 8) AS sum, count(er.t) AS cnt FROM seg s CROSS JOIN (SELECT unnest([" + ", ".join(f"'{k}'" for k in TREES) + "]) AS condition_id) k LEFT JOIN er ON er.segment = s.segment AND er.condition_id = k.condition_id GROUP BY ALL", *_entries_sql(_BLOCKS)))
def condition_blocks(spark, d):
    bars = B.walk_bars(spark, d)
    return rounded(wf.condition_blocks(featured(bars), outcomes.build(bars, LONG), {k: t for k, (t, _) in TREES.items()}, Q.n_bars(bars), 4, H), "sum")


@query("entry_series", O.q("SELECT b.series, b.t, round(coalesce(sum(er.net_typical - CAST(0.001 AS DOUBLE)), 0), 8) AS x FROM bars b LEFT JOIN er ON er.series = b.series AND er.e = b.t GROUP BY ALL", *_entries_sql(O.SEG)))
def entry_series(spark, d):
    bars = B.walk_bars(spark, d)
    table, found = _judged(bars, Q.split(bars))
    return rounded(wf.entry_series(bars, search.entry_rows(found, table), 0.001), "x")


@query("procedure_series", O.q("SELECT b.series, b.t, s.fold, round(coalesce(avg(er.net_typical), 0), 8) AS x FROM bars b JOIN (SELECT fold, start, stop FROM seg JOIN fd ON segment = 'V' || fold) s ON b.t >= s.start AND b.t < s.stop LEFT JOIN er ON er.series = b.series AND er.e = b.t AND er.segment = 'V' || s.fold GROUP BY ALL", *_entries_sql(_WF_SEG)))
def procedure_series(spark, d):
    bars = B.walk_bars(spark, d)
    seg = _folds(bars)
    table, found = _judged(bars, seg)
    rows = search.entry_rows(found.filter("segment = 'VALIDATION'"), table)
    return rounded(wf.procedure_series(wf.oos_series(bars, seg, rows)), "x")


# --- costs and policies ----------------------------------------------------------------------------

_VOL = "vv AS (SELECT b.series, b.t, coalesce(lag(atr.y / b.close) OVER (PARTITION BY b.series ORDER BY b.t), CAST(0.01 AS DOUBLE)) AS v FROM bars b JOIN atr USING (series, t))"
_CONS = "(CAST(0.00055 AS DOUBLE) + CAST(0.05 AS DOUBLE) * %s)"


@query("costs_volatility", O.q(
    f"SELECT oc.series, e, round((exit_price * (1 - CASE WHEN outcome = 'TP_FIRST' THEN 0 ELSE {_CONS % 'x.v'} END) * (1 - CAST(0.001 AS DOUBLE))) / (entry_price * (1 + {_CONS % 'n.v'}) * (1 + CAST(0.001 AS DOUBLE))) - 1, 8) AS net_conservative "
    "FROM oc JOIN vv n ON n.series = oc.series AND n.t = e JOIN vv x ON x.series = oc.series AND x.t = e + exit_offset WHERE outcome <> 'AMBIGUOUS'", O.atr(14), _VOL, O.outcomes()))  # fmt: skip
def costs_volatility(spark, d):
    """Slippage that grows with the relative ATR of the bar before the entry and before the exit."""
    bars = I.with_recursive(B.walk_bars(spark, d), ("atr", 14)).withColumn("v", F.col("atr_14") / F.col("close"))
    out = outcomes.build(bars, LONG, scenarios=("conservative",), vol="v").filter("outcome IS NOT NULL AND outcome <> 'AMBIGUOUS'")
    return rounded(out.select("series", "e", "net_conservative"), "net_conservative")


@query("costs_models", O.q("SELECT series, e, " + ", ".join(f"round({O.net('LONG', s, 'entry_price', 'exit_price', chr(111) + 'utcome = ' + repr('TP_FIRST'))}, 8) AS n_{s}" for s in ("optimistic", "typical")) + f", round({O.net('LONG', 'typical', 'entry_price', 'exit_price', 'false')}, 8) AS n_market FROM oc", O.outcomes()))
def costs_models(spark, d):
    t = outcomes.build(B.walk_bars(spark, d), LONG).filter("outcome IS NOT NULL")
    at = (F.col("entry_price"), F.col("exit_price"))
    nets = {f"n_{s}": costs.scenario(s).net_return("LONG", *at, F.col("outcome") == "TP_FIRST") for s in ("optimistic", "typical")}
    nets["n_market"] = costs.market_only("LONG", *at, 0.0010, 0.0001, 0.0002)
    return rounded(t.select("series", "e", *[v.alias(k) for k, v in nets.items()]), *nets)


def _policy(policy: str, price: str):
    sql = O.q(f"SELECT series, e, o AS outcome, round(CASE o WHEN 'TP_FIRST' THEN tp WHEN 'NONE' THEN fin WHEN 'SL_FIRST' THEN stop ELSE {price} END, 8) AS exit_price FROM o2", O.outcomes(tp=0.004, sl=0.004))

    @query(f"outcomes_{policy}", sql)
    def run(spark, d):
        t = outcomes.build(B.walk_bars(spark, d), outcomes.Trade(tp=0.004, sl=0.004, policy=policy)).filter("outcome IS NOT NULL")
        return rounded(t.select("series", "e", "outcome", "exit_price"), "exit_price")


_policy("best", "tp")
_policy("midpoint", "(tp + stop) / 2")


@query("filters_both", O.q(
    "SELECT a.condition_id, a.segment, a.n AS n_entries, concat_ws(';', CASE WHEN a.n < 5 THEN 'n<5' END, CASE WHEN a.p < 0.1 THEN 'P_TP<0.1' END, CASE WHEN a.m <= 0 THEN 'mean_net_return<=0' END, CASE WHEN a.p - b.p < 0 THEN 'lift_P_TP<0' END, CASE WHEN a.m - b.m <= 0 THEN 'lift_mean_net_return<=0' END) AS reject_reasons "
    "FROM (SELECT condition_id, segment, count(*) AS n, avg(CAST(outcome = 'TP_FIRST' AS DOUBLE)) AS p, avg(net_typical) AS m FROM er GROUP BY ALL) a JOIN (SELECT segment, avg(CAST(outcome = 'TP_FIRST' AS DOUBLE)) AS p, avg(net_typical) AS m FROM ar GROUP BY ALL) b USING (segment)", *_entries_sql(O.SEG), Q.ALL))  # fmt: skip
def filters_both(spark, d):
    bars = B.walk_bars(spark, d)
    seg = Q.split(bars)
    table, found = _judged(bars, seg)
    plan = search.Plan(fraction=0.0, least=5, bounds={"mode": "both", "p_tp": 0.1})
    return search.evaluate(found, table, seg, H, plan).filter("n_entries > 0").select("condition_id", "segment", "n_entries", "reject_reasons")


# --- timelines -------------------------------------------------------------------------------------


@query("calendar_segments", O.q("SELECT y.series, s.segment, min(y.t) AS start, max(y.t) + 1 AS \"end\" FROM ty y JOIN (SELECT segment, a.ts AS f, z.ts AS u FROM seg JOIN bars a ON a.t = seg.start LEFT JOIN bars z ON z.t = seg.stop) s ON y.ts >= s.f AND (s.u IS NULL OR y.ts < s.u) GROUP BY y.series, s.segment", O.SEG, "ty AS (SELECT event_type AS series, h AS ts, CAST(row_number() OVER (PARTITION BY event_type ORDER BY h) - 1 AS BIGINT) AS t FROM (SELECT DISTINCT event_type, date_trunc('hour', ts) AS h FROM events))"))
def calendar_segments(spark, d):
    """The split of one series, by its dates, on other series."""
    one = B.walk_bars(spark, d)
    dates = segments.calendar_of(one, Q.split(one))
    return segments.on_calendar(B.type_bars(spark, d), dates).select("series", "segment", "start", "end")


@query("fold_of_bars", O.q("SELECT b.t, CAST(coalesce(max(fold), -1) AS INTEGER) AS fold FROM bars b LEFT JOIN fd ON b.t >= dev - (6 - fold) * val AND b.t < dev - (5 - fold) * val GROUP BY b.t", Q._FOLD))
def fold_of_bars(spark, d):
    bars = B.walk_bars(spark, d)
    return segments.fold_of_bars(bars.select("t"), _folds(bars))


@query("segments_by_series", O.q("SELECT series, CASE WHEN t < round_even(n * 0.3, 0) THEN 'TRAIN' WHEN t < round_even(n * 0.65, 0) THEN 'VALIDATION' ELSE 'TEST' END AS segment, count(*) AS n_bars FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM bars) GROUP BY ALL", base=O.TYPE))
def segments_by_series(spark, d):
    bars = B.type_bars(spark, d)
    return segments.assign(bars, segments.per_series(bars, segments.chronological_split)).groupBy("series", "segment").agg(F.count("*").alias("n_bars"))


_FAULTS = "fx AS (SELECT series, ts FROM bars WHERE hour(ts) % 5 <> 0 UNION ALL SELECT series, ts FROM bars WHERE hour(ts) = 7 UNION ALL SELECT series, ts + INTERVAL 30 MINUTE FROM bars WHERE hour(ts) = 8 AND t < 600 UNION ALL SELECT series, NULL FROM bars WHERE hour(ts) = 9), ex AS (SELECT series, min(ts) AS a, max(ts) AS b FROM fx GROUP BY series), gr AS (SELECT series, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM ex)"


@query("completeness_faults", O.q(
    "SELECT f.series, count(*) FILTER (f.ts IS NULL) AS nat_rows, (SELECT count(*) FROM gr WHERE gr.series = f.series AND gr.ts NOT IN (SELECT ts FROM fx x WHERE x.series = f.series AND ts IS NOT NULL)) AS n_missing, "
    "(SELECT count(DISTINCT x.ts) FROM fx x WHERE x.series = f.series AND x.ts IS NOT NULL AND x.ts NOT IN (SELECT ts FROM gr WHERE gr.series = f.series)) AS n_unexpected, "
    "(SELECT count(*) FROM (SELECT ts FROM fx x WHERE x.series = f.series AND ts IS NOT NULL GROUP BY ts HAVING count(*) > 1)) AS n_duplicated, false AS is_complete FROM fx f GROUP BY f.series", _FAULTS))  # fmt: skip
def completeness_faults(spark, d):
    """Bars with holes, repeated and shifted times, and times that are none."""
    b = B.walk_bars(spark, d)
    hour = F.hour("ts")
    parts = [b.filter(hour % 5 != 0).select("series", "ts"), b.filter(hour == 7).select("series", "ts"), b.filter((hour == 8) & (F.col("t") < 600)).select("series", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("ts")), b.filter(hour == 9).select("series", F.lit(None).cast("timestamp_ntz").alias("ts"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return quality.completeness(rows, quality.hour_grid(rows))["summary"]


@query("covered_bars", O.q("SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM bars) INTERSECT SELECT ts FROM bars WHERE volume > 1 EXCEPT SELECT ts FROM bars WHERE hour(ts) = 3", base=O.TYPE))
def covered_bars(spark, d):
    """Times that every series covers, that one has trades at, without an hour: intersect and except."""
    b = B.type_bars(spark, d)
    n = b.select("series").distinct().count()
    common = wf.covered_by_all(b.select(F.col("series").alias("variant"), F.col("ts").alias("t"), F.lit(True).alias("covered")), n).select(F.col("t").alias("ts"))
    return common.intersect(b.filter("volume > 1").select("ts")).exceptAll(b.filter(F.hour("ts") == 3).select("ts").distinct())


@query("hour_grid", O.q("SELECT b.ts, round(coalesce(k.close, 0), 8) AS x, k4.b IS NOT NULL AS covered FROM bars b LEFT JOIN bk k ON k.b = b.ts AND k.n = 4 LEFT JOIN bk k4 ON k4.n = 4 AND k4.b = time_bucket(INTERVAL 4 HOUR, b.ts, TIMESTAMP '1970-01-01')", Q._buckets(4)))
def hour_grid(spark, d):
    b = B.walk_bars(spark, d)
    four = quality.resample_strict(b, 4 * 3600).select("ts", F.col("close").alias("x"), F.lit(True).alias("covered"))
    return rounded(studies.to_hour_grid(four, b), "x")


@query("median_hold", O.q("SELECT series, outcome, CAST(min(h) AS INTEGER) AS median FROM (SELECT *, sum(n) OVER (PARTITION BY series, outcome ORDER BY h) / sum(n) OVER (PARTITION BY series, outcome) AS s FROM (SELECT series, outcome, exit_offset + 1 AS h, CAST(count(*) AS DOUBLE) AS n FROM oc GROUP BY ALL)) WHERE s >= 0.5 GROUP BY ALL", O.outcomes()))
def median_hold(spark, d):
    t = outcomes.build(B.walk_bars(spark, d), LONG).filter("outcome IS NOT NULL").groupBy("series", "outcome", (F.col("exit_offset") + 1).alias("h")).agg(F.count("*").alias("n"))
    return wf.median_from_histogram(t, "h", "n", ["series", "outcome"])


# --- comparisons -----------------------------------------------------------------------------------


@query("economics", O.q("SELECT count(*) AS trades, round(avg(gross_return), 8) AS gross_per_trade, round(avg(net_typical), 8) AS net_per_trade, round(avg(gross_return) - avg(net_typical), 8) AS cost_per_trade, round(avg(exit_offset + 1), 8) AS mean_duration, round(count(*) FILTER (outcome = 'TP_FIRST') / CAST(nullif(count(*) FILTER (outcome IN ('TP_FIRST', 'SL_FIRST')), 0) AS DOUBLE), 8) AS tp_share_of_resolved, round(count(*) * 1000.0 / (SELECT count(*) FROM bars), 8) AS trades_per_1000_bars FROM oc", O.outcomes()))
def economics(spark, d):
    bars = B.walk_bars(spark, d)
    rows = outcomes.build(bars, LONG).filter("outcome IS NOT NULL").withColumns({"tp_frac": F.lit(LONG.tp), "sl_frac": F.lit(LONG.sl)})
    cols = ["gross_per_trade", "net_per_trade", "cost_per_trade", "mean_duration", "tp_share_of_resolved", "trades_per_1000_bars"]
    return rounded(studies.economics(rows, Q.n_bars(bars), 1, 1).select("trades", *cols), *cols)


@query("rerun_differences", O.q("SELECT c AS \"column\", CASE WHEN c = 'volume' THEN (SELECT count(*) FROM bars WHERE t % 3 = 0) ELSE 0 END AS n_different FROM (SELECT unnest(['open', 'high', 'low', 'close', 'volume']) AS c)", base=O.TYPE))
def rerun_differences(spark, d):
    """A rerun against a saved one: its volumes differ at every third bar."""
    b = B.type_bars(spark, d).drop("ts")
    return studies.differences(b, b.withColumn("volume", F.col("volume") + (F.col("t") % 3 == 0).cast("int")), ["series", "t"])


@query("reality_check_given", O.q(
    "SELECT round(s.stat, 6) AS stat, s.best, round(s.bm, 8) AS best_mean, s.k AS n_live, round((1 + count(*) FILTER (top.x >= s.stat)) / 41.0, 8) AS p_value FROM (SELECT b, max((bm - m) / sd) AS x FROM bt JOIN sd USING (rule) GROUP BY b) top, (SELECT max(m / sd) AS stat, arg_max(rule, m / sd) AS best, arg_max(m, m / sd) AS bm, count(*) AS k FROM mn JOIN sd USING (rule)) s GROUP BY ALL",
    f"x0 AS (SELECT series AS rule, ts, close / lag(close) {O.W} - 1 AS x FROM bars)", "x AS (SELECT rule, x, dense_rank() OVER (ORDER BY ts) - 1 AS i FROM x0 WHERE x IS NOT NULL)",
    "wt AS (SELECT b, i, ((i * 7 + b * 13) % 5) / CAST(1000 AS DOUBLE) AS w FROM (SELECT DISTINCT i FROM x), (SELECT unnest(generate_series(0, 39)) AS b))", "mn AS (SELECT rule, avg(x) AS m FROM x GROUP BY rule)",
    "bt AS (SELECT wt.b, x.rule, sum(w * x) AS bm, any_value(m) AS m FROM x JOIN wt USING (i) JOIN mn USING (rule) GROUP BY wt.b, x.rule)", "sd AS (SELECT rule, stddev_samp(bm - m) AS sd FROM bt GROUP BY rule HAVING stddev_samp(bm - m) > 1e-15)", base=O.TYPE))
def reality_check_given(spark, d):
    """The check with given visits of each time, so that SQL can say the same."""
    x = B.type_bars(spark, d).select("ts", F.col("series").alias("rule"), I.returns(1).alias("x")).filter("x IS NOT NULL").withColumnRenamed("ts", "t")
    times = x.select("t").distinct().count()
    w = spark.range(times).select(F.col("id").alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("b"))
    w = w.withColumn("w", ((F.col("_i") * 7 + F.col("b") * 13) % 5) / F.lit(1000.0))
    out = inference.reality_check(x, 40, weights=w)
    return out.select(F.round("stat", 6).alias("stat"), "best", F.round("best_mean", 8).alias("best_mean"), "n_live", F.round("p_value", 8).alias("p_value"))


_SIDE = f"CAST({exposure.side_cost('conservative')!r} AS DOUBLE)"


@query("exposure_scenarios", O.q(f"SELECT series, round(sum(sw) * {_SIDE}, 8) AS cost_sum_conservative, round(sum(pos * r) - sum(sw) * {_SIDE}, 8) AS rule_net_sum_conservative FROM x5 GROUP BY series", *Q._POS, base=O.TYPE))
def exposure_scenarios(spark, d):
    cols = ["cost_sum_conservative", "rule_net_sum_conservative"]
    return rounded(exposure.scenario_sums(Q._rule(B.type_bars(spark, d)), 100).select("series", *cols), *cols)


@query("exposure_rules")
def exposure_rules(spark, d):
    """The criteria of the calm-market rule; recursive operands and a robust t, so without SQL."""
    rule = exposure.RULES[2]
    return exposure.criteria(rule.positions(B.type_bars(spark, d)), 100, 2.0)


# --- audits: no failure but where a leak was put in ------------------------------------------------


def _none(columns: str) -> str:
    return f"SELECT m AS mode, CAST(k AS INTEGER) AS k, c AS \"column\", CAST(0 AS BIGINT) AS failures FROM (SELECT unnest(['truncate', 'perturb']) AS m), (SELECT unnest([200, 400]) AS k), (SELECT unnest([{columns}]) AS c)"


@query("audit_conditions", _none("'cross', 'below'"))
def audit_conditions(spark, d):
    return audit.check_conditions(B.walk_bars(spark, d), featured, {k: t for k, (t, _) in GIVEN.items()}, [200, 400])


@query("audit_entries", _none("'entry'"))
def audit_entries(spark, d):
    """Entries until exit, as far back from the cut as an outcome reaches."""
    whole = segments.frame(spark, [(0, "ALL", 0, 10**9)])

    def accepted(b):
        return search.entry_rows(search.entries(featured(b), outcomes.build(b, LONG), TREES, whole, H), outcomes.build(b, LONG)).select("series", "t")

    return audit.check_entries(B.walk_bars(spark, d), accepted, [200, 400], 2 * H)


@query("audit_exit_levels", _none("'tp', 'sl'"))
def audit_exit_levels(spark, d):
    trade = outcomes.Trade(tp=2.0, sl=1.0, atr="atr_14")
    # the entry's open is known at its bar, the ATR at the one before
    return audit.check_exit_levels(B.walk_bars(spark, d), lambda b: outcomes.levels(I.with_recursive(b, ("atr", 14)), trade), [200, 400])


@query("audit_resample", _none("'open', 'high', 'low', 'close'"))
def audit_resample(spark, d):
    return audit.check_resample(B.walk_bars(spark, d), lambda b: quality.resample_strict(b, 4 * 3600), 4 * 3600, [200, 400])


@query("startup_sensitivity", "SELECT CAST(s AS INTEGER) AS start, c AS \"column\", CAST(0 AS BIGINT) AS failures FROM (SELECT unnest([50, 100]) AS s), (SELECT unnest(['sma_20', 'return_3']) AS c)")
def startup_sensitivity(spark, d):
    ops = [P.operand("sma", 20), P.operand("return", 3)]
    return audit.startup_sensitivity(B.walk_bars(spark, d), lambda b: P.materialise(b, ops), [x.name for x in ops], [50, 100], 20)
