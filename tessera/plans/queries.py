"""Registered queries of the research engine, each with its DuckDB form where SQL can express it."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.functions import indicators as I
from tessera.operators import audit, entries, exposure, inference, outcomes, quality, search, segments, stats
from tessera.operators.conditions import And, Compare, ContextTrigger, Cross, Not, Or, Then, Within, condition_id, evaluate
from tessera.sources import bars as B

from . import oracles as O

H = O.HORIZON
LONG, SHORT = outcomes.Trade(), outcomes.Trade(side="SHORT")
#: The trees of the condition queries over a = SMA(10) and b = SMA(30), and the SQL of their signals.
STATE_, CROSS_, BELOW_ = Compare("close", ">", "a"), Cross("a", "b"), Cross("a", "b", above=False)
TREES = {
    "cond_compare": (STATE_, "v1 AND d1"), "cond_cross": (CROSS_, "v2 AND d2"), "cond_cross_below": (BELOW_, "v3 AND d2"),
    "cond_and_or_not": (And(Or(STATE_, CROSS_), Not(Compare("close", "<", "b"))), "(v1 OR v2) AND d1 AND d2 AND NOT v4 AND d4"),
    "cond_within": (Within(CROSS_, 6), f"coalesce(bool_or(v2 AND d2) {O.frame('6 PRECEDING', '1 PRECEDING')}, false) AND coalesce(lag(d2) {O.W}, false)"),
    "cond_then": (Then(CROSS_, BELOW_, 40), f"v3 AND d2 AND coalesce(bool_or(v2 AND d2) {O.frame('40 PRECEDING', '1 PRECEDING')}, false) AND coalesce(lag(d2) {O.W}, false)"),
    "cond_context_trigger": (ContextTrigger(STATE_, CROSS_), "v1 AND d1 AND v2 AND d2"),
    "signal_warmup_not": (Not(Compare("b", ">", "close")), "d4 AND NOT coalesce(b > close, false)"),
}

_QUERIES, _SQL = {}, {}


def query(name, sql=None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries():
    from . import research  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql():
    queries()
    return dict(_SQL)


def rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 8) for c in cols})


def featured(bars):
    return bars.withColumns({"a": I.sma(10), "b": I.sma(30)})


def n_bars(bars) -> int:
    return bars.count()


def split(bars):
    return segments.frame(bars.sparkSession, segments.chronological_split(n_bars(bars)))


def taken(bars, mode="until_exit", trade=LONG, names=("cross",), trees=None, seg=None):
    """Candidates, outcomes and accepted entries of the crossing."""
    signals = evaluate(featured(bars), trees or {"cross": CROSS_})
    table = outcomes.build(bars, trade)
    found = entries.candidates(entries.long_signals(signals, list(names)), split(bars) if seg is None else seg, trade.horizon)
    return found, table, entries.select(found, table if mode == "until_exit" else None, cooldown=15)


# --- sources and quality ---------------------------------------------------------------------------

BAR_COLS = "series, ts, t, open, high, low, close, volume"
query("bars_hourly", O.q(f"SELECT {BAR_COLS} FROM bars"))(B.walk_bars)
query("bars_by_type", O.q(f"SELECT {BAR_COLS} FROM bars", base=O.TYPE))(B.type_bars)
query("bars_daily", O.q(f"SELECT {BAR_COLS} FROM bars", base=O.DAILY))(B.daily_bars)


def _order_rows(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    p = F.col("o_totalprice").cast("double")
    low = F.when(F.col("o_orderkey") % 7 == 0, p + 1).otherwise(p - 1)  # every seventh is incoherent
    return o.select(F.lit("o").alias("series"), F.col("o_orderdate").alias("ts"), "o_orderkey", p.alias("Open"), (p + 2).alias("High"), low.alias("Low"), p.alias("Close"))


_ORDERS = "r AS (SELECT 'o' AS series, o_orderdate AS ts, o_orderkey, CAST(o_totalprice AS DOUBLE) AS p FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY o_orderkey DESC) AS k FROM r)"


@query("normalize", f"WITH {_ORDERS} SELECT series, ts, p AS open, p + 2 AS high, p - 1 AS low, p AS close FROM l WHERE k = 1 AND o_orderkey % 7 <> 0")
def normalize(spark, d):
    return quality.normalize_ohlc(_order_rows(spark, d), "o_orderkey")


def _halves(spark, d):
    b = B.walk_bars(spark, d).select("series", "ts", "open", "close")
    return b.filter(F.hour("ts") % 3 != 0), b.filter(F.hour("ts") % 2 == 0).withColumn("close", F.col("close") + 1)


@query("merge_old_new", O.q("SELECT series, ts, open, close + CASE WHEN hour(ts) % 3 <> 0 THEN 0 ELSE 1 END AS close FROM bars WHERE hour(ts) % 3 <> 0 OR hour(ts) % 2 = 0"))
def merge_old_new(spark, d):
    return quality.merge_datasets(*_halves(spark, d), prefer="old")


_MISS = "old AS (SELECT * FROM bars WHERE hour(ts) % 3 <> 0), miss AS (SELECT 'all' AS series, unnest(generate_series((SELECT min(ts) FROM old), (SELECT max(ts) FROM old), INTERVAL 1 HOUR)) AS ts), gone AS (SELECT * FROM miss WHERE ts NOT IN (SELECT ts FROM old)), new AS (SELECT ts FROM bars WHERE hour(ts) % 2 = 0)"


@query("recovered", O.q("SELECT series, ts, ts IN (SELECT ts FROM new) AS recovered FROM gone", _MISS))
def recovered(spark, d):
    old, new = _halves(spark, d)
    yes, no = quality.recovered(quality.missing_bars(old), new)
    return yes.withColumn("recovered", F.lit(True)).unionByName(no.withColumn("recovered", F.lit(False)))


@query("completeness_hourly", O.q("SELECT series, ts FROM gone", _MISS))
def completeness_hourly(spark, d):
    return quality.missing_bars(_halves(spark, d)[0])


@query("completeness_session", O.q("SELECT 'all' AS series, CAST(day AS DATE) AS day FROM (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM k), (SELECT max(CAST(ts AS DATE)) FROM k), INTERVAL 1 DAY)) AS day) WHERE dayofweek(day) BETWEEN 1 AND 5 AND CAST(day AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM k)", "k AS (SELECT * FROM bars WHERE day(ts) % 4 <> 0)"))
def completeness_session(spark, d):
    return quality.session_missing(B.walk_bars(spark, d).filter(F.day("ts") % 4 != 0))


@query("duplicated_ticks", "SELECT o_custkey AS series, o_orderdate AS ts, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicated_ticks(spark, d):
    return quality.duplicated(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("ts")))


_GAP = "g AS (SELECT series, ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY series ORDER BY ts) AS gap FROM bars)"


@query("gap_report", O.q("SELECT series, count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (gap > 3600) AS n_gaps, CAST(coalesce(max(gap) FILTER (gap > 3600), 0) AS BIGINT) AS max_gap_seconds FROM g GROUP BY series", _GAP, base=O.TYPE))
def gap_report(spark, d):
    return quality.gap_report(B.type_bars(spark, d))


def _buckets(n):
    return f"bk AS (SELECT series, time_bucket(INTERVAL {n} HOUR, ts, TIMESTAMP '1970-01-01') AS b, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, count(*) AS n FROM bars GROUP BY ALL)"


@query("resample_4h_strict", O.q("SELECT series, b AS ts, open, high, low, close, volume FROM bk WHERE n = 4", _buckets(4), base=O.TYPE))
def resample_4h_strict(spark, d):
    return quality.resample_strict(B.type_bars(spark, d), 4 * 3600)


@query("resample_loose", O.q("SELECT series, b AS ts, open, high, low, close, volume, n FROM bk", _buckets(4), base=O.TYPE))
def resample_loose(spark, d):
    return quality.resample_loose(B.type_bars(spark, d), 4 * 3600)


@query("resample_report", O.q("""SELECT series, CAST(sum(n) AS BIGINT) AS n_source, CAST(0 AS BIGINT) AS n_misaligned, x AS blocks_expected, count(*) FILTER (n = 4) AS blocks_complete, count(*) FILTER (n < 4) AS blocks_incomplete, x - count(*) AS blocks_without_data,
CAST(coalesce(sum(n) FILTER (n = 4), 0) AS BIGINT) AS rows_used, count(*) FILTER (hole) AS n_time_holes, round(100.0 * (x - count(*) FILTER (n = 4)) / x, 8) AS pct_discarded
FROM (SELECT *, b - lag(b) OVER (PARTITION BY series ORDER BY b) > INTERVAL 4 HOUR AS hole, CAST((epoch(max(b) OVER (PARTITION BY series)) - epoch(min(b) OVER (PARTITION BY series))) / 14400 + 1 AS BIGINT) AS x FROM bk) GROUP BY series, x""", _buckets(4), base=O.TYPE))
def resample_report(spark, d):
    return quality.resample_report(B.type_bars(spark, d), 4 * 3600)


# --- operands --------------------------------------------------------------------------------------


@query("candle_features", O.q(f"SELECT series, t, {', '.join(f'round({x}, 8) AS {n}' for n, x in (('body', 'abs(close - open)'), ('rng', 'high - low'), ('upper_wick', 'high - greatest(open, close)'), ('lower_wick', 'least(open, close) - low'), ('body_ratio', 'abs(close - open) / nullif(high - low, 0)')))} FROM bars", base=O.TYPE))
def candle_features(spark, d):
    out = B.type_bars(spark, d).select("series", "t", I.candle("body").alias("body"), I.candle("range").alias("rng"), I.candle("upper_wick").alias("upper_wick"), I.candle("lower_wick").alias("lower_wick"), I.candle("body_ratio").alias("body_ratio"))
    return rounded(out, "body", "rng", "upper_wick", "lower_wick", "body_ratio")


@query("returns_n", O.q(f"SELECT series, t, round(close / lag(close, 5) {O.W} - 1, 8) AS ret_5 FROM bars", base=O.TYPE))
def returns_n(spark, d):
    return rounded(B.type_bars(spark, d).select("series", "t", I.returns(5).alias("ret_5")), "ret_5")


@query("sma", O.q(f"SELECT series, t, round({O.sma(20)}, 8) AS sma_20 FROM bars", base=O.TYPE))
def sma(spark, d):
    return rounded(B.type_bars(spark, d).select("series", "t", I.sma(20).alias("sma_20")), "sma_20")


@query("return_quantiles", O.q("SELECT series, round(quantile_cont(x, 0.5), 8) AS q50, round(quantile_cont(x, 0.9), 8) AS q90, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS sd FROM r GROUP BY series", f"r AS (SELECT series, abs(close / lag(close) {O.W} - 1) AS x FROM bars)", base=O.TYPE))
def return_quantiles(spark, d):
    x = B.type_bars(spark, d).select("series", F.abs(I.returns(1)).alias("x")).groupBy("series")
    return rounded(x.agg(F.percentile("x", F.lit(0.5)).alias("q50"), F.percentile("x", F.lit(0.9)).alias("q90"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")), "q50", "q90", "mean", "sd")


def _recursive(name, specs, cols, sql, select=None):
    @query(name, sql)
    def run(spark, d):
        df = I.with_recursive(B.walk_bars(spark, d), *specs)
        df = select(df) if select else df
        return rounded(df.select("series", "t", *cols), *cols)


_recursive("ema", [("ema", 20)], ["ema_20"], O.q("SELECT series, t, round(y, 8) AS ema_20 FROM m", O.scan("m", "bars", "close", 2 / 21, 20)))
_recursive("atr", [("atr", 14)], ["atr_14"], O.q("SELECT series, t, round(y, 8) AS atr_14 FROM atr", O.atr(14)))
_recursive("atr_pct", [("atr", 14)], ["atr_pct"], O.q("SELECT series, t, round(y / close, 8) AS atr_pct FROM atr JOIN bars USING (series, t)", O.atr(14)), lambda df: df.withColumn("atr_pct", F.col("atr_14") / F.col("close")))
_recursive("relvol", [("atr", 14), ("atr", 50)], ["relvol"], O.q("SELECT s.series, s.t, round(s.y / l.y, 8) AS relvol FROM s JOIN l USING (series, t)", O.atr(14, "s"), O.scan("l", "tr", "x", 1 / 50, 50)), lambda df: df.withColumn("relvol", F.try_divide("atr_14", "atr_50")))
_recursive("rsi", [("rsi", 14)], ["rsi_14"], O.q("SELECT b.series, b.t, round(CASE WHEN l.y = 0 AND g.y = 0 THEN 50 WHEN l.y = 0 THEN 100 ELSE 100 - 100 / (1 + g.y / l.y) END, 8) AS rsi_14 FROM bars b LEFT JOIN g USING (series, t) LEFT JOIN l USING (series, t)",
           f"dl AS (SELECT series, t, greatest(close - lag(close) {O.W}, 0) AS up, greatest(lag(close) {O.W} - close, 0) AS dn FROM bars)", O.scan("g", "dl", "up", 1 / 14, 14, 1), O.scan("l", "dl", "dn", 1 / 14, 14, 1)))
_recursive("macd", [("macd", 12, 26, 9)], ["macd_12_26_9_line", "macd_12_26_9_signal", "macd_12_26_9_hist"], O.q(
    "SELECT ln.series, ln.t, round(ln.y, 8) AS macd_12_26_9_line, round(sg.y, 8) AS macd_12_26_9_signal, round(ln.y - sg.y, 8) AS macd_12_26_9_hist FROM ln LEFT JOIN sg USING (series, t)",
    O.scan("fa", "bars", "close", 2 / 13, 12), O.scan("sl", "bars", "close", 2 / 27, 26), "ln AS (SELECT series, t, fa.y - sl.y AS y FROM fa JOIN sl USING (series, t))", O.scan("sg", "ln", "y", 2 / 10, 9, 25)))


def _htf_sql(hours, n):
    return O.q(
        f"SELECT m.series, m.t, round(h.trend, 8) AS trend FROM m LEFT JOIN h ON h.series = m.series AND h.k = CASE WHEN (epoch(m.ts) + 3600) % {hours * 3600} = 0 THEN m.k ELSE m.k - 1 END",
        f"m AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '1970-01-01')) AS k FROM bars)",
        "cd AS (SELECT series, k, last(close ORDER BY t) AS c FROM m GROUP BY ALL)",
        f"h AS (SELECT series, k, CASE WHEN count(c) OVER z >= {n} THEN c / avg(c) OVER z - 1 END AS trend FROM cd WINDOW z AS (PARTITION BY series ORDER BY k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))", base=O.TYPE,
    )


@query("htf_trend_4h", _htf_sql(4, 3))
def htf_trend_4h(spark, d):
    return rounded(I.with_htf_trend(B.type_bars(spark, d), 4 * 3600, 3, 3600, "trend").select("series", "t", "trend"), "trend")


@query("htf_trend_1d", _htf_sql(24, 5))
def htf_trend_1d(spark, d):
    return rounded(I.with_htf_trend(B.type_bars(spark, d), 24 * 3600, 5, 3600, "trend").select("series", "t", "trend"), "trend")


# --- conditions ------------------------------------------------------------------------------------


def _condition(name, tree, sql):
    @query(name, O.q(f"SELECT series, t, {sql} AS signal FROM c", *O.SIGNALS, base=O.TYPE))
    def run(spark, d):
        return evaluate(featured(B.type_bars(spark, d)), {"signal": tree}).select("series", "t", "signal")


for _name, (_tree, _sql) in TREES.items():
    _condition(_name, _tree, _sql)

# --- outcomes --------------------------------------------------------------------------------------

OUT = ["exit_price", "gross_return", "net_optimistic", "net_typical", "mfe", "mae"]
OUT_SQL = f"SELECT series, e, outcome, exit_offset, {O.rounded(*OUT)} FROM oc"


def _shown(table):
    return rounded(table.filter("outcome IS NOT NULL").select("series", "e", "outcome", "exit_offset", *OUT), *OUT)


def _outcome(name, trade, sql, prepare=lambda b: b):
    @query(name, sql)
    def run(spark, d):
        return _shown(outcomes.build(prepare(B.walk_bars(spark, d)), trade))


_outcome("outcomes_long", LONG, O.q(OUT_SQL, O.outcomes()))
_outcome("outcomes_short", SHORT, O.q(OUT_SQL, O.outcomes("SHORT")))
_outcome("outcomes_ambiguous", outcomes.Trade(tp=0.004, sl=0.004), O.q(OUT_SQL, O.outcomes(tp=0.004, sl=0.004)))
_outcome("outcomes_atr", outcomes.Trade(tp=2.0, sl=1.0, atr="atr_14"), O.q(OUT_SQL, O.atr(14), f"lv AS (SELECT * FROM (SELECT b.series, b.t, b.open, lag(atr.y) OVER (PARTITION BY b.series ORDER BY b.t) AS a FROM bars b JOIN atr USING (series, t)) WHERE a IS NOT NULL AND open - a > 0)", O.outcomes(levels=("open + 2 * a", "open - 1 * a"))), lambda b: I.with_recursive(b, ("atr", 14)))


@query("mfe_mae", O.q(f"SELECT series, t, round(max(high) {O.frame('CURRENT ROW', '11 FOLLOWING')} / open - 1, 8) AS mfe, round(min(low) {O.frame('CURRENT ROW', '11 FOLLOWING')} / open - 1, 8) AS mae FROM bars", base=O.TYPE))
def mfe_mae(spark, d):
    w = I.W().rowsBetween(0, 11)
    return rounded(B.type_bars(spark, d).select("series", "t", (F.max("high").over(w) / F.col("open") - 1).alias("mfe"), (F.min("low").over(w) / F.col("open") - 1).alias("mae")), "mfe", "mae")


@query("favorable_reach", O.q(f"SELECT series, t, max(high) {O.frame('CURRENT ROW', '9 FOLLOWING')} >= open * CAST(1.02 AS DOUBLE) AS long_hit, min(low) {O.frame('CURRENT ROW', '9 FOLLOWING')} <= open * CAST(0.98 AS DOUBLE) AS short_hit FROM bars", base=O.TYPE))
def favorable_reach(spark, d):
    return B.type_bars(spark, d).select("series", "t", outcomes.reach("LONG", 0.02, 10).alias("long_hit"), outcomes.reach("SHORT", 0.02, 10).alias("short_hit"))


@query("favorable_at_horizon", O.q(f"SELECT series, t, lead(close, 9) {O.W} / open - 1 >= CAST(0.01 AS DOUBLE) AS hit FROM bars", base=O.TYPE))
def favorable_at_horizon(spark, d):
    return B.type_bars(spark, d).select("series", "t", outcomes.at_horizon("LONG", 0.01, 10).alias("hit"))


@query("favorable_sequence", O.q("SELECT a.series, a.t, coalesce(bool_or(f.high >= a.open * CAST(1.01 AS DOUBLE) AND f.t > k.t1), false) AS hit FROM bars a LEFT JOIN k ON k.series = a.series AND k.t = a.t LEFT JOIN bars f ON f.series = a.series AND f.t BETWEEN a.t AND a.t + 11 GROUP BY ALL", "k AS (SELECT a.series, a.t, min(f.t) AS t1 FROM bars a JOIN bars f ON f.series = a.series AND f.t BETWEEN a.t AND a.t + 11 AND f.low <= a.open * CAST(0.995 AS DOUBLE) GROUP BY ALL)"))
def favorable_sequence(spark, d):
    df = outcomes.with_window(B.walk_bars(spark, d), 12)
    return df.select("series", "t", outcomes.sequence("LONG", 0.005, 0.01, 12).alias("hit"))


@query("costs_scenarios", O.q("SELECT series, e, " + ", ".join(f"round({O.net('LONG', s, 'entry_price', 'exit_price', chr(111) + 'utcome = ' + repr('TP_FIRST'))}, 8) AS n_{s}" for s in ("optimistic", "typical")) + " FROM oc", O.outcomes()))
def costs_scenarios(spark, d):
    t = outcomes.build(B.walk_bars(spark, d), LONG).filter("outcome IS NOT NULL")
    return t.select("series", "e", *[F.round(outcomes.net_return("LONG", s, F.col("entry_price"), F.col("exit_price"), F.col("outcome") == "TP_FIRST"), 8).alias(f"n_{s}") for s in ("optimistic", "typical")])


# --- entries and statistics ------------------------------------------------------------------------

RUN = [*O.SIGNALS, O.outcomes(), O.SEG]
ROWS = "er AS (SELECT ent.series, ent.segment, ent.t, oc.* EXCLUDE (series) FROM ent JOIN oc ON oc.series = ent.series AND oc.e = ent.t + 1)"
ALL = "ar AS (SELECT oc.series, s.segment, oc.* EXCLUDE (series) FROM oc JOIN seg s ON oc.e - 1 >= s.start AND oc.e - 1 < s.stop AND oc.e - 1 <= s.stop - 1 - %d)" % H


@query("entries_until_exit", O.q("SELECT series, segment, t, t + 1 AS e FROM ent", *RUN, O.entries()))
def entries_until_exit(spark, d):
    return taken(B.walk_bars(spark, d))[2].select("series", "segment", "t", "e")


@query("entries_fixed", O.q("SELECT series, segment, t, t + 1 AS e FROM ent", *RUN, O.entries("fixed")))
def entries_fixed(spark, d):
    return taken(B.walk_bars(spark, d), "fixed")[2].select("series", "segment", "t", "e")


@query("purge_counts", O.q("SELECT r.series, r.segment, count(*) AS n_raw_signals, count(*) FILTER (NOT fits) AS n_dropped_horizon, x AS n_entries, count(*) FILTER (fits) - x AS n_dropped_cooldown FROM raw r JOIN (SELECT s.segment, count(ent.t) AS x FROM seg s LEFT JOIN ent USING (segment) GROUP BY s.segment) USING (segment) GROUP BY r.series, r.segment, x", *RUN, O.entries()))
def purge_counts(spark, d):
    found, _, got = taken(B.walk_bars(spark, d))
    return entries.counters(found, got).select("series", "segment", "n_raw_signals", "n_dropped_horizon", "n_entries", "n_dropped_cooldown")


def entry_rows(bars, **more):
    _, table, got = taken(bars, **more)
    return got.join(table.drop("t"), ["series", "e"])


def all_rows(bars):
    """An entry at every bar of a segment that its horizon fits in."""
    table = outcomes.build(bars, LONG).filter("outcome IS NOT NULL").withColumn("t", F.col("e") - 1)
    return segments.assign(table, split(bars)).filter(F.col("t") <= F.col("end") - 1 - H)


SHOW = ["P_TP_FIRST", "P_TP_FIRST_ci95_low", "P_TP_FIRST_ci95_high", "mean_gross_return", "median_gross_return", "mean_net_return", "median_net_return", "std_net_return", "t_mean_net_return", "win_rate_net", "mean_holding_bars", "mean_MFE", "mean_MAE", "MFE_q0.9", "P_MFE_ge_0.01"]


def stats_sql(src):
    z = repr(stats.Z95)
    p, n = "(count(*) FILTER (outcome = 'TP_FIRST') / CAST(count(*) AS DOUBLE))", "CAST(count(*) AS DOUBLE)"
    wil = lambda s: f"({p} + {z} * {z} / (2 * {n}) {s} {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}))) / (1 + {z} * {z} / {n})"
    cols = {
        "P_TP_FIRST": p, "P_TP_FIRST_ci95_low": f"greatest(0, {wil('-')})", "P_TP_FIRST_ci95_high": f"least(1, {wil('+')})", "mean_gross_return": "avg(gross_return)", "median_gross_return": "median(gross_return)",
        "mean_net_return": "avg(net_typical)", "median_net_return": "median(net_typical)", "std_net_return": "stddev_samp(net_typical)", "t_mean_net_return": "avg(net_typical) / nullif(stddev_samp(net_typical) / sqrt(count(*)), 0)",
        "win_rate_net": "avg(CAST(net_typical > 0 AS DOUBLE))", "mean_holding_bars": "avg(exit_offset + 1)", "mean_MFE": "avg(mfe)", "mean_MAE": "avg(mae)", "MFE_q0.9": "quantile_cont(mfe, 0.9)", "P_MFE_ge_0.01": "avg(CAST(mfe >= CAST(0.01 AS DOUBLE) AS DOUBLE))",
    }
    return "SELECT series, segment, count(*) AS n_entries, " + ", ".join(f'round({x}, 8) AS "{c}"' for c, x in cols.items()) + f" FROM {src} GROUP BY series, segment"


def shown_stats(df):
    return df.select("series", "segment", "n_entries", *[F.round(F.col(f"`{c}`"), 8).alias(c) for c in SHOW])


@query("stats_condition", O.q(stats_sql("er"), *RUN, O.entries(), ROWS))
def stats_condition(spark, d):
    return shown_stats(stats.compute(entry_rows(B.walk_bars(spark, d)), ["series", "segment"]))


@query("baseline", O.q(stats_sql("ar"), *RUN, ALL))
def baseline(spark, d):
    return shown_stats(stats.compute(all_rows(B.walk_bars(spark, d)), ["series", "segment"]))


def lifted(bars, keys=("series", "segment"), **more):
    own = stats.compute(entry_rows(bars, **more), [*keys, "condition_id"])
    return stats.add_lift(own, stats.compute(all_rows(bars), list(keys)), list(keys))


def flagship(spark, d):
    """The crossing's statistics in each segment, with the lift over entering at every bar."""
    return lift(spark, d)


_LIFT = O.q(
    "SELECT series, segment, n_entries, round(a.p - b.p, 8) AS \"lift_P_TP_FIRST\", round(a.g - b.g, 8) AS lift_mean_gross_return, round(a.m - b.m, 8) AS lift_mean_net_return FROM a JOIN b USING (series, segment)", *RUN, O.entries(), ROWS, ALL,
    *(f"{x} AS (SELECT series, segment, count(*) AS n_entries_{x}, {'count(*) AS n_entries,' if x == 'a' else ''} avg(CAST(outcome = 'TP_FIRST' AS INTEGER)) AS p, avg(gross_return) AS g, avg(net_typical) AS m FROM {s} GROUP BY ALL)" for x, s in (("a", "er"), ("b", "ar"))),
)


@query("lift", _LIFT)
def lift(spark, d):
    cols = ["lift_P_TP_FIRST", "lift_mean_gross_return", "lift_mean_net_return"]
    return rounded(lifted(B.walk_bars(spark, d)).select("series", "segment", "n_entries", *cols), *cols)


@query("filters", _LIFT.replace("SELECT series, segment, n_entries, round(a.p - b.p, 8)", "SELECT series, segment, n_entries, concat_ws(';', CASE WHEN n_entries < 5 THEN 'n<5' END, CASE WHEN a.p - b.p < 0 THEN 'lift_P_TP<0' END, CASE WHEN a.m - b.m <= 0 THEN 'lift_mean_net_return<=0' END) AS reject_reasons, n_entries >= 5 AND a.p >= b.p AND a.m > b.m AS passed, round(a.p - b.p, 8)"))
def filters(spark, d):
    out = stats.filters(lifted(B.walk_bars(spark, d)), F.lit(5), mode="lift")
    cols = ["lift_P_TP_FIRST", "lift_mean_gross_return", "lift_mean_net_return"]
    return rounded(out.select("series", "segment", "n_entries", "reject_reasons", "passed", *cols), *cols)


@query("pool_topk")
def pool_topk(spark, d):
    """A top-k report: the limit is the feature."""
    names = [n for n in TREES if n != "signal_warmup_not"]
    own = lifted(B.walk_bars(spark, d), names=names, trees={n: TREES[n][0] for n in names}).filter("segment = 'TRAIN'")
    return stats.pool(own, 1, 3).select("condition_id", "n_entries", "lift_P_TP_FIRST", "lift_mean_gross_return")


@query("events", O.q(f"SELECT er.series, segment, er.t, b.ts AS confirm_ts, er.e, outcome, exit_offset, {O.rounded('exit_price', 'net_typical')} FROM er JOIN bars b ON b.series = er.series AND b.t = er.t", *RUN, O.entries(), ROWS))
def events(spark, d):
    bars = B.walk_bars(spark, d)
    out = entry_rows(bars).join(bars.select("series", "t", F.col("ts").alias("confirm_ts")), ["series", "t"])
    return rounded(out.select("series", "segment", "t", "confirm_ts", "e", "outcome", "exit_offset", "exit_price", "net_typical"), "exit_price", "net_typical")


@query("oos_series", O.q("SELECT series, e, count(*) AS cnt, round(sum(net_typical), 8) AS sum_typical, round(sum(gross_return), 8) AS sum_gross, CAST(sum(exit_offset + 1) AS BIGINT) AS hold_sum FROM er GROUP BY series, e", *RUN, O.entries(), ROWS))
def oos_series(spark, d):
    return rounded(stats.oos_series(entry_rows(B.walk_bars(spark, d))).select("series", "e", "cnt", "sum_typical", "sum_gross", "hold_sum"), "sum_typical", "sum_gross")


@query("exit_breakdown", O.q("SELECT series, outcome, count(*) AS n, round(avg(net_typical), 8) AS mean_net, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY series) AS DOUBLE), 8) AS share, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY series) AS DOUBLE) * avg(net_typical), 8) AS contribution FROM oc GROUP BY series, outcome", O.outcomes()))
def exit_breakdown(spark, d):
    return rounded(stats.exit_table(outcomes.build(B.walk_bars(spark, d), LONG).filter("outcome IS NOT NULL")), "mean_net", "share", "contribution")


@query("hold_hist", O.q("SELECT series, CAST(exit_offset + 1 AS INTEGER) AS bars_held, count(*) AS n FROM oc GROUP BY ALL", O.outcomes()))
def hold_hist(spark, d):
    t = outcomes.build(B.walk_bars(spark, d), LONG).filter("outcome IS NOT NULL")
    return t.groupBy("series", (F.col("exit_offset") + 1).alias("bars_held")).agg(F.count("*").alias("n"))


@query("split_segments", O.q("SELECT segment, start, stop AS \"end\" FROM seg", O.SEG))
def split_segments(spark, d):
    return split(B.walk_bars(spark, d)).select("segment", "start", "end")


_FOLD = "fd AS (SELECT k AS fold, n - CAST(round_even(n * 0.15, 0) AS BIGINT) AS dev, CAST(floor((n - round_even(n * 0.15, 0)) / 9) AS BIGINT) AS val FROM (SELECT count(*) AS n FROM bars), (SELECT unnest(generate_series(0, 5)) AS k))"


@query("wf_folds", O.q("SELECT fold, dev - (6 - fold) * val - 3 * val AS train_start, dev - (6 - fold) * val AS val_start, dev - (5 - fold) * val AS val_end FROM fd", _FOLD))
def wf_folds(spark, d):
    rows = segments.make_folds(n_bars(B.walk_bars(spark, d)), folds=6, horizon=H)
    f = segments.frame(spark, rows).filter("fold >= 0").groupBy("fold")
    at = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c)))
    return f.agg(at("TRAIN", "start").alias("train_start"), at("VALIDATION", "start").alias("val_start"), at("VALIDATION", "end").alias("val_end"))


_WF = [O.outcomes(), _FOLD, "wf AS (SELECT fold, oc.* FROM oc JOIN fd ON e - 1 >= dev - (6 - fold) * val AND e - 1 <= dev - (5 - fold) * val - 1 - %d)" % H]


def _fold_rows(bars):
    seg = segments.frame(bars.sparkSession, [r for r in segments.make_folds(n_bars(bars), folds=6, horizon=H) if r[1] == "VALIDATION"])
    t = outcomes.build(bars, LONG).filter("outcome IS NOT NULL").withColumn("t", F.col("e") - 1)
    return segments.assign(t, seg).filter(F.col("t") <= F.col("end") - 1 - H)


@query("wf_summary", O.q("SELECT fold, count(*) AS n, round(avg(net_typical), 8) AS mean_net, round(avg(CAST(outcome = 'TP_FIRST' AS INTEGER)), 8) AS p_tp FROM wf GROUP BY fold", *_WF))
def wf_summary(spark, d):
    out = _fold_rows(B.walk_bars(spark, d)).groupBy("fold").agg(F.count("*").alias("n"), F.avg("net_typical").alias("mean_net"), F.avg((F.col("outcome") == "TP_FIRST").cast("int")).alias("p_tp"))
    return rounded(out, "mean_net", "p_tp")


_PER = "pf AS (SELECT fold, count(*) AS n, avg(net_typical) AS mean, stddev_samp(net_typical) AS std FROM wf GROUP BY fold)"


def _per_fold(bars):
    return _fold_rows(bars).groupBy("fold").agg(F.count("*").alias("n"), F.avg("net_typical").alias("mean"), F.stddev_samp("net_typical").alias("std"))


@query("wf_fold_t", O.q("SELECT round(avg(mean) / (stddev_samp(mean) / sqrt(count(*))), 8) AS fold_t, round(sum(n * mean) / sum(n), 8) AS pooled_mean FROM pf", *_WF, _PER))
def wf_fold_t(spark, d):
    return rounded(_per_fold(B.walk_bars(spark, d)).agg(stats.fold_t(F.col("mean")).alias("fold_t"), stats.pooled("mean", "n").alias("pooled_mean")), "fold_t", "pooled_mean")


@query("pooled_t", O.q("SELECT count(*) AS n, round(avg(net_typical), 8) AS mean, round(avg(net_typical) / (stddev_samp(net_typical) / sqrt(count(*))), 6) AS t FROM wf", *_WF))
def pooled_t(spark, d):
    return stats.pooled_t(_per_fold(B.walk_bars(spark, d))).select("n", F.round("mean", 8).alias("mean"), F.round("t", 6).alias("t"))


@query("hac_t", O.q("SELECT series, n, round(m, 8) AS mean, round(m / sqrt(o / n), 6) AS hac_t FROM (SELECT a.series, a.n, a.m, sum(CASE WHEN b.k = a.k THEN 1 ELSE 2 * (1 - (b.k - a.k) / 25.0) END * a.u * b.u) / a.n AS o FROM u a JOIN u b ON a.series = b.series AND b.k BETWEEN a.k AND a.k + 24 GROUP BY a.series, a.n, a.m)",
       f"x AS (SELECT series, t, close / lag(close) {O.W} - 1 AS x FROM bars)", "u AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS k, x - avg(x) OVER (PARTITION BY series) AS u, avg(x) OVER (PARTITION BY series) AS m, count(*) OVER (PARTITION BY series) AS n FROM x WHERE x IS NOT NULL)", base=O.TYPE))
def hac_t(spark, d):
    x = B.type_bars(spark, d).select("series", "t", I.returns(1).alias("x")).filter("x IS NOT NULL")
    return inference.newey_west_t(x, 24).select("series", "n", F.round("mean", 8).alias("mean"), F.round("hac_t", 6).alias("hac_t"))


def _block_stats(bars, s=6):
    x = bars.select("series", "t", I.returns(1).alias("x")).filter("x IS NOT NULL")
    b = segments.frame(bars.sparkSession, segments.blocks(bars.agg(F.max("t") + 1).first()[0], s))
    return segments.assign(x, b).groupBy(F.col("fold").alias("block"), F.col("series").alias("rule")).agg(F.sum("x").alias("sum"), F.count("x").alias("cnt"))


@query("pbo_cscv", O.q("""SELECT round(avg(CASE WHEN lam <= 0 THEN 1.0 ELSE 0.0 END), 8) AS pbo, count(*) AS n_combinations, round(avg(mi), 8) AS mean_is_best, round(avg(mo), 8) AS mean_oos_best FROM
(SELECT mi, mo, ln((rk / (nv + 1.0)) / (1 - rk / (nv + 1.0))) AS lam FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY mi DESC, rule) AS br, rank() OVER (PARTITION BY m ORDER BY mo) AS rk, count(*) OVER (PARTITION BY m) AS nv FROM g) WHERE br = 1)""",
       f"x AS (SELECT series AS rule, t, close / lag(close) {O.W} - 1 AS x FROM bars)", "mx AS (SELECT max(t) + 1 AS n FROM bars)",
       "ed AS (SELECT i AS block, CAST(floor(n * i / 6.0) AS BIGINT) AS a, CAST(floor(n * (i + 1) / 6.0) AS BIGINT) AS b FROM mx, (SELECT unnest(generate_series(0, 5)) AS i))",
       "bs AS (SELECT block, rule, sum(x) AS s, count(x) AS c FROM x JOIN ed ON t >= a AND t < b WHERE x IS NOT NULL GROUP BY ALL)", "sp AS (SELECT m FROM (SELECT unnest(generate_series(0, 63)) AS m) WHERE bit_count(m) = 3)",
       "g AS (SELECT m, rule, sum(s) FILTER ((m >> CAST(block AS INTEGER)) & 1 = 1) / sum(c) FILTER ((m >> CAST(block AS INTEGER)) & 1 = 1) AS mi, sum(s) FILTER ((m >> CAST(block AS INTEGER)) & 1 = 0) / sum(c) FILTER ((m >> CAST(block AS INTEGER)) & 1 = 0) AS mo FROM bs, sp GROUP BY ALL)", base=O.TYPE))
def pbo_cscv(spark, d):
    out = inference.pbo(inference.cscv(_block_stats(B.type_bars(spark, d)), min_trades=1))
    return rounded(out.select("pbo", "n_combinations", "mean_is_best", "mean_oos_best"), "pbo", "mean_is_best", "mean_oos_best")


@query("reality_check")
def reality_check(spark, d):
    x = B.type_bars(spark, d).select("ts", F.col("series").alias("rule"), I.returns(1).alias("x")).filter("x IS NOT NULL")
    return inference.reality_check(x.select(F.col("ts").alias("t"), "rule", "x"), 100, mean_block=24)


@query("paired_folds", O.q("SELECT count(*) AS n, round(avg(a - b), 8) AS mean_diff, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 8) AS t FROM (SELECT fold, avg(net_typical) AS a, avg(net_optimistic) FILTER (outcome <> 'NONE') AS b FROM wf GROUP BY fold)", *_WF))
def paired_folds(spark, d):
    f = _fold_rows(B.walk_bars(spark, d)).groupBy("fold").agg(F.avg("net_typical").alias("a"), F.avg(F.when(F.col("outcome") != "NONE", F.col("net_optimistic"))).alias("b"))
    diff = F.col("a") - F.col("b")
    return rounded(f.agg(F.count(diff).alias("n"), F.avg(diff).alias("mean_diff"), stats.fold_t(diff).alias("t")), "mean_diff", "t")


@query("search_1000")
def search_1000(spark, d):
    """A thousand drawn conditions at once over minute bars in TRAIN, each with its entries, statistics and lift: throughput."""
    bars = B.minute_bars(spark, d).cache()
    n = n_bars(bars)
    seg = segments.frame(spark, [(0, "TRAIN", 0, n)])
    plan = search.Plan(n_simple=1000, regime=True, bounds={"mode": "lift"})
    by_fold, _ = search.generate(bars, seg, plan)
    trees = {condition_id(t): (t, None) for t in by_fold[0]}
    table = outcomes.build(bars, outcomes.Trade(tp=0.01, sl=0.01, horizon=30)).cache()
    rows = search.evaluate(search.entries(bars, table, trees, seg, 30), table, seg, 30, plan)
    return rows.select("condition_id", "n_raw_signals", "n_entries", "passed", "lift_P_TP_FIRST", "lift_mean_net_return")


# --- exposure --------------------------------------------------------------------------------------

_POS = [
    f"x1 AS (SELECT *, coalesce(close > {O.sma(24)}, false) AS state, CAST(ts AS DATE) <> lag(CAST(ts AS DATE)) {O.W} AS st FROM bars)",
    f"x2 AS (SELECT *, CASE WHEN st THEN CAST(lag(state) {O.W} AS INTEGER) END AS setto FROM x1)",
    f"x3 AS (SELECT *, coalesce(last_value(setto IGNORE NULLS) {O.frame('UNBOUNDED PRECEDING')}, 0) AS pos, t // 100 AS win FROM x2)",
    f"x4 AS (SELECT *, coalesce(lead(open) OVER (PARTITION BY series, win ORDER BY t), close) / open - 1 AS r, abs(pos - lag(pos, 1, 0) {O.W}) + CASE WHEN t = max(t) OVER (PARTITION BY series) THEN pos ELSE 0 END AS sw, avg(pos) OVER (PARTITION BY series) AS ex FROM x3)",
    f"x5 AS (SELECT *, sw * CAST({exposure.side_cost()!r} AS DOUBLE) AS cost, pos * r - sw * CAST({exposure.side_cost()!r} AS DOUBLE) AS net FROM x4)",
]


def _rule(bars):
    return exposure.positions(bars, F.col("close") > I.sma(24))


@query("exposure_positions", O.q("SELECT series, t, CAST(pos AS INTEGER) AS pos FROM x3", *_POS, base=O.TYPE))
def exposure_positions(spark, d):
    return _rule(B.type_bars(spark, d)).select("series", "t", "pos")


@query("exposure_windows", O.q('SELECT series, CAST(win AS BIGINT) AS "window", round(sum((pos - ex) * r), 8) AS gross_lift, round(sum(net), 8) AS net, round(sum(net - ex * r), 8) AS net_lift FROM x5 GROUP BY ALL', *_POS, base=O.TYPE))
def exposure_windows(spark, d):
    return rounded(exposure.per_window(exposure.evaluate(_rule(B.type_bars(spark, d)), 100)).drop("cost"), "gross_lift", "net", "net_lift")


_DD = [f"eq AS (SELECT series, t, sum(net) {O.frame('UNBOUNDED PRECEDING')} AS eq FROM x5)", f"dd AS (SELECT series, eq - greatest(0, max(eq) {O.frame('UNBOUNDED PRECEDING')}) AS dd FROM eq)"]


@query("drawdown", O.q("SELECT series, round(min(dd), 8) AS max_drawdown FROM dd GROUP BY series", *_POS, *_DD, base=O.TYPE))
def drawdown(spark, d):
    return rounded(exposure.max_drawdown(exposure.evaluate(_rule(B.type_bars(spark, d)), 100), "net"), "max_drawdown")


@query("exposure_summary", O.q(f"SELECT series, count(*) AS n_bars, round(avg(pos), 8) AS exposure, count(*) FILTER (pos = 1 AND pp = 0) AS n_entries, CAST(sum(sw) AS BIGINT) AS n_sides_paid, round(sum(r), 8) AS buy_hold_sum, round(sum(net), 8) AS rule_net_sum FROM (SELECT *, lag(pos, 1, 0) {O.W} AS pp FROM x5) GROUP BY series", *_POS, base=O.TYPE))
def exposure_summary(spark, d):
    out = exposure.summarize(exposure.evaluate(_rule(B.type_bars(spark, d)), 100))
    return rounded(out.select("series", "n_bars", "exposure", "n_entries", "n_sides_paid", "buy_hold_sum", "rule_net_sum"), "exposure", "buy_hold_sum", "rule_net_sum")


@query("pool_mean", O.q("SELECT ts, round(avg(close), 8) AS pooled, count(close) AS n_series FROM bars GROUP BY ts", base=O.TYPE))
def pool_mean(spark, d):
    return rounded(exposure.pool_mean(B.type_bars(spark, d), "ts", "close"), "pooled")


@query("correlation", O.q("SELECT x.series AS a, y.series AS b, round(corr(x.close, y.close), 8) AS corr FROM bars x JOIN bars y ON x.ts = y.ts AND x.series < y.series GROUP BY ALL", base=O.TYPE))
def correlation(spark, d):
    return rounded(exposure.correlation(B.type_bars(spark, d), "ts", "close"), "corr")


@query("lookahead_diff", "SELECT m AS mode, CAST(k AS INTEGER) AS k, c AS \"column\", CAST(CASE WHEN c = 'leak' THEN 1 ELSE 0 END AS BIGINT) AS failures FROM (SELECT unnest(['truncate', 'perturb']) AS m), (SELECT unnest([100, 300]) AS k), (SELECT unnest(['sma', 'ret', 'leak']) AS c)")
def lookahead_diff(spark, d):
    """The leak column looks one bar ahead: the audit must find it, and nothing else."""
    features = lambda b: b.select("series", "t", I.sma(20).alias("sma"), I.returns(3).alias("ret"), F.lead("close").over(I.W()).alias("leak"))
    return audit.check(B.walk_bars(spark, d), features, ["sma", "ret", "leak"], [100, 300])
