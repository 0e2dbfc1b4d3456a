"""DuckDB forms of the queries, built from shared WITH parts."""

from __future__ import annotations

from tessera.operators.outcomes import SCENARIOS

HORIZON = 24


def hourly(series="'all'"):
    return f"""e0 AS (SELECT {series} AS series, ts, event_id, date_trunc('hour', ts) AS h, CAST(round((value - 50) * 100) AS BIGINT) AS d FROM events),
px0 AS (SELECT series, ts, event_id, h, (floor(20000 * sqrt(count(*) OVER (PARTITION BY series))) + sum(d) OVER (PARTITION BY series ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) / CAST(100 AS DOUBLE) AS px FROM e0),
hb AS (SELECT series, h, first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM px0 GROUP BY series, h),
bars AS (SELECT series, h AS ts, CAST(row_number() OVER (PARTITION BY series ORDER BY h) - 1 AS BIGINT) AS t, open, high, low, close, volume FROM hb)"""


DAILY = """bars AS (SELECT 'orders' AS series, ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS BIGINT) AS t, open, high, low, close, volume FROM (
SELECT o_orderdate AS ts, CAST(first(o_totalprice ORDER BY o_orderkey) AS DOUBLE) AS open, CAST(max(o_totalprice) AS DOUBLE) AS high, CAST(min(o_totalprice) AS DOUBLE) AS low,
CAST(last(o_totalprice ORDER BY o_orderkey) AS DOUBLE) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY o_orderdate))"""
WALK, TYPE = hourly(), hourly("event_type")
W = "OVER (PARTITION BY series ORDER BY t)"


def frame(a, b="CURRENT ROW"):
    return f"OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {a} AND {b})"


def q(select, *parts, base=WALK):
    return "WITH RECURSIVE " + ",\n".join([base, *parts]) + "\n" + select


def sma(p, x="close"):
    f = frame(f"{p - 1} PRECEDING")
    return f"CASE WHEN count({x}) {f} >= {p} THEN avg({x}) {f} END"


def scan(name, src, x, alpha, p, start=0):
    """The recursion from bar start on; name has y, which is null until p values."""
    keep = repr(1 - alpha)
    return f"""{name}_r AS (SELECT series, t, {x} AS y FROM {src} WHERE t = {start} UNION ALL
SELECT s.series, s.t, CAST({keep} AS DOUBLE) * r.y + CAST({alpha!r} AS DOUBLE) * s.{x} FROM {name}_r r JOIN {src} s ON s.series = r.series AND s.t = r.t + 1),
{name} AS (SELECT series, t, CASE WHEN t >= {start + p - 1} THEN y END AS y FROM {name}_r)"""


TR = "tr AS (SELECT series, t, close, open, greatest(high - low, abs(high - lag(close) %s), abs(low - lag(close) %s)) AS x FROM bars)" % (W, W)


def atr(p, name="atr"):
    return f"{TR},\n" + scan(name, "tr", "x", 1 / p, p)


def features(p=(10, 30)):
    return f"f AS (SELECT *, {sma(p[0])} AS a, {sma(p[1])} AS b FROM bars)"


#: Column pairs (v, d) of the conditions that the queries use, over f.
ABOVE = f"coalesce(lag(a) {W} < lag(b) {W} AND a >= b, false)"
CROSS_D = f"(a IS NOT NULL AND b IS NOT NULL AND lag(a) {W} IS NOT NULL AND lag(b) {W} IS NOT NULL)"
COND = f"c AS (SELECT *, coalesce(close > a, false) AS v1, a IS NOT NULL AS d1, {ABOVE} AS v2, {CROSS_D} AS d2, coalesce(lag(a) {W} > lag(b) {W} AND a <= b, false) AS v3, coalesce(close < b, false) AS v4, b IS NOT NULL AS d4 FROM f)"


def net(side, scenario, price, exit_price, passive):
    s = SCENARIOS[scenario]
    adv, f = repr(s["spread"] / 2 + s["slippage"]), repr(s["fee"])
    sg = "+" if side == "LONG" else "-"
    op = "-" if side == "LONG" else "+"
    paid = f"({price} * (1 {sg} CAST({adv} AS DOUBLE)))"
    got = f"(CASE WHEN {passive} THEN {exit_price} ELSE {exit_price} * (1 {op} CAST({adv} AS DOUBLE)) END)"
    if side == "LONG":
        return f"{got} * (1 - CAST({f} AS DOUBLE)) / ({paid} * (1 + CAST({f} AS DOUBLE))) - 1"
    return f"({paid} * (1 - CAST({f} AS DOUBLE)) - {got} * (1 + CAST({f} AS DOUBLE))) / {paid}"


def outcomes(side="LONG", tp=0.05, sl=0.03, h=HORIZON, levels=None):
    sign = 1 if side == "LONG" else -1
    tp_, sl_ = levels or (f"open * CAST({1 + sign * tp!r} AS DOUBLE)", f"open * CAST({1 - sign * sl!r} AS DOUBLE)")
    good, bad = ("f.high >= tp", "f.low <= sl") if side == "LONG" else ("f.low <= tp", "f.high >= sl")
    gross = (lambda x: f"{x} / p - 1") if side == "LONG" else (lambda x: f"1 - {x} / p")
    up, down = ("hi", "lo") if side == "LONG" else ("lo", "hi")
    stop = "least(sl, x.open)" if side == "LONG" else "greatest(sl, x.open)"
    src = "lv" if levels else "bars"
    nets = ", ".join(f"{net(side, s, 'p', 'exit_price', chr(111) + ' = ' + chr(39) + 'TP_FIRST' + chr(39))} AS net_{s}" for s in ("optimistic", "typical"))
    return f"""o0 AS (SELECT series, t AS e, open AS p, {tp_} AS tp, {sl_} AS sl FROM {src} WHERE t + {h} - 1 <= (SELECT max(t) FROM bars b WHERE b.series = {src}.series)),
o1 AS (SELECT o0.series, e, p, tp, sl, coalesce(min(CASE WHEN {good} THEN f.t - e END), {h}) AS kt, coalesce(min(CASE WHEN {bad} THEN f.t - e END), {h}) AS ks, max(f.high) AS hi, min(f.low) AS lo
FROM o0 JOIN bars f ON f.series = o0.series AND f.t BETWEEN e AND e + {h} - 1 GROUP BY ALL),
o2 AS (SELECT o1.*, least(kt, ks, {h} - 1) AS off, CASE WHEN kt < ks THEN 'TP_FIRST' WHEN ks < kt THEN 'SL_FIRST' WHEN kt < {h} THEN 'AMBIGUOUS' ELSE 'NONE' END AS o, {stop} AS stop, x.close AS fin
FROM o1 JOIN bars x ON x.series = o1.series AND x.t = e + least(kt, ks, {h} - 1)),
o3 AS (SELECT *, CASE o WHEN 'TP_FIRST' THEN tp WHEN 'NONE' THEN fin ELSE stop END AS exit_price FROM o2),
oc AS (SELECT series, e, p AS entry_price, o AS outcome, CAST(off AS INTEGER) AS exit_offset, exit_price, {gross('exit_price')} AS gross_return, {nets}, {gross(up)} AS mfe, {gross(down)} AS mae FROM o3)"""


def entries(mode="until_exit", cooldown=15, h=HORIZON, cond="v2 AND d2"):
    """nx: the first candidate that may follow each candidate; then the chain from the first."""
    free = "o.e + o.exit_offset" if mode == "until_exit" else f"c.t + {cooldown}"
    return f"""raw AS (SELECT c.series, s.segment, c.t, c.t <= s.stop - 1 - {h} AS fits FROM c JOIN seg s ON c.t >= s.start AND c.t < s.stop WHERE {cond}),
cand AS (SELECT c.series, c.segment, c.t, {free} AS free FROM raw c JOIN oc o ON o.series = c.series AND o.e = c.t + 1 WHERE c.fits),
nx AS (SELECT a.*, (SELECT min(b.t) FROM cand b WHERE b.series = a.series AND b.segment = a.segment AND b.t >= a.free AND b.t > a.t) AS nxt FROM cand a),
ent AS (SELECT series, segment, t, nxt FROM nx WHERE (series, segment, t) IN (SELECT series, segment, min(t) FROM cand GROUP BY ALL)
UNION ALL SELECT n.series, n.segment, n.t, n.nxt FROM ent e JOIN nx n ON n.series = e.series AND n.segment = e.segment AND n.t = e.nxt)"""


SEG = "nb AS (SELECT count(*) AS n FROM bars), seg AS (SELECT 'TRAIN' AS segment, 0 AS start, CAST(round_even(n * 0.3, 0) AS BIGINT) AS stop FROM nb UNION ALL SELECT 'VALIDATION', CAST(round_even(n * 0.3, 0) AS BIGINT), CAST(round_even(n * 0.65, 0) AS BIGINT) FROM nb UNION ALL SELECT 'TEST', CAST(round_even(n * 0.65, 0) AS BIGINT), n FROM nb)"
SIGNALS = [features(), COND]


def rounded(*cols):
    return ", ".join(f"round({c}, 8) AS {c}" for c in cols)
