"""Outcome of an entry at each bar: first touch of a profit or stop level in the next H bars, excursions, costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.indicators import W

#: Fixed values of the cost scenarios: fee of a side, full spread, slippage, its weight of the bar's relative ATR.
SCENARIOS = {
    "optimistic": {"fee": 0.00075, "spread": 0.00002, "slippage": 0.00005, "vol_k": 0.0},
    "typical": {"fee": 0.0010, "spread": 0.0001, "slippage": 0.0002, "vol_k": 0.0},
    "conservative": {"fee": 0.0010, "spread": 0.0005, "slippage": 0.0003, "vol_k": 0.05},
}
#: Relative ATR where none is known yet.
WARM_UP_VOL = 0.01


@dataclass(frozen=True)
class Trade:
    """side LONG or SHORT; tp and sl are fractions of the entry price, or multiples of the ATR column before the entry."""

    side: str = "LONG"
    tp: float = 0.05
    sl: float = 0.03
    horizon: int = 24
    policy: str = "worst"
    atr: str | None = None


def adverse(scenario: str, vol: Column | None) -> Column:
    """Half the spread and the slippage, which may grow with the bar's volatility."""
    s = SCENARIOS[scenario]
    out = F.lit(s["spread"] / 2 + s["slippage"])
    return out + F.lit(s["vol_k"]) * F.coalesce(vol, F.lit(WARM_UP_VOL)) if s["vol_k"] and vol is not None else out


def net_return(side: str, scenario: str, price: Column, exit_price: Column, passive: Column, vol_in: Column | None = None, vol_out: Column | None = None) -> Column:
    """After fees, spread and slippage; a passive exit (a resting limit order) has neither spread nor slippage."""
    f, sign = SCENARIOS[scenario]["fee"], 1 if side == "LONG" else -1
    paid = price * (1 + sign * adverse(scenario, vol_in))
    got = F.when(passive, exit_price).otherwise(exit_price * (1 - sign * adverse(scenario, vol_out)))
    if side == "LONG":
        return got * (1 - f) / (paid * (1 + f)) - 1
    return (paid * (1 - f) - got * (1 + f)) / paid


def build(bars: DataFrame, trade: Trade, scenarios=("optimistic", "typical"), vol: str | None = None) -> DataFrame:
    """One row per bar e as an entry: outcome (null where the window isn't complete or the levels aren't valid),
    exit_offset, exit_price, gross_return, net_<scenario>, mfe, mae. vol: column of the relative ATR of a bar.

    The window's bars travel as one array a row; MFE and MAE need plain window extremes.
    """
    h, long = trade.horizon, trade.side == "LONG"
    sign = 1.0 if long else -1.0
    ahead = W().rowsBetween(0, h - 1)
    df = bars.withColumn("_last", F.max("t").over(Window.partitionBy("series")))
    df = df.withColumns({"_w": F.collect_list(F.struct("open", "high", "low", "close")).over(ahead), "_hi": F.max("high").over(ahead), "_lo": F.min("low").over(ahead)})
    p = F.col("open")
    if trade.atr:
        df = df.withColumn("_atr", F.lag(trade.atr).over(W()))
        tp, sl = p + F.lit(sign * trade.tp) * F.col("_atr"), p - F.lit(sign * trade.sl) * F.col("_atr")
        valid = F.col("_atr").isNotNull() & (F.least(tp, sl) > 0)
    else:
        tp, sl, valid = p * F.lit(1 + sign * trade.tp), p * F.lit(1 - sign * trade.sl), F.lit(True)
    df = df.withColumns({"_tp": tp, "_sl": sl, "_valid": valid & (F.col("t") + h - 1 <= F.col("_last"))})
    if vol:
        df = df.withColumns({"_v": F.lag(vol).over(W())}).withColumn("_vs", F.collect_list(F.coalesce("_v", F.lit(WARM_UP_VOL))).over(ahead))
    good = (lambda x: x["high"] >= F.col("_tp")) if long else (lambda x: x["low"] <= F.col("_tp"))
    bad = (lambda x: x["low"] <= F.col("_sl")) if long else (lambda x: x["high"] >= F.col("_sl"))
    first = lambda hit: F.coalesce(F.nullif(F.array_position(F.transform("_w", hit), True), F.lit(0)) - 1, F.lit(h)).cast("int")
    df = df.withColumns({"_kt": first(good), "_ks": first(bad)})
    kt, ks = F.col("_kt"), F.col("_ks")
    outcome = F.when(kt < ks, "TP_FIRST").when(ks < kt, "SL_FIRST").when(kt < h, "AMBIGUOUS").otherwise("NONE")
    df = df.withColumns({"_o": outcome, "_off": F.least(kt, ks, F.lit(h - 1))})
    bar = F.try_element_at("_w", F.col("_off") + 1)
    stop = F.least(F.col("_sl"), bar["open"]) if long else F.greatest(F.col("_sl"), bar["open"])
    df = df.withColumns({"_stop": stop, "_end": bar["close"]})
    by_policy = lambda a, b: {"worst": b, "best": a, "midpoint": (a + b) / 2}[trade.policy]
    o = F.col("_o")
    x = F.when(o == "TP_FIRST", F.col("_tp")).when(o == "SL_FIRST", F.col("_stop")).when(o == "NONE", F.col("_end")).otherwise(by_policy(F.col("_tp"), F.col("_stop")))
    gross = lambda v: v / p - 1 if long else 1 - v / p
    vin, vout = (F.col("_v"), F.try_element_at("_vs", F.col("_off") + 1)) if vol else (None, None)
    cols = {"exit_price": x, "gross_return": gross(x)}
    for s in scenarios:
        net = lambda price, passive, s=s: net_return(trade.side, s, p, price, passive, vin, vout)
        both = by_policy(net(F.col("_tp"), F.lit(True)), net(F.col("_stop"), F.lit(False)))
        cols[f"net_{s}"] = F.when(o == "AMBIGUOUS", both).otherwise(net(x, o == "TP_FIRST"))
    up, down = (gross(F.col("_hi")), gross(F.col("_lo"))) if long else (gross(F.col("_lo")), gross(F.col("_hi")))
    masked = {k: F.when(F.col("_valid"), v) for k, v in ({"outcome": o, "exit_offset": F.col("_off")} | cols | {"mfe": up, "mae": down}).items()}
    return df.select("series", "t", F.col("t").alias("e"), p.alias("entry_price"), *[v.alias(k) for k, v in masked.items()])


def reach(side: str, p: float, bars: int) -> Column:
    w = W().rowsBetween(0, bars - 1)
    return F.max("high").over(w) >= F.col("open") * F.lit(1 + p) if side == "LONG" else F.min("low").over(w) <= F.col("open") * F.lit(1 - p)


def at_horizon(side: str, p: float, bars: int) -> Column:
    end = F.lead("close", bars - 1).over(W())
    return (end / F.col("open") - 1 if side == "LONG" else 1 - end / F.col("open")) >= p


def sequence(side: str, p1: float, p2: float, horizon: int, down_first: bool = True) -> Column:
    """An adverse move of p1 and later, not in the same bar, a favourable one of p2 (or the reverse). Needs _w."""
    p, long = F.col("open"), side == "LONG"
    fav = lambda x, q: x["high"] >= p * F.lit(1 + q) if long else x["low"] <= p * F.lit(1 - q)
    adv = lambda x, q: x["low"] <= p * F.lit(1 - q) if long else x["high"] >= p * F.lit(1 + q)
    one, two = (adv, fav) if down_first else (fav, adv)
    k = F.array_position(F.transform("_w", lambda x: one(x, p1)), True).cast("int")
    return F.when(k > 0, F.exists(F.slice("_w", k + 1, F.lit(horizon)), lambda x: two(x, p2))).otherwise(False)


def with_window(bars: DataFrame, horizon: int) -> DataFrame:
    return bars.withColumn("_w", F.collect_list(F.struct("high", "low")).over(W().rowsBetween(0, horizon - 1)))


def favourable(side: str, horizon: int, wanted: list[dict]) -> dict[str, Column]:
    """Columns by name of the wanted favourable outcomes ({kind, p or p1 and p2, bars}); those beyond the horizon are left
    out. The sequences need with_window()."""
    out = {}
    for w in wanted:
        kind = w["kind"]
        if w.get("bars", 0) > horizon:
            continue
        if kind in ("reach", "at_horizon"):
            out[f"{kind}_{w['p']:g}_{w['bars']}"] = (reach if kind == "reach" else at_horizon)(side, w["p"], w["bars"])
        else:
            out[f"{kind}_{w['p1']:g}_{w['p2']:g}"] = sequence(side, w["p1"], w["p2"], horizon, kind == "down_then_up")
    return out


def levels(bars: DataFrame, trade: Trade) -> DataFrame:
    """(series, t, tp, sl): the levels of an entry at each bar; null where they aren't valid."""
    sign, p = (1.0 if trade.side == "LONG" else -1.0), F.col("open")
    if trade.atr:
        unit = F.lag(trade.atr).over(W())
        tp, sl = p + F.lit(sign * trade.tp) * unit, p - F.lit(sign * trade.sl) * unit
        valid = F.least(tp, sl) > 0
        return bars.select("series", "t", F.when(valid, tp).alias("tp"), F.when(valid, sl).alias("sl"))
    return bars.select("series", "t", (p * F.lit(1 + sign * trade.tp)).alias("tp"), (p * F.lit(1 - sign * trade.sl)).alias("sl"))
