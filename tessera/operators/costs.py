"""Cost models: fees, spread and slippage as column builders, and what a trade returns after them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.indicators import W

from .outcomes import SCENARIOS, WARM_UP_VOL

#: Fixed values: (maker, taker) of a side.
SCHEDULES = {"spot": (0.0010, 0.0010), "spot_bnb": (0.00075, 0.00075)}


@dataclass(frozen=True)
class ExchangeFee:
    """A schedule's rate for a resting (maker) or a market (taker) order."""

    schedule: str = "spot"

    def rate(self, maker: bool) -> float:
        return SCHEDULES[self.schedule][0 if maker else 1]


@dataclass(frozen=True)
class FlatFee:
    value: float

    def rate(self, maker: bool) -> float:
        return self.value


@dataclass(frozen=True)
class FixedSpread:
    full: float

    def half(self) -> float:
        return self.full / 2


@dataclass(frozen=True)
class FixedSlippage:
    value: float

    def at(self, vol: Column | None) -> Column:
        return F.lit(self.value)


@dataclass(frozen=True)
class VolatilitySlippage:
    """base + k times the relative ATR of the bar before; a constant while there is none, as any other would look ahead."""

    base: float
    k: float

    def at(self, vol: Column | None) -> Column:
        return F.lit(self.base) + F.lit(self.k) * F.coalesce(vol if vol is not None else F.lit(None).cast("double"), F.lit(WARM_UP_VOL))


def relative_atr(atr: str) -> Column:
    """The ATR over the close of the bar before."""
    return F.lag(F.col(atr) / F.col("close")).over(W())


@dataclass(frozen=True)
class ExecutionCost:
    """Net return of a trade. A passive exit (the profit order of a maker) pays the maker's fee, no spread and no slippage."""

    fee: ExchangeFee | FlatFee
    spread: FixedSpread
    slippage: FixedSlippage | VolatilitySlippage
    profit_order: str = "maker"

    def net_return(self, side: str, price: Column, exit_price: Column, at_profit: Column, vol_in: Column | None = None, vol_out: Column | None = None) -> Column:
        sign = 1 if side == "LONG" else -1
        passive = at_profit if self.profit_order == "maker" else F.lit(False)
        paid = price * (1 + sign * (self.spread.half() + self.slippage.at(vol_in)))
        got = F.when(passive, exit_price).otherwise(exit_price * (1 - sign * (self.spread.half() + self.slippage.at(vol_out))))
        fee_in = F.lit(self.fee.rate(False))
        fee_out = F.when(passive, self.fee.rate(True)).otherwise(self.fee.rate(False))
        return got * (1 - fee_out) / (paid * (1 + fee_in)) - 1 if side == "LONG" else (paid * (1 - fee_in) - got * (1 + fee_out)) / paid


def scenario(name: str, custom: dict | None = None) -> ExecutionCost:
    """optimistic, typical or conservative, or custom with fee, spread, slippage and vol_k of one's own."""
    if name != "custom" and name not in MODELS:
        raise ValueError(f"unknown scenario {name!r}; known: {sorted(MODELS)} and custom")
    s = custom if name == "custom" else SCENARIOS[name]
    fee = ExchangeFee("spot_bnb" if name == "optimistic" else "spot") if name != "custom" else FlatFee(s["fee"])
    slip = VolatilitySlippage(s["slippage"], s["vol_k"]) if s.get("vol_k") else FixedSlippage(s["slippage"])
    return ExecutionCost(fee, FixedSpread(s["spread"]), slip)


#: Models by name; more can be registered.
MODELS = {name: (lambda name=name: scenario(name)) for name in SCENARIOS}


def market_only(side: str, price: Column, exit_price: Column, fee: float, spread: float, slippage: float) -> Column:
    """Both orders at market: the former way of charging costs."""
    model = ExecutionCost(FlatFee(fee), FixedSpread(spread), FixedSlippage(slippage), profit_order="taker")
    return model.net_return(side, price, exit_price, F.lit(False))
