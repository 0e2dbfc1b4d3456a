"""Operands as values: a family, its parameters and the unit scale that decides what may be compared with what.

An operand is built from its family's entry in FAMILIES, which says how many parameters it has, which scale it is in
and which column it is once materialise() has added it. Numbers are the operands of every scale.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import indicators as I

HOUR = 3600
ANY = "any"


@dataclass(frozen=True)
class Family:
    """parameters: their names. scale: of the parameters. column: once what needs() names is there."""

    parameters: tuple[str, ...]
    scale: Callable[..., str]
    column: Callable[..., Column]
    needs: Callable[..., list[tuple]] = lambda *p: []


@dataclass(frozen=True)
class Operand:
    family: str
    parameters: tuple

    def __post_init__(self):
        if self.family not in FAMILIES or len(self.parameters) != len(FAMILIES[self.family].parameters):
            raise ValueError(f"no such operand: {self.family}{self.parameters}")

    @property
    def scale(self) -> str:
        return FAMILIES[self.family].scale(*self.parameters)

    @property
    def name(self) -> str:
        """Its column's; a price is its own."""
        return str(self.parameters[0]) if self.family == "price" else "_".join(map(str, (self.family, *self.parameters)))

    def __str__(self) -> str:
        return self.name


def _after(column: str) -> Callable[..., Column]:
    return lambda *p: F.col(column.format(*p))


#: Register a new operand here.
FAMILIES: dict[str, Family] = {
    "price": Family(("field",), lambda f: "price", lambda f: F.col(f)),
    "sma": Family(("period",), lambda p: "price", _after("sma_{}"), lambda p: [("sma", p)]),  # a sliding frame would add up p rows for each bar
    "ema": Family(("period",), lambda p: "price", _after("ema_{}"), lambda p: [("ema", p)]),
    "rsi": Family(("period",), lambda p: "rsi", _after("rsi_{}"), lambda p: [("rsi", p)]),
    "atr": Family(("period",), lambda p: "atr", _after("atr_{}"), lambda p: [("atr", p)]),
    "atr_pct": Family(("period",), lambda p: "atr_pct", lambda p: F.col(f"atr_{p}") / F.col("close"), lambda p: [("atr", p)]),
    "macd": Family(("fast", "slow", "signal", "line"), lambda f, s, g, x: f"macd({f},{s})", _after("macd_{}_{}_{}_{}"), lambda f, s, g, x: [("macd", f, s, g)]),
    "return": Family(("bars",), lambda n: "return", I.returns),
    "candle": Family(("part",), lambda part: "candle_ratio" if part.endswith("_ratio") else "candle_abs", I.candle),
    "relvol": Family(("short", "long"), lambda a, b: "relvol", lambda a, b: F.try_divide(f"atr_{a}", f"atr_{b}"), lambda a, b: [("atr", a), ("atr", b)]),
    "htf": Family(("seconds", "candles"), lambda s, n: f"htf_{s}", _after("htf_{}_{}"), lambda s, n: [("htf", s, n)]),
}


def operand(family: str, *parameters) -> Operand:
    return Operand(family, tuple(parameters))


def comparable(a, b) -> bool:
    """Numbers go with all; operands with those of their scale."""
    scales = {x.scale for x in (a, b) if isinstance(x, Operand)}
    return len(scales) < 2


def to_dict(x) -> dict:
    if isinstance(x, Operand):
        return {"family": x.family, **dict(zip(FAMILIES[x.family].parameters, x.parameters))}
    return {"column": x} if isinstance(x, str) else {"constant": float(x)}


def from_dict(d: dict):
    if "family" not in d:
        return next(iter(d.values()))
    names = FAMILIES[d["family"]].parameters
    return operand(d["family"], *(d[n] for n in names))


def _candle(pdf, part):
    o, h, l, c = (pdf[x].to_numpy(float) for x in ("open", "high", "low", "close"))
    name, rng = part.removesuffix("_ratio"), h - l
    x = {"body": lambda: np.abs(c - o), "range": lambda: rng, "upper_wick": lambda: h - np.maximum(o, c), "lower_wick": lambda: np.minimum(o, c) - l}[name]()
    return np.divide(x, rng, out=np.full(len(x), np.nan), where=rng > 0) if part.endswith("_ratio") else x


#: Array forms of the families whose columns are expressions: over one series' bars in order, given what needs() made.
ARRAYS: dict[str, Callable] = {
    "price": lambda pdf, made, f: pdf[f].to_numpy(float), "return": lambda pdf, made, n: (pdf["close"] / pdf["close"].shift(n) - 1).to_numpy(float), "candle": lambda pdf, made, part: _candle(pdf, part),
    "atr_pct": lambda pdf, made, p: made[f"atr_{p}"] / pdf["close"].to_numpy(float),
    "relvol": lambda pdf, made, a, b: np.divide(made[f"atr_{a}"], made[f"atr_{b}"], out=np.full(len(pdf), np.nan), where=made[f"atr_{b}"] != 0),
}


def arrays(pdf, operands) -> dict[str, np.ndarray]:
    """The operands' values by name, over the bars of one series in order; equal to materialise()'s columns, NaN for null."""
    wanted = {x for x in operands if isinstance(x, Operand)}
    made: dict[str, np.ndarray] = {}
    for spec in sorted({n for x in wanted for n in FAMILIES[x.family].needs(*x.parameters)}, key=str):
        made |= {n: np.asarray(v, float) for n, v in zip(I.column_names(spec), I.RECURSIVE[spec[0]][0](pdf, *spec[1:]))}
    return {x.name: ARRAYS[x.family](pdf, made, *x.parameters) if x.family in ARRAYS else made[x.name] for x in wanted}


def materialise(bars: DataFrame, operands) -> DataFrame:
    """bars with a column for each operand, by its name: one grouped pass for all recursive ones, then expressions."""
    wanted = sorted({x for x in operands if isinstance(x, Operand) and x.family != "price"}, key=str)
    specs = sorted({n for x in wanted for n in FAMILIES[x.family].needs(*x.parameters)}, key=str)
    out = I.with_recursive(bars, *specs) if specs else bars
    out = out.withColumns({x.name: FAMILIES[x.family].column(*x.parameters) for x in wanted})
    keep = [*bars.columns, *(x.name for x in wanted)]
    return out.select(*dict.fromkeys(keep))
