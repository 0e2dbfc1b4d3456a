"""Search: conditions drawn by a seeded grammar, evaluated in one pass over bars, pooled, combined and filtered.

Drafts are drawn on the driver (they are metadata); the thresholds in them are quantiles of TRAIN, all taken in one
aggregate. Trees are rows: bars with their operands and outcomes go to one group for each series and batch of trees,
where each tree is a few array operations, so a thousand conditions cost one scan and no wide plan.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.cluster import ship
from tessera.functions import operands as O

from . import segments as S
from . import stats
from .conditions import And, Arrays, Node, Not, Or, Then, Within, condition_id, from_dict, operands_of, to_dict
from .entries import greedy
from .quality import PRICES

#: The grammar's weights.
SIMPLE = {"compare_const": 0.15, "compare_operand": 0.15, "cross_const": 0.40, "cross_operand": 0.30}
COMPLEX = {"and": 0.15, "or": 0.15, "not": 0.10, "then": 0.20, "within_and": 0.40}
RANGES = {"sma": (5, 200), "ema": (5, 200), "rsi": (5, 30), "atr": (5, 30), "fast": (5, 20), "slow": (21, 50), "signal": (5, 15), "htf4": (6, 60), "htf1d": (5, 100), "short": (5, 30), "long": (60, 300)}
RETURNS = (*range(1, 26), 50)
RATIOS = ("body_ratio", "upper_wick_ratio", "lower_wick_ratio")
OPS = (">", ">=", "<", "<=")
#: Trees of a group.
BATCH = 128
#: Draws for each condition that is wanted, at most.
ATTEMPTS = 50


def round_sig(x: float, digits: int) -> float:
    """To so many significant digits, halves to even."""
    return 0.0 if not x or not math.isfinite(x) else round(x, digits - 1 - math.floor(math.log10(abs(x))))


@dataclass(frozen=True)
class Plan:
    """What to draw and what to keep."""

    seed: int = 42
    n_simple: int = 100
    n_complex: int = 0
    max_depth: int = 2
    pool_size: int = 50
    quantiles: tuple[float, float] = (0.05, 0.95)
    digits: int = 3
    window: tuple[int, int] = (2, 25)
    regime: bool = False
    structured: bool = False
    side: str = "LONG"
    cooldown: int | None = None  # bars between entries; None: until exit
    fraction: float = 0.01
    least: int = 30
    bounds: dict = field(default_factory=lambda: {"mode": "absolute", "p_tp": 0.15})


class Grammar:
    """Draws drafts: trees as dictionaries in which a threshold is {"quantile", "of"}."""

    def __init__(self, plan: Plan):
        self.plan, self.rng = plan, np.random.default_rng(plan.seed)

    def one_of(self, options, weights=None):
        options = list(options)
        if weights is not None:
            weights = np.asarray(list(weights), float) / sum(weights)
        return options[int(self.rng.choice(len(options), p=weights))]

    def between(self, name: str) -> int:
        low, high = RANGES[name]
        return int(self.rng.integers(low, high + 1))

    def price(self):
        if self.rng.random() < 0.35:
            return O.operand("price", self.one_of(PRICES) if self.rng.random() < 0.1 else "close")
        kind = self.one_of(("sma", "ema"))
        return O.operand(kind, self.between(kind))

    def of(self, family: str):
        """An operand of a family of the grammar."""
        if family == "macd":
            return O.operand("macd", self.between("fast"), self.between("slow"), self.between("signal"), self.one_of(("line", "signal", "hist")))
        if family == "return":
            return O.operand("return", int(self.one_of(RETURNS)))
        if family == "candle":
            return O.operand("candle", self.one_of(RATIOS))
        if family in ("htf4", "htf1d"):
            return O.operand("htf", (4 if family == "htf4" else 24) * O.HOUR, self.between(family))
        if family == "relvol":
            return O.operand("relvol", self.between("short"), self.between("long"))
        return O.operand(family, self.between("atr" if family == "atr_pct" else family))

    def families(self):
        return ["rsi", "return", "candle", "atr_pct", "macd", *(("htf4", "htf1d", "relvol") if self.plan.regime else ())]

    def threshold(self, x, low=None, high=None):
        if x.family == "macd":
            return {"constant": 0.0}
        a, b = self.plan.quantiles
        return {"quantile": float(self.rng.uniform(a if low is None else low, b if high is None else high)), "of": O.to_dict(x)}

    def pair(self):
        """Two different operands of one scale."""
        for _ in range(20):
            family = self.one_of(["price", "price", *self.families()])
            if family == "macd":
                fast, slow, signal = self.between("fast"), self.between("slow"), self.between("signal")
                return tuple(O.operand("macd", fast, slow, signal, line) for line in ("line", "signal"))
            a, b = (self.price(), self.price()) if family == "price" else (self.of(family), self.of(family))
            if a != b and O.comparable(a, b):
                return a, b
        return O.operand("price", "close"), O.operand("price", "open")

    def leaf(self, kind: str, left: dict, right: dict, parameter: str) -> dict:
        return {"type": kind, "parts": [], "operands": [left, right], "parameters": [parameter]}

    def simple(self) -> dict:
        kind, against = self.one_of(SIMPLE, SIMPLE.values()).split("_")
        if against == "const":
            x = self.of(self.one_of(self.families()))
            left, right = O.to_dict(x), self.threshold(x)
        else:
            left, right = map(O.to_dict, self.pair())
        return self.leaf(kind, left, right, self.one_of(OPS) if kind == "compare" else self.one_of(("above", "below")))

    def structured(self) -> dict:
        """One or two regime comparisons as context, a crossing as trigger, both in the side's direction."""
        long = self.plan.side == "LONG"
        contexts = []
        for _ in range(int(self.rng.integers(1, 3))):
            x = self.of(self.one_of(("htf4", "htf1d", "relvol")))
            low, high = ((0.5, 0.95) if long else (0.05, 0.5)) if x.family == "htf" else (None, None)
            op = (">" if long else "<") if x.family == "htf" else self.one_of((">", "<"))
            contexts.append(self.leaf("compare", O.to_dict(x), self.threshold(x, low, high), op))
        context = contexts[0] if len(contexts) == 1 else {"type": "and", "parts": contexts, "operands": [], "parameters": []}
        kind = self.one_of(("rsi_cross", "macd_cross", "ret_cross", "rsi_recovery"))
        turn, other = ("above", "<") if long else ("below", ">")
        if kind == "macd_cross":
            left, right = (O.to_dict(x) for x in self._macd_pair())
            trigger = self.leaf("cross", left, right, turn)
        else:
            x = self.of("return" if kind == "ret_cross" else "rsi")
            trigger = self.leaf("cross", O.to_dict(x), self.threshold(x), turn)
            if kind == "rsi_recovery":
                before = self.leaf("compare", O.to_dict(x), self.threshold(x, *((0.05, 0.3) if long else (0.7, 0.95))), other)
                within = {"type": "within", "parts": [before], "operands": [], "parameters": [self.bars()]}
                trigger = {"type": "and", "parts": [within, trigger], "operands": [], "parameters": []}
        return {"type": "context", "parts": [context, trigger], "operands": [], "parameters": []}

    def _macd_pair(self):
        fast, slow, signal = self.between("fast"), self.between("slow"), self.between("signal")
        return (O.operand("macd", fast, slow, signal, line) for line in ("line", "signal"))

    def bars(self) -> int:
        low, high = self.plan.window
        return int(self.rng.integers(low, high + 1))

    def combined(self, pool: list[Node], budget: int) -> Node:
        """A random tree over the pool's conditions, at most budget deep."""
        if budget <= 1:
            return self.one_of(pool)
        kind = self.one_of(COMPLEX, COMPLEX.values())
        part = lambda: self.combined(pool, int(self.rng.integers(1, budget)))
        if kind == "not":
            return Not(part())
        a, b = part(), part()
        return {"and": lambda: And(a, b), "or": lambda: Or(a, b), "then": lambda: Then(a, b, self.bars()), "within_and": lambda: And(Within(a, self.bars()), b)}[kind]()


def leaves(tree: Node) -> list[str]:
    return [k for p in tree.parts for k in leaves(p)] if tree.parts else [tree.key]


def complex_trees(grammar: Grammar, pool: list[Node]) -> list[Node]:
    """Up to n_complex different trees over the pool, none that is a leaf or holds one twice."""
    plan, found = grammar.plan, {}
    for _ in range(ATTEMPTS * plan.n_complex if pool else 0):
        if len(found) == plan.n_complex:
            break
        tree = grammar.combined(pool, plan.max_depth)
        if tree.depth >= 2 and len(set(leaves(tree))) == len(leaves(tree)):
            found.setdefault(tree.key, tree)
    return list(found.values())


def _requests(draft: dict):
    for x in draft["operands"]:
        if "quantile" in x:
            yield O.from_dict(x["of"]), x["quantile"]
    for p in draft["parts"]:
        yield from _requests(p)


def _resolved(draft: dict, known: dict, digits: int) -> Node:
    value = lambda x: {"constant": round_sig(known.get((str(O.from_dict(x["of"])), x["quantile"])) or 0.0, digits)} if "quantile" in x else x

    def walk(d):
        return {**d, "operands": [value(x) for x in d["operands"]], "parts": [walk(p) for p in d["parts"]]}

    return from_dict(walk(draft))


def quantiles(bars: DataFrame, train: DataFrame, asked: set) -> dict:
    """{fold: {(operand, q): value}} over the bars of each fold's TRAIN, exact. Of one series in its own pass, without
    columns for the operands; of several, whose values have to meet, in one aggregate over those columns."""
    folds = {r["fold"]: {} for r in train.select("fold").distinct().collect()}
    by: dict = {}
    for x, q in sorted(asked, key=lambda r: (str(r[0]), r[1])):
        by.setdefault(x, []).append(q)
    if not by:
        return folds
    if "series" in train.columns or len(bars.select("series").distinct().limit(2).collect()) != 1:
        aggs = [F.percentile(F.col(f"`{x}`"), F.array(*map(F.lit, qs))).alias(str(x)) for x, qs in by.items()]
        rows = S.assign(O.materialise(bars, by), train).groupBy("fold").agg(*aggs).collect()
        return {r["fold"]: {(str(x), q): v for x, qs in by.items() for q, v in zip(qs, r[str(x)] or [None] * len(qs))} for r in rows}
    ship(bars.sparkSession)
    ranges = [(r["fold"], r["start"], r["end"]) for r in train.collect()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        t, values, out = pdf["t"].to_numpy(), O.arrays(pdf, by), []
        for fold, a, b in ranges:
            inside = (t >= a) & (t < b)
            for x, qs in by.items():
                own = values[x.name][inside]
                own = own[~np.isnan(own)]
                out += [(fold, x.name, q, float(v)) for q, v in zip(qs, np.quantile(own, qs))] if len(own) else []
        return pd.DataFrame(out, columns=["fold", "x", "q", "v"])

    for r in bars.select("series", "t", "ts", *PRICES).groupBy("series").applyInPandas(run, "fold int, x string, q double, v double").collect():
        folds[r["fold"]][r["x"], r["q"]] = r["v"]
    return folds


def generate(bars: DataFrame, train: DataFrame, plan: Plan) -> tuple[dict[int, list[Node]], dict]:
    """{fold: up to n_simple different conditions} and the counts of draws; the same draws in each fold, whose TRAIN
    sets their thresholds."""
    grammar = Grammar(plan)
    drafts = [grammar.structured() if plan.structured else grammar.simple() for _ in range(plan.n_simple)]
    folds: dict[int, dict[str, Node]] = {}
    attempts, discarded = 0, 0
    while drafts:
        attempts += len(drafts)
        asked = {r for d in drafts for r in _requests(d)}
        known = quantiles(bars, train, asked)
        for fold, values in known.items():
            own = folds.setdefault(fold, {})
            for d in drafts:
                tree = _resolved(d, values, plan.digits)
                discarded += tree.key in own
                if len(own) < plan.n_simple:
                    own.setdefault(tree.key, tree)
        short = max((plan.n_simple - len(x) for x in folds.values()), default=0)
        more = min(2 * short, ATTEMPTS * plan.n_simple - attempts)
        drafts = [grammar.structured() if plan.structured else grammar.simple() for _ in range(more)]
    return {f: list(x.values()) for f, x in folds.items()}, {"attempts": attempts, "discarded_duplicate": discarded}


FOUND = "series string, condition_id string, fold int, segment string, n_raw_signals long, n_dropped_horizon long, n_dropped_cooldown long, entries array<long>"


def entries(features: DataFrame, outcomes: DataFrame, trees: dict[str, tuple[Node, list[int] | None]], segments: DataFrame, horizon: int, cooldown: int | None = None) -> DataFrame:
    """Accepted entries of each condition in each segment, as signal bars, with counters of what was dropped.

    features: bars, with the columns that trees name. trees: condition id to the tree and its folds (None: all).
    outcomes: as of outcomes.build(). One group is one series and up to BATCH trees: it gets the bars and works out the
    operands of its own trees. Entries without valid levels aren't signals.
    """
    spark = features.sparkSession
    ship(spark)
    names = sorted({x for x in operands_of(t for t, _ in trees.values()) if isinstance(x, str)} - set(PRICES))
    after = outcomes.select("series", (F.col("e") - 1).alias("t"), F.col("exit_offset").alias("_off"), F.col("outcome").isNotNull().alias("_ok"))
    columns = [F.col(f"`{n}`").cast("double").alias(n) for n in names]
    rows = features.select("series", "t", "ts", *PRICES, *columns).join(after, ["series", "t"], "left")
    packed = [(cid, json.dumps(to_dict(t)), folds) for cid, (t, folds) in sorted(trees.items())]
    batches = -(-len(packed) // BATCH)
    ranges = [(r["series"] if "series" in segments.columns else None, r["fold"], r["segment"], r["start"], r["end"]) for r in segments.collect()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        batch, series = int(pdf["_batch"].iloc[0]), pdf["series"].iloc[0]
        own_trees = [(cid, from_dict(json.loads(tree)), folds) for cid, tree, folds in packed[batch * BATCH : (batch + 1) * BATCH]]
        t = pdf["t"].to_numpy()
        ok = pdf["_ok"].eq(True).to_numpy(bool)
        free = t + 1 + pdf["_off"].fillna(0).to_numpy(np.int64) if cooldown is None else t + max(cooldown, 1)
        on, out = Arrays({n: pdf[n].to_numpy(float) for n in (*PRICES, *names)} | O.arrays(pdf, operands_of(x for _, x, _ in own_trees))), []
        for cid, tree, folds in own_trees:
            at = np.flatnonzero(on.part(tree)[0])
            for own, fold, segment, a, b in ranges:
                if (own is not None and own != series) or (folds is not None and fold not in folds):
                    continue
                inside = at[(t[at] >= a) & (t[at] < b)]
                fit = inside[t[inside] <= b - 1 - horizon]
                fit = fit[ok[fit]]
                taken = fit[greedy(t[fit], free[fit])]
                dropped = len(inside) - np.count_nonzero(t[inside] <= b - 1 - horizon)
                out.append((series, cid, fold, segment, len(inside), dropped, len(fit) - len(taken), t[taken].tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    if not packed:
        return spark.createDataFrame([], FOUND)
    dealt = rows.withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    return dealt.groupBy("series", "_batch").applyInPandas(run, FOUND)


KEYS = ["series", "condition_id", "fold", "segment"]


def entry_rows(found: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row an entry, with its outcome."""
    each = found.select(*KEYS, F.explode("entries").alias("t")).withColumn("e", F.col("t") + 1)
    return each.join(outcomes.drop("t"), ["series", "e"])


def baseline_rows(outcomes: DataFrame, segments: DataFrame, horizon: int) -> DataFrame:
    """An entry at every bar of a segment that its horizon fits in."""
    rows = outcomes.filter("outcome IS NOT NULL").withColumn("t", F.col("e") - 1)
    return S.assign(rows, segments).filter(F.col("t") <= F.col("end") - 1 - horizon)


def evaluate(found: DataFrame, outcomes: DataFrame, segments: DataFrame, horizon: int, plan: Plan, scenarios=("optimistic", "typical")) -> DataFrame:
    """Condition rows: counters, statistics, lifts, passed and reject_reasons. Conditions without an entry are rows too."""
    own = stats.compute(entry_rows(found, outcomes), KEYS, scenarios)
    base = stats.compute(baseline_rows(outcomes, segments, horizon), ["series", "fold", "segment"], scenarios)
    own = stats.add_lift(own, base, ["series", "fold", "segment"])
    rows = found.drop("entries").join(own, KEYS, "left").fillna(0, ["n_entries"])
    size = F.col("_bars") * plan.fraction
    keys = ["fold", "segment", *(["series"] if "series" in segments.columns else [])]
    lengths = segments.select(*keys, (F.col("end") - F.col("start")).alias("_bars"))
    need = F.greatest(F.lit(plan.least), F.ceil(F.round(size, 6))).cast("long")
    return stats.filters(rows.join(F.broadcast(lengths), keys), need, **plan.bounds).drop("_bars")


def in_segment(segments: DataFrame, name: str) -> DataFrame:
    return segments.filter(F.col("segment") == name)


def run(bars: DataFrame, segments: DataFrame, outcomes: DataFrame, horizon: int, plan: Plan, test: bool = False, given: list[Node] | None = None) -> tuple[DataFrame, dict]:
    """Stage one in TRAIN, the pool, stage two, the filter in TRAIN, then VALIDATION (and TEST if asked for) of what
    passed: condition rows of all of them, and the run's counts. given: trees instead of drawn ones.

    outcomes should be stored: it is read for each stage. Folds are a key: each has its own conditions.
    """
    train = in_segment(segments, "TRAIN")
    counts = {"attempts": 0, "discarded_duplicate": 0}
    if given is None:
        by_fold, counts = generate(bars, train, plan)
    else:
        by_fold = {r["fold"]: given for r in train.select("fold").distinct().collect()}

    def evaluated(by_fold, part):
        trees: dict[str, tuple[Node, list[int]]] = {}
        for fold, own in by_fold.items():
            for tree in own:
                trees.setdefault(condition_id(tree), (tree, []))[1].append(fold)
        found = entries(bars, outcomes, trees, part, horizon, plan.cooldown)
        return trees, evaluate(found, outcomes, part, horizon, plan).withColumn("stage", F.lit(stage))

    stage = 1
    trees, rows = evaluated(by_fold, train)
    counts["n_conditions_evaluated_simple"] = sum(map(len, by_fold.values()))
    rows = rows.cache()
    counts["n_conditions_evaluated_complex"] = 0
    if plan.n_complex:
        best = rows.filter((F.col("lift_P_TP_FIRST") > 0) | (F.col("lift_mean_gross_return") > 0)).filter("n_entries > 0").select("fold", "condition_id", "lift_P_TP_FIRST").collect()
        grammar, deep = Grammar(plan), {}
        order = {(f, condition_id(t)): i for f, own in by_fold.items() for i, t in enumerate(own)}
        for fold in by_fold:
            own = sorted((r for r in best if r["fold"] == fold), key=lambda r: (-r["lift_P_TP_FIRST"], order[fold, r["condition_id"]]))
            deep[fold] = complex_trees(grammar, [trees[r["condition_id"]][0] for r in own[: plan.pool_size]])
        stage = 2
        more, second = evaluated(deep, train)
        trees |= more
        counts["n_conditions_evaluated_complex"] = sum(map(len, deep.values()))
        rows = rows.unionByName(second).cache()
    passed = rows.filter("passed").select("fold", "condition_id").distinct().collect()
    chosen = {f: [trees[r["condition_id"]][0] for r in passed if r["fold"] == f] for f in by_fold}
    counts["n_passed_train"] = len(passed)
    stage = 0
    out = rows
    for name in ("VALIDATION", *(("TEST",) if test else ())):
        part = in_segment(segments, name)
        out = out.unionByName(evaluated(chosen, part)[1])
    return out, counts | {"test_evaluated": test, "trees": {k: t for k, (t, _) in trees.items()}}


def describe(trees) -> list[tuple[str, str, str, int]]:
    return [(condition_id(t), t.key, t.kind, t.depth) for t in trees]


def grid(sides, tps, sls, horizons) -> list[tuple]:
    """All runs of a grid, as (side, tp, sl, horizon)."""
    return [(s, a, b, h) for s in sides for a in tps for b in sls for h in horizons]


def grid_summary(runs: list[tuple[tuple, DataFrame]]) -> DataFrame:
    """A row for each run of a grid: how many conditions passed in each segment and the best lift."""
    out = None
    for (side, tp, sl, horizon), rows in runs:
        one = rows.agg(
            *[F.count_if((F.col("segment") == s) & F.col("passed")).alias(f"passed_{s.lower()}") for s in ("TRAIN", "VALIDATION", "TEST")],
            F.count_if(F.col("segment") == "TRAIN").alias("evaluated"), F.max(F.when(F.col("passed"), F.col("lift_mean_net_return"))).alias("best_lift"),
        ).select(F.lit(side).alias("side"), F.lit(float(tp)).alias("tp"), F.lit(float(sl)).alias("sl"), F.lit(int(horizon)).alias("horizon"), "*")
        out = one if out is None else out.unionByName(one)
    return out
