"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by (source, exact length). A source's budget is first spent on whole copies of the
source, then, but for a reserve of twice the longest document, on the same share of each length, fractions carried
from length to length. What remains, less than three of the longest documents, is spent by bounded-knapsack dynamic
programming over all lengths' remaining counts. Each length's count is then drawn by a seeded hash. Only (id, source,
length) rows and counts are shuffled, never texts.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage

#: The dynamic programming's part of a budget, in longest documents.
RESERVE = 2
#: Rows that one task ranks; a larger group is first cut at the borders of hash buckets of about this size.
RANKED = 1024
#: Groups that may hold a large share of the rows are joined by broadcast, this many at most.
HOT = 1024
#: Rows of (id, source, size, counts) that are broadcast, at most.
BROADCAST_ROWS = 1 << 19
WEIGHTS = (5, 2, 1)
CAP = 3


def words_of(text):
    """Words between ASCII white space, 0 of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict, weights=WEIGHTS, cap: float = CAP) -> dict:
    """Target of each source: 100 % of all sizes by weight, none above cap times its size, the excess reshared
    by weight. Sources by code point, null last, get the weights in turn."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, sum(sizes.values()), list(names)
    while free:
        total = sum(weight[s] for s in free)
        capped = [s for s in free if left * weight[s] > cap * sizes[s] * total]
        if not capped:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: float(cap * sizes[s]) for s in capped}
        left -= sum(cap * sizes[s] for s in capped)
        free = [s for s in free if s not in out]
    return out


def fit_counts(lengths: list[int], counts: list[int], budget: int, seed: str = "") -> list[int]:
    """How many documents of each length to take so that the lengths' sum comes as near below budget as can be
    found: an equal share of each, then a knapsack over the rest. lengths: positive, different."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    shared, carry, take = max(0, budget - RESERVE * max(lengths)), 0, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        # counts * length * shared / total words for this length, in units of 1 / total
        carry += counts[i] * lengths[i] * shared
        take[i], carry = divmod(carry, lengths[i] * total)
    left = budget - sum(n * t for n, t in zip(lengths, take))
    order = list(range(len(lengths)))
    random.Random(f"{seed}/{budget}").shuffle(order)
    # Bounded knapsack: bit w of reach says that w can be made; counts are split into powers of two.
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in order:
        free, part = min(counts[i] - take[i], left // lengths[i]), 1
        while free > 0 and not reach >> left & 1:
            part = min(part, free)
            steps.append((i, part, reach))
            reach |= reach << (part * lengths[i]) & mask
            free, part = free - part, part * 2
    best = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> best & 1:
            take[i] += part
            best -= part * lengths[i]
    return take


def mix(df: DataFrame, seed: int = 7, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of df: id, size, source_size, target, taken and copies.

    size: words between ASCII white space, 0 for a null text. Null is a source, the last. A source without words
    has target 0. A document is taken copies times, from 0 to cap. Draws depend on seed, id and counts alone, so
    reruns agree; rows that repeat an id and size are interchangeable. Texts of any length are counted whole. An empty df gives no rows. The driver
    gets one row a source; a task gets one row for each length of a source.
    """
    spark = df.sparkSession
    ship(spark)
    size = words_of(F.col(text_col))
    rows = stage(
        df.select(F.col(id_col).alias("_id"), F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"), size.alias("size")), "mix-sizes"
    ).withColumn("_hash", F.xxhash64(F.lit(seed), F.col("_id").cast("string")))
    key = ["_none", "_source", "size"]
    hist = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    sizes = {None if r["_none"] else r["_source"]: r["s"] for r in hist.groupBy("_none", "_source").agg(F.sum(F.col("_n") * F.col("size")).alias("s")).collect()}
    goal = targets(sizes, weights, cap)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        source = None if pdf["_none"].iloc[0] else pdf["_source"].iloc[0]
        target, total = goal[source], sizes[source]
        pdf = pdf.sort_values("size")
        some = pdf["size"] > 0
        whole = min(math.floor(round(target) / total), cap) if total else 0
        budget = round(target) - whole * total if whole < cap else 0
        pdf = pdf.assign(_whole=whole, _take=0, target=float(target), source_size=total)
        pdf.loc[some, "_take"] = fit_counts(pdf["size"][some].tolist(), pdf["_n"][some].tolist(), budget, f"{seed}/{source}") if budget else 0
        return pdf[[*key, "_n", "_whole", "_take", "target", "source_size"]]

    plans = stage(hist.groupBy("_none", "_source").applyInPandas(plan, "_none boolean, _source string, size long, _n long, _whole long, _take long, target double, source_size long"), "mix-plan")
    hot = plans.orderBy(F.desc("_n"), *key).limit(HOT)
    marked = rows.join(F.broadcast(hot), key, "left")
    known = marked.filter("_n is not null").unionByName(rows.join(plans.join(F.broadcast(hot.select(*key)), key, "left_anti"), key))
    # Draw _take of _n by hash. Whole buckets below the border are drawn, those above aren't, the border's rows are ranked.
    known = known.withColumn("_bucket", F.pmod(F.shiftright("_hash", 8), F.greatest(F.lit(1), F.ceil(F.col("_n") / RANKED)).cast("bigint")))
    drawn = known.filter("_take > 0 and _take < _n")
    buckets = drawn.filter(f"_n > {RANKED}").groupBy(*key, "_bucket").agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.withColumn("_before", F.coalesce(before, F.lit(0)))
    large = drawn.filter(f"_n > {RANKED}").join(buckets, [*key, "_bucket"])
    small = drawn.filter(f"_n <= {RANKED}").withColumn("_m", F.col("_n")).withColumn("_before", F.lit(0).cast("bigint"))
    placed = large.unionByName(small)
    inside = placed.filter("_before < _take and _before + _m > _take")
    rank = F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy("_hash", "_id"))
    ranked = inside.withColumn("_in", (rank <= F.col("_take") - F.col("_before")).cast("bigint"))
    clear = placed.filter("NOT (_before < _take and _before + _m > _take)").withColumn("_in", (F.col("_before") < F.col("_take")).cast("bigint"))
    even = known.filter("NOT (_take > 0 and _take < _n)").withColumn("_in", (F.col("_take") > 0).cast("bigint"))
    cols = ["_id", "size", "source_size", "target", "_whole", "_in"]
    out = ranked.select(*cols).unionByName(clear.select(*cols)).unionByName(even.select(*cols))
    copies = F.col("_whole") + F.col("_in")
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def take(df: DataFrame, seed: int = 7, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df as often as the mix takes them, from never to cap times; those without words go.

    Rows that repeat an id, source and size share the copies that the mix has for them, none more than one above
    another. Texts are only shuffled where the mix takes over BROADCAST_ROWS documents.
    """
    plan = mix(df.withColumn("_mix_id", F.struct(id_col, source_col)), seed, weights, cap, "_mix_id", text_col, source_col).filter("size > 0")
    key = {"_mix_key": F.col(f"_mix_id.{id_col}"), "_mix_source": F.col(f"_mix_id.{source_col}"), "_mix_size": F.col("size")}
    plan = plan.groupBy(*[c.alias(k) for k, c in key.items()]).agg(F.count("*").alias("_mix_rows"), F.sum("copies").alias("_mix_copies"))
    plan = stage(plan.filter("_mix_copies > 0"), "mix-taken")
    few = plan.count() <= BROADCAST_ROWS
    rows = df.withColumn("_mix_words", words_of(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("_mix_key")) & F.col(source_col).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_words") == F.col("_mix_size"))
    rows = rows.join(F.broadcast(plan) if few else plan, same)
    rest = F.col("_mix_copies") % F.col("_mix_rows")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed), text_col), text_col))
    each = F.floor(F.col("_mix_copies") / F.col("_mix_rows")).cast("int")
    even = rows.filter(rest == 0).withColumn("_mix_n", each)
    odd = rows.filter(rest > 0).withColumn("_mix_n", each + (rank <= rest).cast("int"))
    both = even.unionByName(odd).filter("_mix_n > 0")
    return both.withColumn("_mix_k", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*df.columns)
