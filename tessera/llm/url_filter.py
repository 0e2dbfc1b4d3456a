"""URL filters: rules, and a character language-model ratio for the URLs that no rule fits.

Two smoothed variable-order Markov models over the bytes of a URL are counted from the URLs that rules accept
and from those that they reject. Order k's estimate of a byte is mixed with that of order k - 1:
P_k = (n(context, byte) + MASS * P_(k-1)) / (n(context) + MASS), down to the uniform one; an unseen context
leaves P_(k-1) as it is. The score of a URL is the difference of its log-likelihoods (rejected minus accepted)
divided by its number of bytes and the end mark. Its threshold is calibrated on held-out ruled URLs: the one
of the best balanced accuracy.

Every ruled URL is counted, in Spark, and every n-gram keeps its counts, in a staged table that no process gathers.
URLs to score are dealt to slices of SLICE_BYTES; a slice asks the table once for each distinct n-gram of its URLs,
so a frequent n-gram meets as many rows as there are slices, not URLs. What is gathered is two totals and a histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, stage, utf8

ORDER = 5
MASS = 4.0
#: Bytes of URLs that ask for their n-grams together; at most ORDER + 1 n-grams a byte.
SLICE_BYTES = 1 << 20
#: Of five ruled URLs one, by hash, is for the threshold and not counted.
CALIBRATION = 5
#: Bins of the calibration histogram, over scores from -RANGE to RANGE.
BINS, RANGE = 4096, 8.0
START, END = 2, 3

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url):
    """Columns host and path of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def match_rule(host, path, rules):
    """The index of the longest rule (action, host, path) that fits, else null; of equal lengths the first one."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    out = F.lit(None).cast("int")
    for i in reversed(order):
        _, h, p = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def _grams(column):
    """Of a batch of URLs: for each order k, the packed (k + 1)-gram that ends at each place; the row of each
    place; and whether the place is a byte or end mark (the others are the last start mark)."""
    data, offsets = utf8(column)
    lens = np.diff(offsets)
    n = len(lens)
    size = lens + ORDER + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    buf = np.full(begin[-1], START, np.uint64)
    row = np.repeat(np.arange(n), lens)
    buf[np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], lens) + begin[:-1][row] + ORDER] = data[offsets[0] : offsets[-1]]
    buf[begin[1:] - 1] = END
    places = np.flatnonzero(np.arange(begin[-1]) - np.repeat(begin[:-1], size) >= ORDER - 1)
    packed, out = np.zeros(len(places), np.uint64), []
    for k in range(ORDER + 1):
        at = places - k
        packed = packed | (np.where(at >= 0, buf[at], np.uint64(START)) << np.uint64(8 * k))
        out.append(packed | np.uint64((k + 1) << 56))
    rows = np.repeat(np.arange(n), size)[places]
    real = places - begin[:-1][rows] >= ORDER
    return out, rows, real, n


def _count(batches):
    """(url, rejected) to (gram, accepted, rejected), summed over each slice."""
    for batch in batches:
        _, offsets = utf8(batch.column("url"))
        for a, b in slices(offsets, 4 << 20):
            part = batch.slice(a, b - a)
            grams, rows, _, _ = _grams(part.column("url"))
            bad = part.column("rejected").to_numpy(zero_copy_only=False).astype(bool)[rows]
            keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
            n_bad = np.bincount(inverse, np.tile(bad, ORDER + 1), len(keys)).astype(np.int64)
            n_all = np.bincount(inverse, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n_all - n_bad), pa.array(n_bad)], names=["gram", "accepted", "rejected"])


def _sliced(slice_bytes: int):
    """Adds the number of a row's slice: the partition's, and the place of the row's first byte in it."""

    def run(batches):
        begin, base = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            _, offsets = utf8(batch.column("_url"))
            size = offsets - offsets[0] + np.arange(len(offsets)) * (ORDER + 1)  # with marks, so that empty URLs count too
            at = base + (begin + size[:-1]) // slice_bytes
            begin += int(size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "slice"])

    return run


def _asked(batches):
    """(url, slice) to the distinct n-grams (slice, gram); a slice that parts of a batch share may ask twice."""
    for batch in batches:
        numbers = batch.column("slice").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else []
        for a, b in zip(starts, [*starts[1:], len(numbers)]):
            grams = np.unique(np.concatenate(_grams(batch.column("_url").slice(a, b - a))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), numbers[a])), pa.array(grams.astype(np.int64))], names=["slice", "gram"])


class UrlModel:
    """Sorted packed n-grams and their counts in accepted and rejected URLs: all those that the scored URLs have."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, totals: tuple[int, int]):
        self.grams, self.counts, self.totals = grams, counts, totals

    def _counts(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros((2, len(grams)))
        i = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[i] == grams, self.counts[:, i], 0)

    def score(self, column) -> np.ndarray:
        grams, rows, real, n = _grams(column)
        p = np.full((2, len(rows)), 1 / 256)
        context = np.repeat(np.asarray(self.totals, float)[:, None], len(rows), 1)
        for k in range(ORDER + 1):
            own = self._counts(grams[k])
            p = np.where(context > 0, (own + MASS * p) / (context + MASS), p)
            context = np.zeros_like(own)  # of order k + 1: the gram of order k that ends one place before
            same = np.zeros(len(rows), bool)
            same[1:] = rows[1:] == rows[:-1]
            context[:, 1:] = own[:, :-1]
            context[:, ~same] = 0
        ratio = np.log(p[1]) - np.log(p[0])
        ratio[~real] = 0
        return np.bincount(rows, ratio, n) / np.maximum(np.bincount(rows, real, n), 1)


def _score(totals):
    def run(urls: pa.Table, known: pa.Table) -> pa.Table:
        keys = known.column("gram").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        counts = np.stack([known.column(c).to_numpy()[order] for c in ("accepted", "rejected")]).astype(np.float64)
        model, column = UrlModel(keys[order], counts, totals), urls.column("_url").combine_chunks()
        _, offsets = utf8(column)
        scores = [model.score(column.slice(a, b - a)) for a, b in slices(offsets, 1 << 18)]
        return urls.drop_columns(["slice"]).append_column("score", pa.array(np.concatenate([np.zeros(0), *scores])))

    return run


def count(ruled: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """All n-grams of ruled (url, rejected), without nulls, as (gram, accepted, rejected), and the totals of bytes."""
    grams = ruled.mapInArrow(_count, "gram long, accepted long, rejected long")
    grams = stage(grams.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-grams")
    single = (F.shiftright("gram", 56) == 1) & (F.col("gram").bitwiseAND(F.lit(0xFF)) != START)
    sums = grams.filter(single).agg(F.sum("accepted"), F.sum("rejected")).first()
    return grams, tuple(float(x or 0) for x in sums)


def score(urls: DataFrame, grams: DataFrame, totals: tuple[int, int], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """urls, which has a column _url, with a column score."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    dealt = stage(urls.mapInArrow(_sliced(slice_bytes), f"{types}, slice long"), "url-slices")
    asked = dealt.select("_url", "slice").mapInArrow(_asked, "slice long, gram long")
    known = asked.join(grams, "gram").select("slice", "gram", "accepted", "rejected")
    return dealt.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(_score(totals), f"{types}, score double")


def threshold_of(held: DataFrame) -> float:
    """The threshold of the best balanced accuracy on held (rejected, score); 0 where one side has no rows."""
    bin_of = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + RANGE) * (BINS / (2 * RANGE)))))
    hist = np.zeros((2, BINS))
    for r in held.groupBy("rejected", bin_of.alias("bin")).count().collect():
        hist[int(r["rejected"]), r["bin"]] = r["count"]
    sums = hist.sum(1)
    if not sums.all():
        return 0.0
    passed = hist[0].cumsum() / sums[0] + 1 - hist[1].cumsum() / sums[1]  # of a threshold at each bin's upper end
    best = np.flatnonzero(passed >= passed.max() - 1e-12)
    return float((best[len(best) // 2] + 1) * (2 * RANGE / BINS) - RANGE)


def url_filter(df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of df: id, host, path, rule, verdict and score.

    rules: (allow or block, host, path); a rule fits its host and all subdomains if the path starts with its
    own, and the longest one wins. Without a rule the verdict is the models': block where score is above the
    threshold; score is null where a rule decides. A null URL, or one without "://", has an empty host and
    path; a null one scores as an empty one. If rules accept or reject no URL, models say nothing: allow.
    Repeated rows are judged alike, and URLs of any length whole; a score that equals the threshold is allowed; an empty df gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    base = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = split_url(F.col("_url"))
    rule = match_rule(F.col("host"), F.col("path"), rules)
    base = base.select("_id", "_url", host.alias("host"), path.alias("path")).withColumn("_rule", rule)
    blocked = F.array(*[F.lit(a == "block") for a, _, _ in rules]) if rules else F.array().cast("array<boolean>")
    base = base.withColumn("_blocked", F.get(blocked, F.col("_rule")))
    fold = F.pmod(F.crc32(F.col("_url").cast("binary")), F.lit(CALIBRATION))
    learned_from = base.filter("_rule is not null and _url is not null")
    grams, totals = count(learned_from.filter(fold != 0).select(F.col("_url").alias("url"), F.col("_blocked").alias("rejected")))
    columns = ["_id", "host", "path", "_url"]
    # held-out ruled URLs and those without a rule are scored together; only the former have a value in rejected
    held = learned_from.filter(fold == 0).select(F.lit(None).cast(base.schema["_id"].dataType).alias("_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "_url", F.col("_blocked").alias("rejected"))
    free = base.filter("_rule is null").select(*columns, F.lit(None).cast("boolean").alias("rejected"))
    scored = stage(score(held.unionByName(free), grams, totals).drop("_url"), "url-scores")
    threshold = threshold_of(scored.filter("rejected is not null"))
    names = F.array(*[F.lit(h + p) for _, h, p in rules]) if rules else F.array().cast("array<string>")
    ruled = base.filter("_rule is not null").select(F.col("_id"), "host", "path", F.get(names, F.col("_rule")).alias("rule"), F.when(F.col("_blocked"), "block").otherwise("allow").alias("verdict"), F.lit(None).cast("double").alias("score"))
    block = (F.col("score") > threshold) if all(totals) else F.lit(False)
    free = scored.filter("rejected is null").select("_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"), "score")
    return ruled.unionByName(free).withColumnRenamed("_id", id_col)
