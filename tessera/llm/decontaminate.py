"""Benchmark decontamination with an FM-index per training shard.

A shard (a slice of a task's documents, bounded in bytes) becomes one sequence of word numbers. Words that
no benchmark item has can't be part of a match, so they only part the sequence into runs, and runs shorter
than the shortest window are left out. The sequence's suffix array gives its Burrows-Wheeler transform, kept
as a wavelet matrix. All benchmark windows are backward-searched in it together, each step two wavelet ranks;
occurrences are located by walking back to sampled suffix positions, and their spans are merged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD_CHAR, ship, slices, stage, utf8, words

WINDOW = 13
#: Bytes of text of a shard.
SHARD_BYTES = 2 << 20
#: Every so many positions of the sequence one is kept for locating.
SAMPLE = 16
#: Benchmark bytes that one pass broadcasts; a larger benchmark takes more passes.
BENCHMARK_BYTES = 16 << 20


class FMIndex:
    """Over a sequence of symbols from 1 on, with 0 between runs and at the end."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.n, self.sigma = n, int(text.max(initial=0)) + 1
        order = suffix_order(text)
        self.bwt_levels(text[order - 1], max(1, int(self.sigma - 1).bit_length()))
        counts = np.bincount(text, minlength=self.sigma)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # rows that start with a smaller symbol
        starts_run = np.ones(n, bool)  # position 0 and those after a separator: the walk back can't pass one
        starts_run[1:] = text[:-1] == 0
        kept = starts_run[order] | (order % SAMPLE == 0)
        self.sampled, self.rank_of = kept, np.cumsum(kept) - 1
        self.positions = order[kept]

    def bwt_levels(self, bwt: np.ndarray, depth: int) -> None:
        """The wavelet matrix: for each bit, the highest first, the ranks of ones and the number of zeros."""
        self.depth, self.ranks, self.zeros, self.bits = depth, [], [], []
        cur = bwt
        for level in range(depth - 1, -1, -1):
            bit = (cur >> level) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            self.bits.append(bit.astype(bool))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        symbols = np.arange(self.sigma)
        self.first = self._down(symbols, np.zeros(self.sigma, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.depth - 1, -1, -1)):
            ones = self.ranks[k][at].astype(np.int64)
            at = np.where((symbols >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbols[i] in the first at[i] places of the transform."""
        return self._down(symbols, at) - self.first[symbols]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbols = np.zeros(len(at), np.int64)
        for k in range(self.depth):
            bit, ones = self.bits[k][at], self.ranks[k][at].astype(np.int64)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            symbols = symbols * 2 + bit
        return symbols

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges of patterns, a row of symbols each; empty where there is no occurrence."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero((patterns < self.sigma).all(1))
        out_lo, out_hi = lo * 0, lo * 0
        lo, hi = lo[alive], hi[alive]
        for col in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, col]
            lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            some = hi > lo
            alive, lo, hi = alive[some], lo[some], hi[some]
        out_lo[alive], out_hi[alive] = lo, hi
        return out_lo, out_hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows of the suffix array."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            c = self.access(rows[todo])
            rows[todo] = self.before[c] + self.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.positions[self.rank_of[rows]] + steps


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of text in order, by doubling; separators (0) are smallest and differ from each other."""
    n = len(text)
    separators = text == 0
    rank = text + int(separators.sum())
    rank[separators] = np.arange(int(separators.sum()))
    order, width = np.argsort(rank, kind="stable"), 1
    rank = _ranks(order, rank[order])
    while True:
        # only groups that still share a rank are sorted on
        size = np.bincount(rank, minlength=n)
        open_rows = np.flatnonzero(size[rank[order]] > 1)
        if not len(open_rows):
            return order
        at = order[open_rows]
        then = at + width
        second = np.where(then < n, rank[np.minimum(then, n - 1)], -1)
        key = rank[at] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[open_rows] = at[by]
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], rank[at[by]][1:] != rank[at[by]][:-1]])
        # ranks are the row of a group's first member
        rank[at[by]] = np.maximum.accumulate(np.where(new | group, open_rows, 0))
        width *= 2


def _ranks(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(keys) else 0
    return rank


class Benchmark:
    """Items as windows of word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        texts = pa.array([t or "" for _, t in items], pa.string())
        data, offsets = utf8(texts)
        hashes, _, _, rows = words(LOWER[data[: offsets[-1]]], offsets, WORD_CHAR)
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes) + 1
        found: dict[tuple, set] = {}
        for i, (name, _) in enumerate(items):
            own = numbers[np.searchsorted(rows, i) : np.searchsorted(rows, i, side="right")].tolist()
            for k in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[k : k + window]), set()).add(name)
        by_length: dict[int, list] = {}
        for w in found:
            by_length.setdefault(len(w), []).append(w)
        self.patterns = {n: (np.asarray(ws, np.int64), [found[w] for w in ws]) for n, ws in by_length.items()}
        self.shortest = min(self.patterns, default=0)


def _shard(bench: Benchmark, data: np.ndarray, offsets: np.ndarray):
    """Of a shard's documents: number of words, hit words, spans of bytes and items."""
    n_docs = len(offsets) - 1
    hashes, starts, ends, rows = words(LOWER[data], offsets, WORD_CHAR)
    n_words = np.bincount(rows, minlength=n_docs)
    items: list[set] = [set() for _ in range(n_docs)]
    hit = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) and bench.shortest:
        i = np.minimum(np.searchsorted(bench.vocabulary, hashes), len(bench.vocabulary) - 1)
        number = np.where(bench.vocabulary[i] == hashes, i + 1, 0)
        brk = np.ones(len(hashes), bool)
        brk[1:] = (number[1:] == 0) | (number[:-1] == 0) | (rows[1:] != rows[:-1])
        run = np.cumsum(brk) - 1
        length = np.bincount(run)
        kept = np.flatnonzero((number > 0) & (length[run] >= bench.shortest))
        if len(kept):
            # a separator after each run; place: the word of each position
            last = np.concatenate([run[kept][1:] != run[kept][:-1], [True]])
            at = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(last)[:-1]])
            text = np.zeros(at[-1] + 2, np.int64)
            text[at] = number[kept]
            place = np.full(len(text), -1, np.int64)
            place[at] = kept
            index = FMIndex(text)
            for n, (patterns, names) in bench.patterns.items():
                lo, hi = index.search(patterns)
                some = np.flatnonzero(hi > lo)
                count = (hi - lo)[some]
                which = np.repeat(some, count)
                first = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                word = place[index.locate(first)]
                np.add.at(hit, word, 1)
                np.add.at(hit, word + n, -1)
                pairs = np.unique(np.stack([rows[word], which]), axis=1) if len(word) else np.zeros((2, 0), int)
                for d, w in pairs.T.tolist():
                    items[d] |= names[w]
    covered = np.cumsum(hit)[:-1] > 0
    n_hit = np.bincount(rows[covered], minlength=n_docs) if len(rows) else np.zeros(n_docs, int)
    spans: list[list] = [[] for _ in range(n_docs)]
    at = np.flatnonzero(covered)
    if len(at):
        first = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (rows[at[1:]] != rows[at[:-1]])])
        stops = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(at) - 1]])
        for a, b in zip(at[first].tolist(), at[stops].tolist()):
            d = int(rows[a])
            spans[d].append({"start": int(starts[a] - offsets[d]), "end": int(ends[b] - offsets[d])})
    return n_words, n_hit, spans, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(shared):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, SHARD_BYTES):
                part = offsets[a : b + 1] - offsets[a]
                n_words, n_hit, spans, items = _shard(shared.value, data[offsets[a] : offsets[b]], part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["_id", "n_words", "n_hit", "spans", "items"],
                )

    return run


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))


def _blocks(items: DataFrame, block_bytes: int) -> int:
    return int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """One row per row of df: id, n_words, n_hit, spans (merged, of UTF-8 bytes of the text) and items (sorted ids
    as strings, of items with a window in the document).

    Words are runs of ASCII digits, a-z (A-Z lower-cased) and all that is not ASCII. A window is window
    consecutive words of an item, or all words of a shorter item. Null texts have no words; items without an id
    or words are ignored; rows of one item id count as one item. An empty benchmark hits nothing, an empty df
    gives no rows. A benchmark of over block_bytes is searched in blocks, one pass each, over staged rows with keys of
    their own, so null and repeated ids give the same rows as in one block. Texts of any length are searched whole.
    """
    spark = df.sparkSession
    ship(spark)
    items = _items(benchmark, item_col, item_text)
    blocks = _blocks(items, block_bytes)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    kind = docs.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n_words long, n_hit long, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    rows = docs
    if blocks > 1:
        keyed = stage(docs.withColumn("_key", F.monotonically_increasing_id()), "decontaminate-docs")
        rows = keyed.select(F.col("_key").alias("_id"), "text")
    found = []
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
        found.append(rows.mapInArrow(_search(spark.sparkContext.broadcast(Benchmark([tuple(r) for r in own], window))), schema if blocks == 1 else schema.replace(f"_id {kind}", "_id long", 1)))
    if blocks == 1:
        return found[0].withColumnRenamed("_id", id_col)
    return _merged(found, keyed, schema).withColumnRenamed("_id", id_col)


def _merged(found: list[DataFrame], keyed: DataFrame, schema: str) -> DataFrame:
    """The blocks' results (_id: the row's _key) of a row in one: spans and hit words of the union."""

    def words_of(batches):
        for batch in batches:
            hits, spans = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = np.frombuffer((text or "").encode(), np.uint8)
                _, starts, ends, _ = words(LOWER[data], np.array([0, len(data)]), WORD_CHAR)
                # in words, as spans of consecutive words are one
                merged: list[list[int]] = []
                for a, b in sorted((int(np.searchsorted(starts, x["start"])), int(np.searchsorted(starts, x["end"]))) for x in own):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                hits.append(sum(b - a for a, b in merged))
                spans.append([{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(spans, _SPANS), batch.column("items")], names=["_id", "n_words", "n_hit", "spans", "items"]
            )

    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    union = union.groupBy(F.col("_id").alias("_key")).agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return keyed.join(union, "_key").select("_id", "text", "n_words", "spans", "items").mapInArrow(words_of, schema)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of df, with all their columns, that aren't contaminated(). With a benchmark in one block the texts pass once and aren't shuffled."""
    spark = df.sparkSession
    ship(spark)
    items = _items(benchmark, "item_id", "text")
    if _blocks(items, block_bytes) == 1:
        shared = spark.sparkContext.broadcast(Benchmark([tuple(r) for r in items.collect()], window))

        def run(batches):
            for batch in batches:
                data, offsets = utf8(batch.column(text_col))
                for a, b in slices(offsets, SHARD_BYTES):
                    n_words, n_hit, _, _ = _shard(shared.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    yield batch.slice(a, b - a).filter(pa.array((n_hit == 0) | (20 * n_hit < n_words)))

        return df.mapInArrow(run, df.schema)
    keyed = stage(df.withColumn("_row_key", F.monotonically_increasing_id()), "decontaminate-rows")
    gone = find(keyed.select("_row_key", F.col(text_col).alias("text")), benchmark, id_col="_row_key", window=window, block_bytes=block_bytes).filter(contaminated())
    return keyed.join(gone.select("_row_key"), "_row_key", "left_anti").select(*df.columns)


def contaminated():
    """At least one word, and at least a twentieth of the words, is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


#: DuckDB's form of the query op6.
SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
        FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
m AS (SELECT p.doc_id, p.i, x.n, array_to_string(list_slice(p.w, p.i, p.i + x.n - 1), ' ') AS g
      FROM p, (SELECT DISTINCT n FROM win) x WHERE p.i + x.n - 1 <= len(p.w)),
o AS (SELECT m.doc_id, m.i, m.n, win.item FROM m JOIN win ON m.n = win.n AND m.g = win.g),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
