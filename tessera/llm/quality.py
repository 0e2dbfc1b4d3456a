"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are n-grams of its shape (runs of character classes) and binned statistics (repeated words and
lines, lengths, shares of characters), so that they carry over between languages. The terms of a bounded
sample of labelled documents give inverse document frequencies and, by singular value decomposition, the
latent space. Their vectors and labels are broadcast, at most SAMPLE * RANK floats. Each document is compared
with all of them in blocks, by exact cosine products; its nearest neighbours vote, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, fold_of, held_out, mix, ship, slices, utf8, words

#: Labelled documents that the classifier is fitted on, at most: those of the smallest hashes.
SAMPLE = 8192
RANK = 64
NEIGHBOURS = 32
SHAPES = 1024
BINS = 12
STATS = 10
TERMS = SHAPES + STATS * BINS
#: A statistic's term against one shape n-gram.
STAT_WEIGHT = 0.35
#: Power of a similarity in a vote: near neighbours count more.
SHARPNESS = 8
THRESHOLD = 0.7

#: Character classes of bytes: lower 0 (also what is not ASCII), upper 1, digit 2, space 3, line end 4, others their own.
CLASS = np.zeros(256, np.int64)
CLASS[:128] = 5 + np.arange(128) % 128
CLASS[97:123] = 0
CLASS[65:91] = 1
CLASS[48:58] = 2
CLASS[[9, 11, 12, 32]] = 3
CLASS[[10, 13]] = 4
NOT_LINE = np.ones(256, bool)
NOT_LINE[[10, 13]] = False


def _shares(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of keys and the share of them that repeat an earlier one of the row."""
    count = np.bincount(rows, minlength=n)
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    return count, np.bincount(r[again], minlength=n) / np.maximum(count, 1)


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term weights of each row, before inverse document frequencies."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    out = np.zeros((n, TERMS), np.float32)
    row = np.repeat(np.arange(n), lens)
    cls = CLASS[data]
    change = np.ones(len(cls), bool)
    change[1:] = (cls[1:] != cls[:-1]) | (row[1:] != row[:-1])
    c, r = cls[change], row[change]
    for width in (1, 2, 3):
        if len(c) >= width:
            code = np.zeros(len(c) - width + 1, np.int64)
            for k in range(width):
                code = code * 140 + c[k : len(c) - width + 1 + k] + 1
            inside = r[: len(code)] == r[width - 1 :]
            cell = r[: len(code)][inside] * SHAPES + (mix(code[inside].astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
            out[:, :SHAPES] += np.bincount(cell, minlength=n * SHAPES).reshape(n, SHAPES)
    shapes = np.log1p(out[:, :SHAPES])
    out[:, :SHAPES] = shapes / np.maximum(np.linalg.norm(shapes, axis=1, keepdims=True), 1e-9)

    h, s, e, w_rows = words(data, offsets, NOT_SPACE)
    n_words, repeated = _shares(h.view(np.int64), w_rows, n)
    lh, _, _, l_rows = words(data, offsets, NOT_LINE)
    n_lines, repeated_lines = _shares(lh.view(np.int64), l_rows, n)
    twice = np.zeros(len(h), bool)
    twice[1:] = (h[1:] == h[:-1]) & (w_rows[1:] == w_rows[:-1])
    share = lambda mask: np.bincount(row[mask], minlength=n) / np.maximum(lens, 1)
    length = np.bincount(w_rows, e - s, n) / np.maximum(n_words, 1)
    ascii_other = (cls >= 5) & ~np.isin(data, np.frombuffer(b".,", np.uint8))
    stats = [
        repeated, repeated_lines, np.bincount(w_rows[twice], minlength=n) / np.maximum(n_words, 1), np.minimum(np.log2(1 + n_words) / 15, 1), np.minimum(length / 16, 1),
        np.sqrt(share(cls == 1)), np.sqrt(share(cls == 2)), np.sqrt(share(ascii_other)), np.minimum(n_lines / np.maximum(n_words, 1), 1), np.sqrt(share(np.isin(data, np.frombuffer(b".,", np.uint8)))),
    ]
    for k, x in enumerate(stats):  # each value is shared between the two nearest bins
        at = np.clip(x, 0, 1) * (BINS - 1)
        low = np.minimum(at.astype(int), BINS - 2)
        base = SHAPES + k * BINS
        out[np.arange(n), base + low] = STAT_WEIGHT * (1 - (at - low))
        out[np.arange(n), base + low + 1] = STAT_WEIGHT * (at - low)
    return out


class Voter:
    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        df = (x > 0).sum(0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 1
        self.idf[SHAPES:] = 1
        y = x * self.idf
        values, vectors = np.linalg.eigh(y.T @ y) if len(x) else (None, np.zeros((TERMS, 0)))
        self.basis = vectors[:, ::-1][:, :RANK].astype(np.float32)
        self.vectors = self.embed(x)

    def embed(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(x), self.prior)
        out, k = np.zeros(len(x)), min(NEIGHBOURS, len(self.vectors))
        v = self.embed(x)
        for a in range(0, len(x), block):
            cosine = v[a : a + block] @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS + 1e-6
            out[a : a + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def _features(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets, 1 << 20):
            x = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["label", "terms"])


def _score(shared):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, 1 << 20):
                x = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("held_out"), pa.array(shared.value.score(x), pa.float64())], names=["_id", "held_out", "score"])

    return run


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Voter:
    """Of the labelled ids outside the held-out fold those of the smallest hashes, sample at most. Labels that an id
    repeats are averaged, and half or more counts as 1; documents that repeat an id give their smallest text."""
    spark = df.sparkSession
    ship(spark)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(id_col) != 2))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample)
    docs = df.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    # rows that repeat an id give one text, the smallest, so that no more than the sample is gathered
    texts = docs.join(F.broadcast(known), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    found = texts.select("label", "text").mapInArrow(_features, "label int, terms binary").toArrow()
    x = np.frombuffer(b"".join(found.column("terms").to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    return Voter(x, found.column("label").to_numpy())


def score(df: DataFrame, voter: Voter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, held_out, score and predicted (1 if score >= THRESHOLD).

    A null text counts as empty; an empty text is scored by its statistics' terms like any other, and without
    labelled documents every score is 0.5. A null id is not held out. Repeated rows score alike, texts of any length are
    read whole, and of neighbours that tie at the border any may vote. An empty df gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = docs.schema["_id"].dataType.simpleString()
    out = docs.mapInArrow(_score(spark.sparkContext.broadcast(voter)), f"_id {kind}, held_out boolean, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
