"""Token-ID output as directly addressable codes.

An id is split into chunks of 8 bits, the lowest first. Level k of a segment holds the k-th chunk of the ids
that have one, and a bitmap whose i-th bit says that the i-th of these ids goes on in level k + 1. The place
of a chunk in the next level is the number of set bits before it: a rank directory holds that number for
every RANK_BITS bits, so that access to any token takes one look-up and one popcount a level, and no block is
decoded.

File format: Parquet rows, one a segment (at least one document, up to SEGMENT_TOKENS ids unless one document
has more): bucket, seq (order of segments), n_tokens, doc_ids and doc_lens (in order), and levels, an array of
(n, chunks, cont, ranks) with little-endian content. Spark's own committer writes the files into the shared
folder, so lost executors leave no half-written file behind.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ship, slices, span_hashes, stage_path, utf8

SEGMENT_TOKENS = 1 << 18
RANK_BITS = 512
#: Text bytes of a bucket, the range of documents that one task writes.
BUCKET_BYTES = 16 << 20
#: Buckets at most; beyond, they hold more bytes. Their tasks then sort more, by spilling, and stream segments as before.
BUCKETS = 100_000
END_ID = 1
#: Pieces of which the ids are kept, for each Python worker, at about 40 bytes.
CACHE_PIECES = 400_000
#: Text bytes that are cut into pieces at once; each takes about 100 bytes of working arrays.
SLICE_BYTES = 1 << 18

SEGMENT_SCHEMA = (
    "bucket long, seq long, n_tokens long, doc_ids array<bigint>, doc_lens array<bigint>, "
    "levels array<struct<n: bigint, chunks: binary, cont: binary, ranks: binary>>"
)
_LEVEL = pa.struct([("n", pa.int64()), ("chunks", pa.binary()), ("cont", pa.binary()), ("ranks", pa.binary())])
_SEGMENT = pa.schema(
    [("bucket", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("levels", pa.list_(_LEVEL))]
)

# --- the codes -----------------------------------------------------------------------------------


def dac_encode(ids: np.ndarray) -> list[dict]:
    """The levels of ids, non-negative integers below 2^32."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        more = rest > 0xFF
        cont = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
        levels.append({"n": len(rest), "chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "cont": cont.tobytes(), "ranks": ranks.astype("<u4").tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def dac_access(levels: list[dict], i: int) -> int:
    """The i-th id, from one byte of chunks and one popcount a level."""
    value = 0
    for k, level in enumerate(levels):
        value |= level["chunks"][i] << (8 * k)
        if not level["cont"][i >> 3] >> (i & 7) & 1:
            return value
        block = i // RANK_BITS
        start = block * RANK_BITS // 8
        rank = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        bits = int.from_bytes(level["cont"][start : (i >> 3) + 1], "little")
        i = rank + (bits & ((1 << (i - block * RANK_BITS)) - 1)).bit_count()
    raise ValueError("the last level says that an id goes on")


def dac_decode(levels: list[dict]) -> np.ndarray:
    """All ids, as unsigned 32-bit integers."""
    value = np.zeros(0, np.uint32)
    for level in reversed(levels):
        own = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["cont"], np.uint8), count=level["n"], bitorder="little").astype(bool)
        own[more] |= value << np.uint32(8)
        value = own
    return value


# --- encoding of texts ---------------------------------------------------------------------------

#: The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

#: Kinds of bytes after lower-casing: 0 white space, 1 letters (the bytes of Latin-1 letters too), 2 digits, 3 others.
PIECE_KIND = np.full(256, 3, np.uint8)
PIECE_KIND[[*range(0x09, 0x0E), 0x20]] = 0
PIECE_KIND[97:123] = PIECE_KIND[128:] = 1
PIECE_KIND[48:58] = 2

_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts through the tokenizers library, each piece once, and remembers the ids of pieces.

    For tokenizers that lower letters, drop white space and part texts into runs of letters, single digits and
    runs of other signs: these pieces go to the library's BPE model, and a text's ids are those of its pieces
    in order. Probes at the start tell whether the tokenizer is of this kind. Texts with signs for which more
    is to be known (apostrophes of contractions, < of special tokens, characters beyond Latin-1 letters) and
    other tokenizers' texts go through the whole tokenizer. Tests compare both ways.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = all(
            [i for w in split for i in self._model_ids(w.encode())] == self.tokenizer.encode(text, add_special_tokens=False).ids
            for text, split in (("Thing, and\nOTHER ##", ("thing", ",", "and", "other", "##")), ("DÉJÀ über-ñ", ("déjà", "über", "-", "ñ")), ("a 12%", ("a", "1", "2", "%")), ("\x01.", ("\x01.",)))
        )
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _model_ids(self, piece: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(BYTE_LEVEL))]

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """hashes: sorted and unknown, one for each piece."""
        if len(self.hashes) + len(hashes) > CACHE_PIECES:
            self.forget()
        found = [self._model_ids(p) for p in pieces]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum()))])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts, self.counts = np.insert(self.hashes, at, hashes), np.insert(self.starts, at, starts), np.insert(self.counts, at, counts)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return i, self.hashes[i] == hashes

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> list[np.ndarray]:
        """The ids of each row of data, with end_id at the end."""
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        after_c3 = np.zeros(len(data), bool)
        after_c3[1:] = data[:-1] == 0xC3
        odd = (data == 0x27) | (data == 0x3C) | ((data >= 0x80) & (data != 0xC3) & ~after_c3) | (after_c3 & ((data == 0x97) | (data == 0xB7)))
        whole = np.bincount(row[odd], minlength=n) > 0 if self.plain else np.ones(n, bool)
        low = LOWER[data]
        low[after_c3 & (data >= 0x80) & (data <= 0x9E)] += 0x20
        kind = PIECE_KIND[low]
        cut = np.ones(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (row[1:] != row[:-1])
        bounds = np.flatnonzero(cut)
        ends = np.append(bounds[1:], len(data))
        keep = (kind[bounds] > 0) & ~whole[row[bounds]]
        bounds, ends = bounds[keep], ends[keep]
        ids, counts, flat = [], np.zeros(0, np.int64), np.zeros(0, np.uint32)
        if len(bounds):
            hashes, first, inverse = np.unique(span_hashes(low, bounds, ends), return_index=True, return_inverse=True)
            i, known = self._find(hashes)
            if not known.all():
                if len(self.hashes) + np.count_nonzero(~known) > CACHE_PIECES:
                    self.forget()
                    known[:] = False
                raw = low.tobytes()
                self._learn(hashes[~known], [raw[a:b] for a, b in zip(bounds[first[~known]].tolist(), ends[first[~known]].tolist())])
                i, _ = self._find(hashes)
            at = i[inverse]
            counts = self.counts[at]
            flat = self.ids[np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        per_row = np.bincount(row[bounds], counts, n).astype(np.int64) if len(bounds) else np.zeros(n, np.int64)
        stops = np.cumsum(per_row)
        for k in range(n):
            if whole[k]:
                own = np.asarray(self.tokenizer.encode(data[offsets[k] : offsets[k + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            else:
                own = flat[stops[k] - per_row[k] : stops[k]]
            ids.append(np.append(own, np.uint32(end_id)))
        return ids


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _encode_batches(path: str, end_id: int, edges: np.ndarray):
    """Arrow batches (doc_id, text) to (bucket, doc_id, n_tokens, ids); bucket: the number of edges not above the id."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, SLICE_BYTES):
                part = batch.slice(a, b - a)
                ids = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
                bucket = np.searchsorted(edges, part.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int64()), part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([_pack(x) for x in ids], pa.binary())],
                    names=["bucket", "doc_id", "n_tokens", "ids"],
                )

    return run


def _pack(ids: np.ndarray) -> bytes:
    """As 16-bit integers where all fit, which the length tells: half the bytes to shuffle."""
    return ids.astype("<u2" if int(ids.max()) < 1 << 16 else "<u4").tobytes()


def _unpack(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4").astype(np.uint32)


def _write_segments(batches):
    """Sorted rows (bucket, doc_id, n_tokens, ids) to segments."""
    docs, lens, parts, total, seq, bucket = [], [], [], 0, 0, None

    def closed():
        return pa.RecordBatch.from_pylist(
            [{"bucket": bucket, "seq": seq, "n_tokens": total, "doc_ids": docs, "doc_lens": lens, "levels": dac_encode(np.concatenate(parts))}], schema=_SEGMENT
        )

    for batch in batches:
        for b, d, n, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n_tokens", "ids"))):
            if docs and (b != bucket or total + n > SEGMENT_TOKENS):
                yield closed()
                docs, lens, parts, total, seq = [], [], [], 0, seq + 1
            bucket = b
            docs.append(d), lens.append(n), parts.append(_unpack(ids, n))
            total += n
    if docs:
        yield closed()


def write_tokens(df: DataFrame, tokenizer_path: str, out_path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes df's texts, each followed by end_id, and writes the segments; returns their folder.

    Order: ascending id, a null id first, rows that repeat an id by number of ids and then content. A null or
    empty text has end_id alone, and a text of any length is one document. Ids are integers, or cast to them: a text that is
    no number fails the job. An empty df writes no segment.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # Ranges of ids with about BUCKET_BYTES of text each, from ids and lengths alone: the texts are encoded once.
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(total // BUCKET_BYTES + 1, BUCKETS))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] if n > 1 else None
    edges = np.asarray(sorted(set(bounds or [])), np.int64)
    coded = docs.mapInArrow(_encode_batches(tokenizer_path, end_id, edges), "bucket long, doc_id long, n_tokens long, ids binary")
    out = out_path or stage_path(spark, "tokens")
    # one bucket a task: hashed, several buckets fall into one task
    segments = coded.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "doc_id", "n_tokens", "ids").mapInArrow(_write_segments, SEGMENT_SCHEMA)
    segments.write.parquet(out)
    return out


def segment_starts(segments: DataFrame) -> DataFrame:
    """(bucket, seq, start): the ids before each segment. Sums by bucket keep the ordered step small."""
    from pyspark.sql import Window

    sizes = segments.select("bucket", "seq", "n_tokens")
    group = (F.col("bucket") / 1024).cast("bigint")
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).withColumn("_group", group)
    groups = buckets.groupBy("_group").agg(F.sum("n").alias("n"))
    groups = groups.select("_group", before(F.lit(0), "_group").alias("_g"))
    buckets = buckets.withColumn("_b", before("_group", "bucket")).join(groups, "_group").select("bucket", (F.col("_b") + F.col("_g")).alias("_b"))
    own = sizes.withColumnRenamed("n_tokens", "n").withColumn("_s", before("bucket", "seq"))
    return own.join(buckets, "bucket").select("bucket", "seq", (F.col("_s") + F.col("_b")).alias("start"))


def _read_documents(batches):
    """Segments to one row a document."""
    for batch in batches:
        for s in batch.to_pylist():
            ids = dac_decode(s["levels"]).astype("<u4").tobytes()
            ends = np.cumsum(s["doc_lens"])
            starts = ends - s["doc_lens"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s["doc_ids"], pa.int64()), pa.array([s["bucket"]] * len(starts), pa.int64()), pa.array([s["seq"]] * len(starts), pa.int64()),
                    pa.array(starts, pa.int64()), pa.array(s["doc_lens"], pa.int64()), pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ],
                names=["doc_id", "bucket", "seq", "_in", "n_tokens", "ids_crc32"],
            )


def read_digest(spark, path: str) -> DataFrame:
    """Reads the files back: per document doc_id, start, n_tokens and ids_crc32."""
    ship(spark)
    from pyspark.sql import types as T

    segments = spark.read.schema(T._parse_datatype_string(SEGMENT_SCHEMA)).parquet(path)
    docs = segments.mapInArrow(_read_documents, "doc_id long, bucket long, seq long, _in long, n_tokens long, ids_crc32 long")
    out = docs.join(segment_starts(segments), ["bucket", "seq"])
    return out.select("doc_id", (F.col("start") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def read_token(spark, path: str, position: int) -> int:
    """The id at a position of the whole output: one segment is read, and no block of it is decoded."""
    starts = segment_starts(spark.read.parquet(path)).filter(F.col("start") <= position).orderBy(F.desc("start"), F.desc("bucket"), F.desc("seq")).first()
    row = spark.read.parquet(path).filter((F.col("bucket") == starts["bucket"]) & (F.col("seq") == starts["seq"])).first()
    return dac_access([x.asDict() for x in row["levels"]], position - starts["start"])
