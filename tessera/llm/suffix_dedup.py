"""Suffix-array dedup: depth-limited radix sort of the suffixes of all documents.

Only the order of suffixes through the threshold's bytes matters, as equal groups at that depth are exactly
the repeated windows. Suffixes are dealt by a first digit that makes most of them drop out: of each window the
leftmost gram of the smallest hash (its anchor, one in about 14 bytes), which equal windows share. Anchors
whose gram is in one document only can't be in a repeated window. Those left are sorted with the bytes around
the gram, most significant digit first, four bits a pass, to the right and to the left: windows are equal where
their anchors are, and their ranks at the window's depth on both sides. A pass counts its digits and compares no
keys, and what is alone in its group then goes.

Copies of a text are one document, that of the smallest id, and texts are dealt once, by their digest, to groups.
From a group to a bucket of anchors go sorted 48-bit fingerprints and back a bit for each; then the bytes around
the anchors that are repeated. Equal surroundings of one group are sent once, with the smallest document, so a
passage that most documents share takes a row for each group and not for each document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, lean, mix, ship, slices, span_hashes, span_sums, stage, utf8

THRESHOLD = 50
GRAM = 24
#: Bytes of text for each bucket of anchors and for each group of documents, of which one task holds one: so many,
#: or more in a larger input, that a group sends no more than about PARTS rows, up to MOST times as many.
BUCKET_BYTES, GROUP_BYTES, PARTS, MOST = 6 << 20, 1 << 20, 1 << 17, 16
#: Bytes of text whose grams are held at once, unless one text has more, and rows of a batch of packed arrays.
SLICE_BYTES, BATCH_ROWS = 1 << 18, 16
#: Texts with most copies, whose digests are broadcast: copies of any other text are less than a 1/HOT of the rows.
HOT = 1 << 16
#: What stands for a null id.
NULL_ID = -(2**63)


class _Depths:
    """Sizes that follow from a threshold."""

    def __init__(self, threshold: int):
        if threshold < 8:
            raise ValueError("threshold must be 8 bytes or more")
        self.threshold = threshold
        self.gram = min(GRAM, threshold // 2)
        self.free = threshold - self.gram  # bytes of a window besides its gram; also its largest offset


def anchors(data: np.ndarray, offsets: np.ndarray, d: _Depths):
    """The anchors of all windows: their places, hashes, first and last window start and rows."""
    m = len(data) - d.gram + 1
    empty = np.zeros(0, np.int64)
    none = empty, np.zeros(0, np.uint64), empty, empty, empty
    if len(data) < d.threshold:
        return none
    sums, down = span_sums(data), _powers(len(data) + 1)[1]
    x = (sums[d.gram :] - sums[:m]) * down[:m]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    # 32 bits of hash over 32 bits of place: the minimum is the leftmost gram of the smallest hash
    value, span, width = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64), d.free + 1, 1
    while width * 2 <= span:  # over ranges of doubling width
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    if span > width:
        value = np.minimum(value[: width - span], value[span - width :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(value)]
    ok = np.flatnonzero(np.arange(len(value)) + d.threshold <= offsets[1:][row])
    if not len(ok):
        return none
    p, r = (value[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64), row[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    last, p = np.append(first[1:], len(ok)) - 1, p[first]
    return p, span_hashes(data, p, p + d.gram, sums), ok[first], ok[last], r[first]


def _cuts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(key))


def _blobs(key: np.ndarray, *columns: np.ndarray):
    """Columns sorted by key and cut where it changes: the keys, and for each column its parts as bytes."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts, ends = _cuts(key)
    out = []
    for c in columns:
        c = np.ascontiguousarray(c[order])
        width = c.dtype.itemsize * (c.shape[1] if c.ndim > 1 else 1)
        at = (np.append(starts, len(key)) * width).astype(np.int64)
        # from its buffers: an array made of memoryviews would never free them
        out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(c)]).cast(pa.binary()))
    return key[starts], out


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _in_batches(table: pa.Table) -> pa.Table:
    """The same rows in small chunks, so that no batch of a whole group crosses to Spark at once."""
    return pa.Table.from_batches(table.to_batches(max_chunksize=BATCH_ROWS), table.schema)


def _texts(table: pa.Table) -> pa.Table:
    """A group's documents, of equal texts the one of the smallest id, in an order that doesn't hang on that of the rows."""
    table = table.select(["grp", "doc_id", "text"]).combine_chunks()
    data, offsets = utf8(table.column("text"))
    h = span_hashes(data, offsets[:-1], offsets[1:]) if table.num_rows else np.zeros(0, np.uint64)
    order = np.lexsort((table.column("doc_id").to_numpy(), h))
    seen: dict[tuple, int] = {}
    for i in order.tolist():
        seen.setdefault((int(h[i]), data[offsets[i] : offsets[i + 1]].tobytes()), i)
    return table.take(pa.array(list(seen.values()), pa.int64()))


def _parts(table: pa.Table):
    """Slices of a group's documents: bytes, offsets, ids and tags that tell rows of one id apart."""
    column = table.column("text").combine_chunks()
    data, offsets = utf8(column)
    ids = table.column("doc_id").to_numpy().astype(np.int64)
    for a, b in slices(offsets, SLICE_BYTES):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        tags = (span_hashes(part, at[:-1], at[1:]) >> np.uint64(32)).astype(np.uint32)
        yield part, at, ids[a:b], tags


def _prints(h: np.ndarray) -> np.ndarray:
    """48 bits of each hash, even though anchors have small ones."""
    return mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(16)


def _bucket(prints: np.ndarray, buckets: int) -> np.ndarray:
    """Ascends with the fingerprint."""
    return ((prints >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _group_prints(texts: pa.Table, d: _Depths):
    """The distinct fingerprints of a group, ascending, and whether several of its documents have them."""
    found = [(_prints(h), rows, ids) for data, offsets, ids, _ in _parts(texts) for _, h, _, _, rows in [anchors(data, offsets, d)]]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    f, doc = np.concatenate([x for x, _, _ in found]), np.concatenate([ids[rows] for _, rows, ids in found])
    order = np.argsort(f, kind="stable")
    f, doc = f[order], doc[order]
    starts, ends = _cuts(f)
    other = np.zeros(len(f) + 1, np.int64)
    other[1:] = np.cumsum(doc != np.repeat(doc[starts], ends - starts))
    return f[starts], other[ends] > other[starts]


_ASK = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("many", pa.binary())])
ASK_SCHEMA = "bucket long, grp long, low binary, high binary, many binary"


def _ask(d: _Depths, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        lean()
        grp, texts = table.column("grp")[0].as_py(), _texts(table)
        f, many = _group_prints(texts, d)
        key, (low, high, many) = _blobs(_bucket(f, buckets), f.astype(np.uint32), (f >> np.uint64(32)).astype(np.uint16), many.astype(np.uint8))
        return _in_batches(pa.table([pa.array(key, pa.int64()), pa.array(np.full(len(key), grp), pa.int64()), low, high, many], schema=_ASK))

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each row of fingerprints a bit each: whether several documents have it."""
    lean()
    f = _joined(table.column("low"), np.uint32).astype(np.uint64) | _joined(table.column("high"), np.uint16).astype(np.uint64) << np.uint64(32)
    many = _joined(table.column("many"), np.uint8)
    _, at, n = np.unique(f, return_inverse=True, return_counts=True)
    again = ((n > 1) | (np.bincount(at, many, len(n)) > 0))[at]
    ends = np.cumsum([len(x) // 4 for x in table.column("low").to_pylist()]).tolist()
    bits = [np.packbits(again[a:b]).tobytes() for a, b in zip([0, *ends], ends)]
    return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


_CONTEXT = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("hashes", "docs", "tags", "places", "lows", "highs", "contexts", "groups")]])
CONTEXT_SCHEMA = "bucket long, hashes binary, docs binary, tags binary, places binary, lows binary, highs binary, contexts binary, groups binary"
SPAN_SCHEMA = "grp long, s_docs binary, s_tags binary, s_from binary, s_to binary"
#: Bucket -1 - g is group g itself: spans that it found alone, as docs, tags, places and groups (their ends).


def _contexts(d: _Depths, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        if not left.num_rows or not right.num_rows:
            return _CONTEXT.empty_table()
        grp, texts = left.column("grp")[0].as_py(), _texts(left)
        f, _ = _group_prints(texts, d)
        bits = dict(zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist()))
        starts, ends = _cuts(bucket := _bucket(f, buckets))
        again = np.concatenate([np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a) for k, a, b in zip(bucket[starts].tolist(), starts.tolist(), ends.tolist())]).astype(bool)
        asked, around = f[again], np.concatenate([np.arange(-d.free, 0), np.arange(d.gram, d.threshold)])
        parts = []
        for data, offsets, ids, tags in _parts(texts):
            p, h, first, last, rows = anchors(data, offsets, d)
            if not len(p) or not len(asked):
                continue
            own = _prints(h)
            kept = np.flatnonzero(asked[np.minimum(np.searchsorted(asked, own), len(asked) - 1)] == own)
            p, h, first, last, rows = p[kept], h[kept], first[kept], last[kept], rows[kept]
            low_j, high_j = p - last, p - first
            needed = (around >= -high_j[:, None]) & (around < d.threshold - low_j[:, None])
            context = np.where(needed, data[np.clip(p[:, None] + around, 0, len(data) - 1)], 0).astype(np.uint8)
            whole = mix(span_hashes(data, first, last + d.threshold) ^ mix(low_j.astype(np.uint64) * np.uint64(256) + high_j.astype(np.uint64)))
            parts.append((whole, h, ids[rows], tags[rows], (p - offsets[rows]).astype(np.uint32), low_j.astype(np.uint8), high_j.astype(np.uint8), context))
        if not parts:
            return _CONTEXT.empty_table()
        whole, h, doc, tag, place, low_j, high_j, context = (np.concatenate(x) for x in zip(*parts))
        del parts
        # of equal surroundings only the smallest document's go on; the other documents' windows are repeated
        order = np.lexsort((doc, whole))
        starts, ends = _cuts(whole[order])
        head = np.empty(len(whole), np.int64)
        head[order] = np.repeat(order[starts], ends - starts)
        same = (low_j == low_j[head]) & (high_j == high_j[head]) & (h == h[head]) & (context == context[head]).all(1)
        known, sent = np.flatnonzero(same & (doc > doc[head])), np.flatnonzero(~same | (doc == doc[head]))
        group = np.full(len(h), grp, np.int64)
        key, columns = _blobs(_bucket(_prints(h[sent]), buckets), *(x[sent] for x in (h, doc, tag, place, low_j, high_j, context, group)))
        out = pa.table([pa.array(key, pa.int64()), *columns], schema=_CONTEXT)
        if len(known):
            start, end = place[known] - high_j[known], place[known] - low_j[known].astype(np.uint32) + np.uint32(d.threshold)
            empty = pa.array([b""], pa.binary())
            local = [doc[known], tag[known], start.astype(np.uint32), None, None, None, end.astype(np.uint32)]
            columns = [empty if x is None else pa.array([x.tobytes()], pa.binary()) for x in [None, *local]]
            out = pa.concat_tables([out, pa.table([pa.array([-1 - grp], pa.int64()), *columns], schema=_CONTEXT)])
        return _in_batches(out)

    return run


def _refined(rank: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Two passes, by a byte's halves: ranks within groups of equal rank by the next digit, by counting alone."""
    for digit in (byte >> 4, byte & 15):
        cell = rank * 16 + digit
        used = np.zeros((int(rank.max()) + 1) * 16, bool)
        used[cell] = True
        rank = (np.cumsum(used) - 1)[cell]
    return rank


def _ranks(group: np.ndarray, digits: list[np.ndarray]) -> list[np.ndarray]:
    """The ranks after each depth of digits, -1 for what is alone in its group by then."""
    out, rows, rank = [group], np.arange(len(group)), group
    for byte in digits:
        if len(rows):
            rank = _refined(rank, byte[rows])
            many = np.bincount(rank)[rank] > 1
            rows, rank = rows[many], rank[many]
        full = np.full(len(group), -1, np.int64)
        full[rows] = rank
        out.append(full)
    return out


def _sort_windows(d: _Depths):
    def run(table: pa.Table) -> pa.Table:
        lean()
        bucket = table.column("bucket")[0].as_py()
        doc, tag = _joined(table.column("docs"), np.int64), _joined(table.column("tags"), np.uint32)
        place = _joined(table.column("places"), np.uint32).astype(np.int64)
        if bucket < 0:
            group, start, end = np.full(len(doc), -1 - bucket, np.int64), place, _joined(table.column("groups"), np.uint32).astype(np.int64)
        else:
            h, low_j, high_j = _joined(table.column("hashes"), np.uint64), _joined(table.column("lows"), np.uint8), _joined(table.column("highs"), np.uint8)
            context = _joined(table.column("contexts"), np.uint8).reshape(-1, 2 * d.free)
            owner = _joined(table.column("groups"), np.int64)
            # the first digit once more, without those that have lost their partner to a smaller document of their group
            _, group, size = np.unique(h, return_inverse=True, return_counts=True)
            many = np.flatnonzero(size[group] > 1)
            doc, tag, place, low_j, high_j, context, owner = doc[many], tag[many], place[many], low_j[many], high_j[many], context[many], owner[many]
            group = np.cumsum(size > 1)[group[many]] - 1
            left = _ranks(group, [context[:, d.free - 1 - k] for k in range(d.free)])
            right = _ranks(group, [context[:, d.free + k] for k in range(d.free)])
            gone = np.zeros((len(doc), d.free + 3), bool)  # offsets from 0, with an empty one on each side
            for j in range(d.free + 1):
                own = np.flatnonzero((low_j <= j) & (j <= high_j) & (left[j] >= 0) & (right[d.free - j] >= 0))
                if len(own):
                    key = left[j][own] * (len(doc) + 1) + right[d.free - j][own]
                    order = np.lexsort((doc[own], key))
                    x = doc[own][order]
                    starts, ends = _cuts(key[order])
                    gone[own[order], j + 1] = x > np.repeat(x[starts], ends - starts)
            row, at = np.nonzero(gone[:, 1:] != gone[:, :-1])
            a, b, row = at[0::2], at[1::2] - 1, row[0::2]  # runs of offsets a..b
            doc, tag, start, end, group = doc[row], tag[row], place[row] - b, place[row] - a + d.threshold, owner[row]
        order = np.lexsort((start, doc))
        key, columns = _blobs(group[order], doc[order], tag[order], start[order].astype(np.uint32), end[order].astype(np.uint32))
        return pa.table({"grp": pa.array(key, pa.int64()), **dict(zip(("s_docs", "s_tags", "s_from", "s_to"), columns))})

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
RESULT_SCHEMA = "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:bigint,end:bigint>>"


def _remove(with_text: bool):
    """The documents that lose something, or all with their texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        doc, tag, start, end = (_joined(right.column(c), k) for c, k in (("s_docs", np.int64), ("s_tags", np.uint32), ("s_from", np.uint32), ("s_to", np.uint32)))
        order = np.lexsort((start, tag, doc))
        doc, tag, start, end = doc[order], tag[order], start[order].astype(np.int64), end[order].astype(np.int64)
        out = []
        for data, offsets, ids, tags in _parts(_texts(left)) if left.num_rows else ():
            for k in range(len(ids)):
                a, b = np.searchsorted(doc, ids[k]), np.searchsorted(doc, ids[k], side="right")
                own = slice(a + np.searchsorted(tag[a:b], tags[k]), a + np.searchsorted(tag[a:b], tags[k], side="right"))
                s, e = start[own], np.maximum.accumulate(end[own]) if own.stop > own.start else end[own]
                if not len(s) and not with_text:
                    continue
                new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
                s, e = s[new], e[np.append(np.flatnonzero(new)[1:], len(e)) - 1] if len(s) else e
                raw, at, kept = data[offsets[k] : offsets[k + 1]].tobytes(), 0, []
                for x, y in zip(s.tolist(), e.tolist()):
                    kept.append(raw[at:x])
                    at = y
                rest = b"".join([*kept, raw[at:]])
                spans = [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())] if with_text else None
                out.append((int(ids[k]), hashlib.sha256(raw).hexdigest(), len(raw) - len(rest), len(s), hashlib.sha256(rest).hexdigest(), rest if with_text else None, spans))
        columns = list(zip(*out)) if out else [[]] * len(_RESULT)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)

    return run


def remove_repeats(df: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes left) and spans
    (maximal removed runs) unless with_text is false, which leaves both null.

    Removed is each byte covered by a string of threshold bytes that also starts in a document with a smaller id;
    strings are judged on the input, don't cross documents, and overlaps count. A null text counts as empty. A
    null id is smaller than any other (but for -2^63, which it equals) and is returned as null. Rows that repeat an
    id don't take from each other. A text shorter than threshold keeps all; texts of any length are one document.
    An empty df gives no rows, and other columns are ignored. Removal can cut a character; kept is bytes.
    """
    spark = df.sparkSession
    ship(spark)
    d = _Depths(threshold)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("_id"), F.sha2(text.cast("binary"), 256).alias("sha"), text.alias("text"))
    rows = stage(docs.select("doc_id", "_id", "sha", F.octet_length("text").cast("bigint").alias("n_bytes")), "suffix-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bucket_bytes, group_bytes = (min(max(size, total // PARTS), MOST * size) for size in (BUCKET_BYTES, GROUP_BYTES))
    buckets, groups = int(max(8, total // bucket_bytes)), int(max(8, total // group_bytes))
    # copies beyond the smallest id's lose all or, where they are shorter than a window, nothing
    least = rows.groupBy("sha").agg(F.min("_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    hot = least.orderBy(F.desc("n"), "sha").limit(HOT).select(F.col("sha").alias("_sha"), F.col("least").alias("_least"))
    texts = docs.join(F.broadcast(hot), F.col("sha") == F.col("_sha"), "left").filter("_least IS NULL OR _id = _least")
    grouped = texts.select(F.pmod(F.xxhash64("sha"), F.lit(groups)).alias("grp"), F.col("_id").alias("doc_id"), "text").repartition("grp")
    asked = grouped.groupBy("grp").applyInArrow(_ask(d, buckets), ASK_SCHEMA)
    answers = asked.groupBy("bucket").applyInArrow(_answer, "grp long, bucket long, bits binary")
    contexts = grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_contexts(d, buckets), CONTEXT_SCHEMA)
    spans = contexts.groupBy("bucket").applyInArrow(_sort_windows(d), SPAN_SCHEMA)
    found = stage(grouped.groupBy("grp").cogroup(spans.groupBy("grp")).applyInArrow(_remove(with_text), RESULT_SCHEMA), "suffix-found")
    keys = found.select(F.col("sha").alias("_sha"), F.col("doc_id").alias("_doc"), "n_removed", "n_spans", "kept_sha256", "kept", "spans").dropDuplicates(["_sha", "_doc"])
    firsts = least.select(F.col("sha").alias("_l"), "least")
    # the copies of a broadcast text need no shuffle
    marked = rows.join(F.broadcast(hot), F.col("sha") == F.col("_sha"), "left").drop("_sha")
    known = marked.filter("_id > _least").withColumn("_copy", F.lit(True))
    out = marked.filter("_least IS NULL OR _id <= _least").join(firsts, F.col("sha") == F.col("_l"), "left").withColumn("_copy", F.coalesce(F.col("_id") > F.col("least"), F.lit(False)))
    out = out.join(keys, (F.col("sha") == F.col("_sha")) & (F.coalesce("least", "_id") == F.col("_doc")), "left")
    out = out.unionByName(known, allowMissingColumns=True)
    all_of_it = F.col("_copy") & (F.col("n_bytes") >= threshold)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    pick = lambda whole, name, rest: F.when(all_of_it, whole).otherwise(F.coalesce(name, rest)).alias(name)
    zero = F.lit(0).cast("bigint")
    cols = ["doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", zero), pick(F.lit(1).cast("bigint"), "n_spans", zero), pick(none, "kept_sha256", F.col("sha"))]
    if with_text:
        kind = found.schema["spans"].dataType
        one = F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("end"))).cast(kind)
        return out.select(*cols, F.when(all_of_it, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), F.when(all_of_it, one).otherwise(F.col("spans")).alias("spans"))
    return out.select(*cols, F.lit(None).cast("binary").alias("kept"), F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))


#: DuckDB's form of the query op9, over hexadecimal digits.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT r, doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.r, w.i FROM w JOIN m USING (g) WHERE w.doc_id > m.least),
n AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM h),
k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM n),
s AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY r, k),
p AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM s),
t AS (SELECT d.r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS gone, count(*) AS n FROM d JOIN p USING (r) GROUP BY d.r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
