"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the components of its links.

Documents with equal shingle sets are one class. Classes are routed to search groups by parts of their sets: a level
of sizes has one number of parts, more than a link's two sets can differ in, so two linked sets agree in at least one
whole part, and a part that two classes have alike is rarely a chance. A part two classes share routes both to its
leader, the smallest class with it. In a leader's group, finer parts in 16 bits each tell which classes agree in enough
of them with another one to be linked at all; the others go. What is left is searched with whole sets: its inverted lists are parted into
long and short ones, the short ones are heap-merged, what occurs often enough in them is binary-probed in the long
ones, and what reaches the required overlap is checked exactly; documents that are already in the asker's component
are skipped. A group of over GROUP_BYTES of sets is first searched for links to its leader; the linked are one
component then, and only the others are indexed, in blocks of GROUP_BYTES, and searched for by all.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, mix, release, ship, slices, stage, unstage, utf8, words

SHINGLE = 3
PERCENT = 90
#: Bytes of sets of an index block, and about how many queries one task puts to it.
GROUP_BYTES, QUERIES = 16 << 20, 4096
#: Ratio of the sizes of a level.
LEVEL = 1.5
#: Most cells of the broadcast bitmaps of classes, keys and rows (32 MB); fuller ones only keep fewer rows from shuffles.
BITS = 1 << 28
#: How often groups are merged along their leaders, so that fewer sets are sent to several groups.
MERGES = 2
#: Rows of a group whose finer parts are compared; a larger group goes on to the search as it is.
NEAR_ROWS = 1 << 15
#: Marks keys that stand in for empty parts; above all levels.
BARE = 128
#: The paper's weight of a probe against a merge step.
MU = 0.0085
HOT = 1024
#: Ids that are broadcast, at most (8 bytes each, and the hash table's).
BROADCAST_IDS = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """Of each row the distinct hashes of size consecutive words, ascending: flat hashes and their rows."""
    h, _, _, rows = words(LOWER[data], offsets, NOT_SPACE)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    k = np.arange(len(h)) - first[rows]
    width = np.minimum(n, size)[rows]
    at = np.flatnonzero(k + width <= n[rows])
    out = mix(width[at].astype(np.uint64))
    for j in range(size):
        inside = j < width[at]
        out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside] + j])
    rows = rows[at]
    order = np.lexsort((out, rows))
    out, rows = out[order], rows[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    return out[new], rows[new]


def class_ids(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """128 bits for each row's set, as rows of 16 bytes."""
    out = np.zeros((n_rows, 2), np.uint64)
    if len(hashes):
        np.add.at(out[:, 0], rows, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
        np.add.at(out[:, 1], rows, mix(hashes * np.uint64(3) + np.uint64(1)))
        out[:, 0] = mix(out[:, 0])
    return out.view(np.uint8).reshape(n_rows, 16)


def _binary(a: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in a], pa.binary())


class Parts:
    """How sets of a size are parted, for links of percent."""

    def __init__(self, percent: int):
        self.percent, borders = percent, [1]
        while borders[-1] < 1 << 40:
            borders.append(max(borders[-1] + 1, int(borders[-1] * LEVEL)))
        self.borders = np.array(borders, np.int64)
        differ = 2 * (self.borders[1:] - 1) * (100 - percent) // (100 + percent)  # the most that two linked sets of a level differ in
        # parts are empty by chance, too, so there are some more
        per_part = (100 + percent) / (2 * (100 - percent)) / LEVEL if percent < 100 else 100.0
        self.spare = np.ceil(1.3 * math.exp(-per_part) * differ).astype(np.int64)
        self.parts = differ + 1 + self.spare

    def keys(self, h: np.ndarray, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of sets (flat h, sorted by row and then hash; n: sizes) and their rows, in order of rows. Two sets that link
        have one in common. A key's last byte is its level, and BARE for those that stand in for empty parts."""
        found, owners, starts = [], [], np.cumsum(n) - n
        level, upper = np.searchsorted(self.borders, n, side="right") - 1, np.zeros(len(n), np.int64)
        own = np.flatnonzero(n > 0)
        while len(own):  # of its own level, and of each next one in which a set can have a partner
            at = level[own] + upper[own]
            k, size = self.parts[at], n[own]
            place = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            x, of = h[place], np.repeat(np.arange(len(own)), size)
            first = np.cumsum(k) - k
            cell = first[of] + ((mix(x ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)) * k[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x[order] + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
            begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            part = sums[np.append(begin[1:], len(cell))] - sums[begin]
            cell = cell[begin]
            of = np.searchsorted(first, cell, side="right") - 1
            tag = mix(at[of].astype(np.uint64) << np.uint64(40) | (cell - first[of]).astype(np.uint64))
            found.append(self._marked(mix(part ^ tag), at[of]))
            owners.append(own[of])
            # the parts that two sets have alike may all be empty only if both have more empty ones than there are to spare:
            # those meet, too, under the first hashes of their prefixes
            bare = np.flatnonzero(k - np.bincount(of, minlength=len(own)) > self.spare[at])
            if len(bare):
                size, of = n[own[bare]], np.repeat(np.arange(len(bare)), n[own[bare]])
                place = np.repeat(starts[own[bare]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                rank = np.arange(len(of)) - (np.cumsum(size) - size)[of]
                kept = rank < (size - (self.percent * size + 99) // 100 + 1)[of]
                found.append(self._marked(mix(h[place[kept]]), at[bare][of[kept]] + BARE))
                owners.append(own[bare][of[kept]])
            upper[own] += 1
            own = own[100 * n[own] >= self.percent * self.borders[level[own] + upper[own]]]
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found, owners = np.concatenate(found), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return found[order], owners[order]


    def fine(self, level: np.ndarray) -> np.ndarray:
        """Numbers of the finer parts of levels, of which two linked sets agree in half, at least."""
        return 2 * (self.parts[level] - self.spare[level])

    def differ(self, a, b):
        """In how many parts sets of sizes a and b can differ, at most, if they link."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def vectors(self, h: np.ndarray, rows: np.ndarray, n: np.ndarray):
        """Yields (row, level, 16-bit sums of the finer parts), for each row's level and each next one in which it can have a partner."""
        starts = np.cumsum(n) - n
        mixed, place = mix(h + np.uint64(0x632BE59BD9B4E019)), mix(h ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)
        for row in np.flatnonzero(n > 0).tolist():
            own, size = slice(starts[row], starts[row] + n[row]), int(n[row])
            level = int(np.searchsorted(self.borders, size, side="right")) - 1
            while True:
                k = int(self.fine(level))
                part = (place[own] * np.uint64(k) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[own][order], dtype=np.uint64)])
                cut = np.searchsorted(part[order], np.arange(k + 1))
                yield row, level, (mix(sums[cut[1:]] - sums[cut[:-1]]) >> np.uint64(48)).astype(np.uint16)
                level += 1
                if 100 * size < self.percent * self.borders[level]:
                    break

    @staticmethod
    def _marked(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return key & ~np.uint64(0xFF) | mark.astype(np.uint64)

    def promising(self, keys: np.ndarray, rows: np.ndarray, n: np.ndarray, met: np.ndarray) -> np.ndarray:
        """Which keys to go on with, where met tells those that another set may have: of a set's level, all or none.

        Two sets of a level that link have all parts alike but for as many as the sets differ in. met may be too true."""
        mark = (keys & np.uint64(0xFF)).astype(np.int64)
        cell, level = rows * 256 + (mark & (BARE - 1)), mark & (BARE - 1)
        cells, at = np.unique(cell, return_inverse=True)
        plain = mark < BARE
        filled, alike = (np.bincount(at[x], minlength=len(cells)) for x in (plain, plain & met))
        size, k = n[cells // 256], self.parts[cells % 256]
        partner = np.minimum(self.borders[1:][cells % 256] - 1, 100 * size // self.percent)
        needed = filled - (size + partner) * (100 - self.percent) // (100 + self.percent)
        good = (alike >= np.maximum(1, needed)) | (k - filled > self.spare[cells % 256])
        return met & good[at]


def _signatures(size: int, percent: int):
    """(_id, text) to (_id, n, cid, c, keys): c is the first half of cid, keys those of the set's parts."""
    parts = Parts(percent)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, 1 << 20):
                h, rows = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.bincount(rows, minlength=b - a)
                keys, of = parts.keys(h, rows, n)
                cut = np.searchsorted(of, np.arange(b - a + 1)).astype(np.int32)
                cid = class_ids(h, rows, b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(a, b - a), pa.array(n, pa.int64()), _binary(cid), pa.array(cid[:, :8].copy().view(np.int64)[:, 0]), pa.ListArray.from_arrays(pa.array(cut), pa.array(keys.view(np.int64)))],
                    names=["_id", "n", "cid", "c", "keys"],
                )

    return run


def _holds(bitmap: np.ndarray, x: np.ndarray) -> np.ndarray:
    cell = x & (len(bitmap) * 8 - 1)
    return (bitmap[cell >> 3] >> (cell & 7) & 1).astype(bool)


def _met_keys(shared, percent: int):
    """(c, n, keys) to (key, c), of keys that the bitmap may hold, where they are enough for a link."""
    parts = Parts(percent)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column("keys")
                cut = lists.offsets.to_numpy()
                keys = lists.values.to_numpy()[cut[0] : cut[-1]]
                rows = np.repeat(np.arange(part.num_rows), np.diff(cut))
                kept = parts.promising(keys.view(np.uint64), rows, part.column("n").to_numpy(), _holds(shared.value, keys >> 8))
                yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(part.column("c").to_numpy()[rows[kept]])], names=["key", "c"])

    return run


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Cells of the values of a long column: 16 or more for each of df's rows (a power of two), BITS at most."""
    rows = df.count()
    bits = int(min(BITS, max(1 << 15, 1 << (16 * rows).bit_length())))
    cell = F.pmod(F.col(column), F.lit(bits)) + 1
    out = np.zeros(bits // 8, np.uint8)
    for r in df.select(cell.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("map")).toLocalIterator():
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out


def _passing(shared, column: str):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_holds(shared.value, batch.column(column).to_numpy())))

    return run


def _sets(shared, size: int):
    """(h, text) to (cid, set) of the rows whose h the bitmap may hold."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_holds(shared.value, batch.column("h").to_numpy())))
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                h, rows = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([_binary(class_ids(h, rows, b - a)), pa.array([h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], names=["cid", "set"])

    return run


def _vectors(shared, size: int, percent: int):
    """(h, text) to (c, level, n, vec) of the rows whose h the bitmap may hold."""
    parts = Parts(percent)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_holds(shared.value, batch.column("h").to_numpy())))
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, 1 << 20):
                h, rows = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.bincount(rows, minlength=b - a)
                c = class_ids(h, rows, b - a)[:, :8].copy().view(np.int64)[:, 0]
                found = list(parts.vectors(h, rows, n))
                at = np.array([r for r, _, _ in found], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array([x for _, x, _ in found], pa.int32()), pa.array(n[at], pa.int64()), pa.array([v.tobytes() for _, _, v in found], pa.binary())], names=["c", "level", "n", "vec"])

    return run


def near(vectors: np.ndarray, n: np.ndarray, parts: Parts) -> np.ndarray:
    """Which rows (vectors of one level, sizes n) agree with another one in as many finer parts as a link's two sets do.

    The first row is compared with all; any other that is still open meets, under the rarest of its parts, those that it
    could agree with in enough: a search for T occurrences that leaves T - 1 long lists out.
    """
    rows, k = vectors.shape
    kept = np.zeros(rows, bool)

    def partners(i, who):
        able = who[np.minimum(n[who], n[i]) * 100 >= np.maximum(n[who], n[i]) * parts.percent]
        return able[(vectors[able] != vectors[i]).sum(1) <= parts.differ(n[able], n[i])]

    def mark(i, who):
        found = partners(i, who)
        found = found[found != i]
        kept[found] = True
        kept[i] |= len(found) > 0

    if rows > 1:
        mark(0, np.arange(rows))
    if kept.all() or rows < 2:
        return kept
    codes = vectors.astype(np.int64) + (np.arange(k) << 16)
    _, code, count = np.unique(codes, return_inverse=True, return_counts=True)
    code = code.reshape(rows, k)
    order = np.argsort(count[code] * (len(count) + 1) + code, axis=1, kind="stable")
    rarest = np.take_along_axis(code, order, 1)
    length = np.minimum(k, parts.differ(n, np.minimum(100 * n // parts.percent, n.max())) + 1)  # one of so many is common, as they may differ in one fewer
    inside = np.arange(k) < length[:, None]
    flat, owner = rarest[inside], np.repeat(np.arange(rows), length)
    by = np.argsort(flat, kind="stable")
    owner, starts = owner[by], np.searchsorted(flat[by], np.arange(len(count) + 1))
    for i in np.flatnonzero(~kept).tolist():
        if not kept[i]:
            own = rarest[i, : length[i]]
            own = own[count[own] > 1]
            who = np.unique(np.concatenate([owner[starts[x] : starts[x + 1]] for x in own])) if len(own) else np.zeros(0, np.int64)
            mark(i, who)
    return kept


def _near(percent: int):
    """Sorted rows (leader, level, c, n, vec) to (leader, c) of those that may have a link in their group."""
    parts = Parts(percent)

    def run(batches):
        group, rows = None, []

        def closed():
            if len(rows) > NEAR_ROWS:
                own = rows
            else:
                kept = near(np.stack([np.frombuffer(v, np.uint16) for _, _, v in rows]), np.array([m for _, m, _ in rows], np.int64), parts) if rows else []
                own = [r for r, k in zip(rows, kept) if k]
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(own) if group else [], pa.int64()), pa.array([c for c, _, _ in own], pa.int64())], names=["leader", "c"])

        for batch in batches:
            for leader, level, *row in zip(*(batch.column(c).to_pylist() for c in ("leader", "level", "c", "n", "vec"))):
                if (leader, level) != group:
                    if rows:
                        yield closed()
                    group, rows = (leader, level), []
                if not rows or row[0] != rows[-1][0]:  # several rows may have brought a class's vector
                    rows.append(row)
        yield closed()

    return run


class Block:
    """Inverted lists over some sets, and the components of those that are linked."""

    def __init__(self, ids: list[bytes], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent, self.m = ids, sets, percent, max(1, len(ids))
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((doc, flat))
        flat, self.doc = flat[order], doc[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        self.shingles = flat[new]
        self.starts = np.append(np.flatnonzero(new), len(flat))
        self.places = (np.cumsum(new) - 1) * self.m + self.doc  # (list, document), ascending
        self.root = np.arange(len(ids))  # of each set's component
        self.members = {i: [i] for i in range(len(ids))}

    def link(self, i: int, j: int) -> None:
        a, b = int(self.root[i]), int(self.root[j])
        if a != b:
            if len(self.members[a]) < len(self.members[b]):
                a, b = b, a
            gone = self.members.pop(b)
            self.root[gone] = a
            self.members[a] += gone

    def search(self, own: np.ndarray, known: int | None = None) -> list[int]:
        """Sets linked with own; of a component only one. known: own's place among the sets, of which those before
        it and those of its component are skipped."""
        n = len(own)
        need = max(1, (self.percent * n + 99) // 100)  # an overlap below this can't make the ratio
        if not len(self.shingles):
            return []
        i = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
        lists = i[self.shingles[i] == own]
        if len(lists) < need:
            return []
        length = self.starts[lists + 1] - self.starts[lists]
        by = np.argsort(-length, kind="stable")
        lists, length = lists[by], length[by]
        n_long = min(need - 1, int(need / (MU * math.log(max(2, int(length[0]))) + 1)))
        long, short, size = lists[:n_long], lists[n_long:], length[n_long:]
        # the short lists without what can't be asked for, once for all of them
        docs = self.doc[np.repeat(self.starts[short] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        able = (np.minimum(n, self.sizes) * 100 >= np.maximum(n, self.sizes) * self.percent)
        if known is not None:
            able[: known + 1] = False
            able &= self.root != self.root[known]
        kept = able[docs]
        if not kept.any():
            return []
        docs, cut = docs[kept], np.cumsum(np.bincount(np.repeat(np.arange(len(short)), size)[kept], minlength=len(short)))
        merged = heapq.merge(*(x.tolist() for x in np.split(docs, cut[:-1]) if len(x)))
        out, roots = [], set()
        for d, same in groupby(merged):
            if int(self.root[d]) in roots:
                continue
            overlap = sum(1 for _ in same)
            if overlap < need - n_long:
                continue
            if n_long:
                probe = long * self.m + d
                at = np.minimum(np.searchsorted(self.places, probe), len(self.places) - 1)
                overlap += int((self.places[at] == probe).sum())
            if 100 * overlap >= self.percent * (n + int(self.sizes[d]) - overlap):
                out.append(d)
                roots.add(int(self.root[d]))
        return out

    def join_own(self) -> None:
        for i, s in enumerate(self.sets):
            for d in self.search(s, i):
                self.link(d, i)

    def edges(self):
        return [(self.ids[i], self.ids[int(r)]) for i, r in enumerate(self.root) if r != i]


def _search(percent: int):
    """Rows (leader, block, salt, role, cid, set), sorted; role 0 is indexed, role 1 only asks. Gives links that
    join the same components as all links do: (leader, a, b)."""

    def run(batches):
        group, block, ids, sets, out = None, None, [], [], []

        def closed():
            own = block
            if own is None and len(ids) > 1:
                own = Block(ids, sets, percent)
                own.join_own()
            return [(group[0], a, b) for a, b in own.edges()] if own is not None else []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int64()) for k in range(3)], names=["leader", "a", "b"])

        for batch in batches:
            for leader, number, salt, role, cid, s in zip(*(batch.column(c).to_pylist() for c in ("leader", "block", "salt", "role", "cid", "set"))):
                if (leader, number, salt) != group:
                    if group is not None:
                        out += closed()
                    group, block, ids, sets = (leader, number, salt), None, [], []
                own = np.frombuffer(s, np.uint64)
                if role == 0:
                    if not ids or cid != ids[-1]:  # several rows may have brought a class's set
                        ids.append(cid), sets.append(own)
                    continue
                if block is None:
                    block = Block(ids, sets, percent)
                    block.join_own()
                found = block.search(own)
                # an indexed class that asks, too, finds itself
                out += [(leader, cid, block.ids[d]) for d in found if block.ids[d] != cid]
                for d in found[1:]:
                    block.link(d, found[0])
                    out.append((leader, block.ids[d], block.ids[found[0]]))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if group is not None:
            out += closed()
        yield batch_of(out)

    return run


def _searched(rows: DataFrame, percent: int) -> DataFrame:
    rows = rows.select("leader", "block", "salt", "role", "cid", "set").repartition("leader", "block", "salt").sortWithinPartitions("leader", "block", "salt", "role", "cid")
    return rows.mapInArrow(_search(percent), "leader long, a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (cid, root): the smallest node of each node's component; alternating large and small stars, until
    neither changes an edge."""
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "join-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").unionByName(low.select(F.col("a").alias("x"), "m"))
        last, edges = edges, stage(small.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "join-edges")
        unstage(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("cid"), F.col("b").alias("root"))
        before = now


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: id, n_shingles and component_id.

    Words are parted by ASCII white space, A-Z lower-cased. Two rows link when 100 * intersection >= percent *
    union of their sets of size-word shingles; a text of fewer words has its whole sequence as the one shingle,
    one without words (or null) an empty set that links with nothing. component_id is the smallest id that is
    reachable by links; a null id is ignored unless all ids are null. Other columns are ignored, rows that
    repeat are linked, texts of any length are read whole; an empty df gives no rows. percent: 50 to 100.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    kind = docs.schema["_id"].dataType.simpleString()
    keyed = stage(docs.mapInArrow(_signatures(size, percent), f"_id {kind}, n long, cid binary, c long, keys array<bigint>"), "join-signatures")
    signed = stage(keyed.select("_id", "n", "cid", "c"), "join-rows")
    classes = signed.filter("n > 0").groupBy("cid").agg(F.min("_id").alias("id"), F.count("*").alias("rows"))
    links, used = _links(spark, docs, keyed, signed.filter("n > 0"), size, percent)
    roots = components(links)

    named = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("rows").alias("total")).filter("total > 1")
    named = stage(named.join(least, "root").select("cid", "component_id", "rows"), "join-classes")
    for x in (roots, *used):
        unstage(x)
    hot = named.orderBy(F.desc("rows"), "cid").limit(HOT)
    rows = signed.select("_id", "n", "cid").join(F.broadcast(hot), "cid", "left")
    cols = [F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_id")).otherwise(F.coalesce("component_id", "_id")).alias("component_id")]
    rest = rows.filter("rows is null").select("_id", "n", "cid").join(named.select("cid", "component_id"), "cid", "left")
    return rows.filter("rows is not null").select(*cols).unionByName(rest.select(*cols))


def _links(spark, docs: DataFrame, keyed: DataFrame, of_classes: DataFrame, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links that join the components; and the stages that can go once these are read. Bitmaps only keep rows from shuffles."""
    send = spark.sparkContext.broadcast
    met = keyed.select(F.explode("keys").alias("key"), "c").groupBy("key").agg(F.min("c").alias("leader"), F.max("c").alias("last")).filter("leader <> last")
    met = stage(met.select("key", "leader"), "join-keys")
    known = bitmap(met.select(F.shiftright("key", 8).alias("key")), "key")  # the last byte is no hash
    release(spark)
    own_keys = keyed.select("c", "n", "keys").mapInArrow(_met_keys(send(known), percent), "key long, c long")
    routes = own_keys.join(met, "key").select("leader", "c", F.col("key").bitwiseAND(F.lit(BARE - 1)).cast("int").alias("level")).distinct()
    routes = stage(routes, "join-routes")
    unstage(keyed)
    release(spark)
    used = [met, routes]
    text = docs.select(F.xxhash64("_id").alias("h"), "text")

    def representatives(routes):
        """(cid, c, n, h) of the classes in routes: any of a class's rows serves, as all have its set."""
        met_classes = of_classes.mapInArrow(_passing(send(bitmap(routes, "c")), "c"), of_classes.schema)
        return met_classes.groupBy("cid").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.min(F.xxhash64("_id")).alias("h"))

    asked = representatives(routes).select("h").distinct()
    vectors = stage(text.mapInArrow(_vectors(send(bitmap(asked, "h")), size, percent), "c long, level int, n long, vec binary"), "join-vectors")
    grouped = routes.join(vectors, ["c", "level"]).select("leader", "level", "c", "n", "vec").repartition("leader", "level").sortWithinPartitions("leader", "level", "c")
    used += [vectors]
    routes = stage(grouped.mapInArrow(_near(percent), "leader long, c long").distinct(), "join-routes")
    release(spark)
    for _ in range(MERGES):  # a leader that is in groups of smaller leaders takes its own group to the first of them
        into = routes.groupBy("c").agg(F.min("leader").alias("into")).filter("into < c").withColumnRenamed("c", "l")
        merged = routes.join(into, F.col("leader") == F.col("l"), "left").select(F.coalesce("into", "leader").alias("leader"), "c").distinct()
        used.append(routes)
        routes = stage(merged, "join-routes")
    members = stage(routes.join(representatives(routes), "c").select("leader", "c", "cid", "n", "h"), "join-members")
    asked = members.select("cid", "h").distinct()
    sets = text.mapInArrow(_sets(send(bitmap(asked, "h")), size), "cid binary, set binary")
    sets = stage(sets, "join-sets")
    groups = members.groupBy("leader").agg(F.count("*").alias("size"), F.sum(8 * F.col("n")).alias("bytes"))
    groups = stage(groups.withColumnRenamed("leader", "l"), "join-groups")
    at = F.col("leader") == F.col("l")
    small, large = groups.filter(F.col("bytes") <= GROUP_BYTES).select("l"), groups.filter(F.col("bytes") > GROUP_BYTES).select("l", "size")
    zero = F.lit(0)
    own = members.join(small, at).select("leader", "cid").withColumns({"block": zero, "salt": zero, "role": zero}).join(sets, "cid")
    found = stage(_searched(own, percent), "join-links")
    used += [routes, members, sets, groups, found]
    if large.isEmpty():
        return found.select("a", "b"), used

    salts = F.ceil(F.col("size") / QUERIES).cast("int")
    salt = F.pmod(F.xxhash64("cid"), salts).cast("int")
    many, other = stage(members.join(large, at).select("leader", "c", "cid", "n", "size"), "join-many"), "c <> leader"
    ask = many.filter(other).select("leader", "cid", zero.alias("block"), salt.alias("salt"), F.lit(1).alias("role"))
    heads = many.filter("c = leader").select("leader", "cid", zero.alias("block"), F.explode(F.sequence(zero, salts - 1)).alias("salt"), zero.alias("role"))
    first = stage(_searched(ask.unionByName(heads).join(sets, "cid"), percent), "join-links")
    linked = first.select("leader", F.col("a").alias("cid")).distinct()
    others = many.filter(other).join(linked, ["leader", "cid"], "left_anti")
    loads = others.groupBy("leader").agg(F.ceil(F.sum(8 * F.col("n")) / GROUP_BYTES).cast("int").alias("blocks")).withColumnRenamed("leader", "l")
    index = others.join(loads, at).select("leader", "cid", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(zero, salts - 1)).alias("salt"), zero.alias("role"))
    ask = many.join(loads, at).select("leader", "cid", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), salt.alias("salt"), F.lit(1).alias("role"))
    rest = stage(_searched(index.unionByName(ask).join(sets, "cid"), percent), "join-links")
    return found.select("a", "b").unionByName(first.select("a", "b")).unionByName(rest.select("a", "b")), [*used, many, first, rest]


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of df without those of which another one of the component has a smaller id; rows with a null id or
    no words stay. Rows that repeat an id stay or go together. Texts aren't shuffled where BROADCAST_IDS ids or fewer go."""
    gone = join(df, id_col, text_col, size, percent).filter(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    gone = stage(gone, "join-gone")
    few = gone.count() <= BROADCAST_IDS
    return df.join(F.broadcast(gone) if few else gone, F.col(id_col) == F.col("_gone"), "left_anti")


#: DuckDB's form of the query op2.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
p AS (SELECT doc_id, g, n FROM (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.df, s.g) AS r FROM s JOIN n USING (doc_id) JOIN f USING (g)) WHERE r <= n - ceil(n * 90 / 100.0) + 1),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
o AS (SELECT x, y, nx, ny, count(*) AS k FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND b.g = a.g GROUP BY ALL),
e AS (SELECT x, y FROM o WHERE 100 * k >= 90 * (nx + ny - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) m USING (doc_id)
"""
