import hashlib
import random

from tessera.llm import suffix_dedup

SCHEMA = "doc_id long, text string, cid string, docs int"


def brute(rows, threshold):
    """Every string of threshold bytes with the smallest id that has it; a byte under one of a smaller id goes."""
    texts = [(-(2**63) if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in texts:
        for i in range(len(t) - threshold + 1):
            w = t[i : i + threshold]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - threshold + 1):
            if least[t[i : i + threshold]] < d:
                gone[i : i + threshold] = b"\1" * threshold
        rest = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def as_null(rows):
    return sorted((-(2**63) if r[0] is None else r[0], *r[1:5]) for r in rows)


def got(spark, rows, threshold=50):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return [tuple(r) for r in suffix_dedup.remove_repeats(df, threshold).collect()]


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abé z") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.choice([3, 12, 30]))) for _ in range(12)]
    texts = []
    for _ in range(60):
        texts.append(" ".join(x for _ in range(rng.randrange(5)) for x in (" ".join(word() for _ in range(rng.randrange(8))), rng.choice(passages))))
    texts += [None, "", "a" * 49, "a" * 50, "a" * 51, "a" * 400, "ab" * 200, "b" + "ab" * 30, texts[5], texts[5], "x" * 30 + passages[0] + "y" * 30]
    texts.append("".join(rng.choice("pqrstuv ") for _ in range(60_000)) + (texts[7] or ""))
    ids = list(range(-3, len(texts) - 3))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + rows[3:6] + [(None, texts[9]), (rows[0][0], texts[10])]


def test_equals_brute_force(spark):
    rows = corpus()
    for threshold in (50, 16):
        out = got(spark, rows, threshold)
        assert as_null(out) == brute(rows, threshold)
        assert sum(r[0] is None for r in out) == 1  # a null id comes back as null


def test_text_and_spans_agree(spark):
    rows = [(1, "q" * 10 + "the same passage of more than fifty bytes, in two documents"), (2, "the same passage of more than fifty bytes, in two documents" + "z" * 9)]
    first, second = sorted(got(spark, rows))
    assert bytes(first[5]).decode() == rows[0][1] and first[6] == []
    assert bytes(second[5]) == b"z" * 9 and [tuple(s) for s in second[6]] == [(0, 59)]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_copies_that_are_broadcast_and_not(spark, monkeypatch):
    """One text of two with copies is broadcast; groups and buckets of a few bytes."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 64)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 64)
    rng = random.Random(5)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(2))
    texts = [a] * 6 + [b] * 3 + ["x" + a, b + "y", a[:80] + b[:70], "short"] + ["short"] * 3 + [None, ""]
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)]
    assert as_null(got(spark, rows)) == brute(rows, 50)


def test_ranks_count_and_drop():
    import numpy as np

    rng = np.random.default_rng(3)
    group, context = rng.integers(0, 3, 500), rng.integers(0, 256, (500, 3)).astype(np.uint8) // 60
    for depth, rank in enumerate(suffix_dedup._ranks(group, [context[:, k] for k in range(3)])):
        keys = [(g, *c[:depth]) for g, c in zip(group.tolist(), context.tolist())]
        order = sorted({k for k in keys if not depth or keys.count(k) > 1})
        for k, r in zip(keys, rank.tolist()):
            assert (r >= 0) == (not depth or keys.count(k) > 1)
        known = [(k, r) for k, r in zip(keys, rank.tolist()) if r >= 0]
        assert len({r for _, r in known}) == len(order) and sorted(known) == sorted(known, key=lambda x: x[1])
