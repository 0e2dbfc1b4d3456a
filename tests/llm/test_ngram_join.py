import random
import re

import numpy as np
import pytest

from tessera.llm import ngram_join

SCHEMA = "doc_id long, text string, cid string, leader int"


def brute(rows, size=3, percent=90):
    """Sets of word sequences, all pairs, and the smallest id that is reached."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def got(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return [tuple(r) for r in ngram_join.join(df, **more).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def corpus():
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))] for _ in range(20)]
    family = [f"v{rng.randrange(5000)}" for _ in range(100)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randrange(3)):
                c[rng.randrange(len(c))] = f"n{rng.randrange(1000)}"
            texts.append("\t".join(c).title() if rng.random() < 0.3 else " ".join(c))
    for _ in range(60):  # a family whose members link with some of the others only
        c = list(family)
        for _ in range(rng.randrange(5)):
            c[rng.randrange(len(c))] = f"n{rng.randrange(1000)}"
        texts.append(" ".join(c))
    texts += [None, "", " \t", "one", "ONE", "one two", "É a b c", "é a b c", "long " * 20000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + rows[:2] + [(None, "one"), (None, "nobody else has this"), (None, None)]


@pytest.mark.parametrize("group,queries,hot", [(16 << 20, 4096, 1024), (2000, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, group, queries, hot):
    monkeypatch.setattr(ngram_join, "GROUP_BYTES", group)
    monkeypatch.setattr(ngram_join, "QUERIES", queries)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "NEAR_ROWS", 1 << 15 if group > 2000 else 3)
    rows = corpus()
    assert order(got(spark, rows)) == order(brute(rows))
    if hot == 1:
        assert order(got(spark, rows, size=5, percent=80)) == order(brute(rows, 5, 80))


@pytest.mark.parametrize("percent", [50, 66, 80, 90, 97, 100])
def test_linked_sets_share_a_key(percent):
    """Random pairs around the bound, of all sizes, small ones with empty parts among them."""
    parts, rng = ngram_join.Parts(percent), np.random.default_rng(percent)
    linked = 0
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 5, 8, 9, 20, 60, 200, 500]))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        cut, new = rng.integers(0, max(1, n * (100 - percent) // 90) + 1, 2)
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[cut:]], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        linked += 1
        keys, rows = parts.keys(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]))
        common = np.intersect1d(keys[rows == 0], keys[rows == 1])
        assert (np.diff(rows) >= 0).all() and len(common)
        kept = parts.promising(keys, rows, np.array([len(a), len(b)]), np.isin(keys, common))
        assert set(keys[kept & (rows == 0)].tolist()) & set(keys[kept & (rows == 1)].tolist())
    assert linked > 300


@pytest.mark.parametrize("percent", [80, 90])
def test_no_linked_set_is_left_out_of_a_group(percent):
    """Families, chance meetings and one common passage: whoever links with another is kept, and few others are."""
    parts, rng = ngram_join.Parts(percent), np.random.default_rng(percent)
    new = lambda m: rng.integers(0, 2**63, m, dtype=np.uint64)
    sets, common = [], new(60)
    for _ in range(12):
        base = new(int(rng.integers(200, 260)))
        for _ in range(5):
            sets.append(np.unique(np.concatenate([base[rng.integers(0, 2 * (100 - percent)) :], new(int(rng.integers(0, 100 - percent)))])))
    sets += [np.unique(np.concatenate([common, new(int(rng.integers(140, 190)))])) for _ in range(60)]
    n = np.array([len(x) for x in sets])
    linked = [any(i != j and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    found: dict = {}
    for row, level, vec in parts.vectors(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), n):
        found.setdefault(level, []).append((row, vec))
    kept = np.zeros(len(sets), bool)
    for own in found.values():
        at = np.array([r for r, _ in own])
        kept[at] |= ngram_join.near(np.stack([v for _, v in own]), n[at], parts)
    assert all(kept[linked]) and 20 < sum(linked) and kept.sum() <= sum(linked) + 10


def test_empty_table(spark):
    assert got(spark, []) == []


def test_keep_one(spark, monkeypatch):
    df = spark.createDataFrame([(5, "a b c d", "x", 1), (3, "A b c d", "x", 1), (9, None, "x", 1), (None, "a b c d", "x", 1)], SCHEMA)
    assert sorted((r[0] or 0) for r in ngram_join.keep_one(df).collect()) == [0, 3, 9]
    # ids too many to broadcast; repeated ids and a clashing name
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    df = df.unionByName(df).withColumnRenamed("cid", "_id").withColumnRenamed("leader", "component_id")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted((r[0] or 0) for r in kept.collect()) == [0, 0, 3, 3, 9, 9]


def test_pipeline_drops_near_copies_of_five_words(spark):
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = text(400), text(400), text(400)
    spread = [w if i % 60 else "new" for i, w in enumerate(b)]  # about 1.75 % of the words
    rows = [(1, a), (2, a + text(60)), (3, b), (4, spread), (5, c), (6, c + text(110)), (None, a)]
    rows = [(d, " ".join(w)) for d, w in rows]
    near = lambda i, j, size, percent: len({k[2] for k in brute([rows[i], rows[j]], size, percent)}) == 1
    assert [near(i, i + 1, 5, 80) for i in (0, 2, 4)] == [True, True, False] and not near(0, 1, 3, 90) and not near(4, 5, 3, 90)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6]
