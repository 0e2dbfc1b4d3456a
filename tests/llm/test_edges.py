"""Cases that the other tests leave out: depth and length, ties, repeated rows, clashing names, hot and cold sides."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, exact_dedup, html_text, language_id, mixing, quality, queries, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, _words long, _id int, copies int"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, lang, source, 1, 2, 3) for d, t, lang, source in rows], SCHEMA)


def test_pages_deep_long_and_crossed(spark):
    pages = [
        "<p>text</p>" + "<div>" * 30_000 + "deep", "<b>" * 20_000 + "t", "<p>" + "<b>x" * 20_000, "<div class=ad>" * 5000 + "x", "<b>" * 5000 + "<hr>x" * 2000,
        "<p><b>one<p>two</b></p>three", "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "<p>word " * 50_000,
    ]
    start = time.time()
    got = [html_text.extract_page(p)[0] for p in pages]
    assert time.time() - start < 30
    assert got[0] == "text\ndeep" and got[1] == "t" and got[2] == "x" * 20_000 and got[3] == "x" and got[4].count("x") == 2000
    assert got[5:7] == ["one\ntwo\nthree", "a\nb\nc\nd"] and got[7].count("word") == 50_000
    # a path is found again by its name, whatever its classes hold
    text, path, _ = html_text.extract_page("<body><div class='a>b c1'><p>x</p></div><p class=ad>y</p></body>")
    assert text == "x" and html_text.extract_page("<body><div class='a>b c2'><p>z</p></div></body>", path) == ("z", path, 0)


def test_hosts_broadcast_or_not(spark, monkeypatch):
    body = "<div class=%s><p>%s</p></div><nav>menu</nav>"
    rows = [(i // 2, f"http://h{i % 3}/{i}", body % ("ab"[i % 2] if i % 3 else "a", f"text {i}")) for i in range(24)] + [(None, None, None), (1, "http://h1/", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    plain = lambda out: sorted(map(repr, out.collect()))
    whole = plain(html_text.extract(df))
    assert len(whole) == len(rows)
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(html_text, "HOT", 1)
    assert plain(html_text.extract(df)) == whole
    # equal votes: the first path by name
    votes = html_text.winning_paths(spark.createDataFrame([("h", "<div class=b>text</div>"), ("h", "<div class=a>text</div>")], "host string, html string")).collect()
    assert [v.path for v in votes] == ["div.a"]


def test_exact_dedup_on_both_sides(spark, monkeypatch):
    """More groups than are broadcast, full tables, and rows that repeat id and text."""
    monkeypatch.setattr(exact_dedup, "HOT", 1)
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), f"t{min(rng.randrange(30), rng.randrange(30))}", None, None) for _ in range(200)]
    rows += rows[:20] + [(1, None, None, None), (2, "", None, None), (3, "x" * 100_000, None, None)]
    df = documents(spark, rows)
    least = lambda x: (x is not None, x or 0)
    for cells in (None, 1, 4096):
        got = exact_dedup.exact_dedup(df, cells=cells).collect()
        want = []
        for d, t, *_ in rows:
            same = [x for x, u, *_ in rows if (u or "") == (t or "")]
            keep = max(same, key=least)
            want.append((d, keep, len(same), d == keep))
        by = lambda r: (least(r[0]), least(r[1]), r[2])
        assert sorted([tuple(r)[:4] for r in got], key=by) == sorted(want, key=by)
    plan = exact_dedup.exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and Counter(r.text or "" for r in kept.collect() if r.text in (None, "")) == {"": 1}
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(df, cells=0)


def brute_best(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= budget}
    return max(sums)


def test_budgets_are_met_as_well_as_can_be():
    rng = random.Random(4)
    for _ in range(300):
        lengths = rng.sample(range(1, 60), rng.randrange(1, 7))
        counts = [rng.randrange(1, 5) for _ in lengths]
        budget = rng.randrange(1, sum(n * c for n, c in zip(lengths, counts)) + 3)
        take = mixing.fit_counts(lengths, counts, budget)
        got = sum(n * k for n, k in zip(lengths, take))
        assert all(0 <= k <= c for k, c in zip(take, counts)) and got <= budget
        if budget <= 2 * max(lengths):  # all of it is the dynamic programming's
            assert got == brute_best(lengths, counts, budget)
    lengths, counts = list(range(1, 20_001, 7)), [3] * 2858
    assert sum(n * k for n, k in zip(lengths, mixing.fit_counts(lengths, counts, 40_000_001))) == 40_000_001


def test_mix_draws_by_rank_and_by_bucket(spark, monkeypatch):
    rows = [(None if i % 9 == 0 else i // 2, "w " * (i % 3 + 1) if i % 5 else None, None, None if i % 4 == 0 else "ab"[i % 2]) for i in range(400)]
    df = documents(spark, rows + rows[:30])
    total = lambda out: Counter((r.doc_id, r.size, r.source_size, r.target) for r in out)
    whole = mixing.mix(df).collect()
    monkeypatch.setattr(mixing, "RANKED", 4)
    monkeypatch.setattr(mixing, "HOT", 1)
    cut = mixing.mix(df).collect()
    assert total(whole) == total(cut) and sum(r.taken for r in whole) == sum(r.taken for r in cut)
    assert sorted(map(repr, cut)) == sorted(map(repr, mixing.mix(df).collect()))
    # the rows themselves: as many words of each source as the plan says, repeated ids or not
    for rows_at_most in (1 << 19, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", rows_at_most)
        taken = mixing.take(df)
        assert taken.columns == df.columns
        words, want = Counter(), Counter()
        for r in taken.collect():
            words[r.source] += len(r.text.split())
        sources = {(r.source_size, r.target): None for r in cut}
        for r in cut:
            want[r.source_size, r.target] += r.taken
        assert sorted(words.values()) == sorted(want[s] for s in sources if want[s])


def test_letters():
    for text, letter in ((None, False), ("", False), ("½ ² Ⅷ 12 _", False), ("漢", True), ("1é", True), ("-", False)):
        assert language_id.has_letter(text) == letter


def test_language_of_long_repeated_and_empty(spark):
    rows = [(i, "the house and the water " * 3 if i % 2 else "das haus und der fluss " * 3, "en" if i % 2 else "de", None) for i in range(80)]
    rows += [(500, "the house " * 30_000, None, None), (501, "x" * 50_000, None, None), (502, None, None, None), (502, None, None, None), (503, "½ 12", None, None), (None, "das haus", None, None)]
    df = documents(spark, rows)
    model = language_id.fit(df, queries.tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert got[500].lang_pred == "en" and got[501].lang_pred in ("de", "en") and got[502].lang_pred == got[503].lang_pred == "und" and got[None].lang_pred == "de"
    assert got[502].score == 0 and not got[None].held_out and language_id.predict(df.limit(0), model).collect() == []
    kept = language_id.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_whole_texts_language_scores_equal_a_plain_sum():
    """Texts against a plain recursion over the words' segmentations, in logs."""
    pieces = language_id.Pieces(["a", "b", "ab", "abababababab", "ba"])
    p = np.random.default_rng(5).random((pieces.size, 3))
    p /= p.sum(0)
    model = language_id.LanguageModel(["x", "y", "z"], pieces, p)
    number = {s: int(pieces.number(language_id.span_hashes(np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(s)])))[0]) for s in ("a", "b", "ab", "abababababab", "ba")}
    texts = ["ab, ABA 12 ba!", "ab" * 20 + " é b", "", None, "q " * 50 + "ab" * 9]
    logs = []
    for t in texts:
        total = np.zeros(3)
        for w in re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").lower()):
            sums = [np.zeros(3)]
            for e in range(1, len(w) + 1):
                ways = [sums[e - len(s)] + np.log(p[n]) for s, n in number.items() if w[:e].endswith(s)]
                if w[e - 1] not in number:
                    ways.append(sums[e - 1] + np.log(p[0]))
                sums.append(np.logaddexp.reduce(ways))
            total = total + sums[-1]
        logs.append(total)
    assert model.logs(texts) == pytest.approx(np.array(logs))
    lang, score = model.predict(texts)
    for t, own, name, s in zip(texts, logs, lang, score):
        if t and any(c.isalpha() for c in t):
            assert name == "xyz"[int(np.argmax(own))] and s == pytest.approx(1 / np.exp(own - own.max()).sum())


def test_votes_equal_brute_force():
    """Scores against cosine similarities of all pairs, sorted; equal neighbours, and texts of no byte or many."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["one", "Two", "3", "four.", "FIVE!"]) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    texts += texts[:10] + ["", "x" * 100_000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    x = quality.terms(data, np.cumsum([0, *map(len, texts)]))
    labels = np.array([rng.randrange(2) for _ in texts])
    voter = quality.Voter(x, labels)
    got = voter.score(x, block=7)
    v = voter.embed(x)
    for i in range(len(texts)):
        cosine = v @ v[i]
        near = np.sort(cosine)[::-1]
        if near[quality.NEIGHBOURS - 1] - near[quality.NEIGHBOURS] < 1e-6:
            assert 0 <= got[i] <= 1  # a tie at the border: any of the equals votes
            continue
        own = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[own], 0) ** quality.SHARPNESS + 1e-6
        assert got[i] == pytest.approx((weight * labels[own]).sum() / weight.sum(), abs=1e-3)


def test_urls_long_repeated_tied_and_clashing(spark):
    urls = ["http://a.net/x", "http://b.org/fr/x", "http://c.example/" + "y" * 50_000, None, "", "http://c.example/x", "http://c.example/x"]
    df = spark.createDataFrame([(i // 2, u, "p", "r", 0.5) for i, u in enumerate(urls * 2)], "page_id long, url string, path string, rule string, score double")
    got = url_filter.url_filter(df, queries.URL_RULES).collect()
    assert len(got) == len(urls) * 2 and {r.verdict for r in got} <= {"allow", "block"}
    same = {(r.path, r.verdict, r.score) for r in got if r.host == "c.example" and r.path == "/x"}
    assert len(same) == 1
    # no rule: nothing was learned, so all pass
    assert {r.verdict for r in url_filter.url_filter(df, []).collect()} == {"allow"}


@pytest.mark.parametrize("block", [16 << 20, 30])
def test_pipeline_stage_decontamination(spark, monkeypatch, block):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, item, None, None), (1, "clean words only", None, None), (None, f"a {item} b", None, None), (None, "clean", None, None), (2, item + " z" * 2000, None, None), (3, None, None, None)]
    df = documents(spark, rows)
    bench = spark.createDataFrame([("i1", item), ("i2", "other item text here"), (None, "clean words only"), ("i3", None)], "item_id string, text string")
    kept = decontaminate.drop_contaminated(df, bench, block_bytes=block)
    assert kept.columns == df.columns and sorted((r.text or "")[:5] for r in kept.collect()) == ["", "clean", "clean", "w0 w1"]
    assert decontaminate.drop_contaminated(df.limit(0), bench, block_bytes=block).collect() == []
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(rows)


def test_pipeline_on_nulls_repeats_and_nothing(spark, tmp_path):
    rng = random.Random(9)
    words = {"en": "the house and water with from over".split(), "de": "das haus und wasser mit aus dem".split()}
    text = lambda k, n: " ".join(rng.choice(words[k]) + str(rng.randrange(300)) for _ in range(n))
    rows = [(i, text("de" if i % 3 else "en", 60), "de" if i % 3 else "en", "ab"[i % 2]) for i in range(60)]
    item = rows[7][1]
    rows += [(100, rows[0][1], "en", None), (None, None, None, None), (101, "", None, "a"), (3, text("en", 30), "en", "a"), (3, text("en", 30), "en", "a"), (102, item + " end", "de", "b"), (103, "12 34", None, "a")]
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([("i", " ".join(item.split()[:40]))], "item_id string, text string")
    for folder, own in (("all", docs), ("none", docs.limit(0))):
        own.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/all").collect()
    assert [r.start for r in sorted(out, key=lambda r: r.start)] == np.cumsum([0, *[r.n_tokens for r in sorted(out, key=lambda r: r.start)]])[:-1].tolist()
    ids = Counter(r.doc_id for r in out)
    assert not {7, 100, 102, 101, 103, None} & set(ids) and max(ids.values()) <= 6
    kept = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        kept = f(spark, kept, f"{tmp_path}/all")
        assert kept.columns == docs.columns, name
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
