"""Each operator against a plain version on small tables with nulls, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import decontaminate, exact_dedup, html_text, language_id, mixing, quality, queries, token_codes, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, label int, kept string, host string"
TEXTS = [None, "", " ", "One two, THREE!", "one two, three!", "x" * 9000, "don't <s> é ß 漢字 ×", "a b " * 3000, "12 345", "One two, THREE!"]


def documents(spark, rows=None):
    rows = [(i, t, "en", None if i == 3 else f"s{i % 3}", 1, "k", "h") for i, t in enumerate(TEXTS)] + [(None, "one", None, None, 1, "k", "h")] if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_dedup(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    for d, t in rows:
        same = [x for x, u in rows if u == t]
        keep = max(same, key=lambda x: (x is not None, x or 0))
        assert (got[d].keep_id, got[d].group_size, got[d].kept, got[d].text_sha256) == (keep, len(same), d == keep, hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(documents(spark, [])).collect() == []


@pytest.mark.parametrize("top", [0, 255, 256, 70_000, 2**32 - 1])
def test_codes_give_every_token(top):
    ids = np.random.default_rng(top).integers(0, top + 1, 3000, dtype=np.uint32)
    levels = token_codes.dac_encode(ids)
    assert token_codes.dac_decode(levels).tolist() == ids.tolist()
    assert [token_codes.dac_access(levels, i) for i in range(0, 3000, 7)] == ids[::7].tolist()


def test_token_files_are_the_tokenizers(spark):
    docs = documents(spark)
    path = token_codes.write_tokens(docs, queries.tokenizer_path())
    whole, start, ids = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    got = {r.doc_id: r for r in token_codes.read_digest(spark, path).collect()}
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        own = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes()))
        start, ids = start + len(own), ids + own
    for i in (0, len(ids) // 2, len(ids) - 1):
        assert token_codes.read_token(spark, path, i) == ids[i]
    assert token_codes.read_digest(spark, token_codes.write_tokens(documents(spark, []), queries.tokenizer_path())).collect() == []


def test_token_codes_in_many_buckets(spark, monkeypatch):
    rows = [(i * 7 % 101 if i else None, f"word{i} " * (i % 5)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda: token_codes.read_digest(spark, token_codes.write_tokens(docs, queries.tokenizer_path())).collect()
    whole = sorted(map(tuple, digest()), key=lambda r: r[1])
    monkeypatch.setattr(token_codes, "BUCKET_BYTES", 100)
    assert sorted(map(tuple, digest()), key=lambda r: r[1]) == whole
    monkeypatch.setattr(token_codes, "BUCKETS", 3)
    assert sorted(map(tuple, digest()), key=lambda r: r[1]) == whole and len(whole) == 60


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 3, 17, 60]), None, rng.choice(["a", "a", "a", "b", "c", None]), 0, "k", "h") for i in range(400)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert sorted(got) == sorted(mixing.mix(documents(spark, rows)).collect())
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1])) and 0 <= r.taken <= 3 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    # weights 5, 2, 1, 5; a source that reaches three times its size gives the rest to the others
    open_, left, want = dict(zip(["a", "b", "c", None], [5, 2, 1, 5])), sum(sizes.values()), {}
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in share if share[s] > 3 * sizes[s]]
        for s in full or list(share):
            want[s] = 3 * sizes[s] if full else share[s]
            left -= want[s] if full else 0
            del open_[s]
    for s in want:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    assert mixing.mix(documents(spark, [])).collect() == []


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(f"i{k}", " ".join(rng.choice("abcd") for _ in range(n))) for k, n in enumerate([0, 1, 5, 12, 13, 14, 30, 40])] + [(None, "a b"), ("i9", None), ("i4", "é É x-y")]
    texts = [" ".join([rng.choice("abcd") for _ in range(40)] + (items[k % 8][1].split() if k % 2 else []) + ["Z", "É", "x", "y"][: k % 5]) for k in range(30)] + TEXTS
    rows = [(i, t, None, None, 0, "k", "h") for i, t in enumerate(texts)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 12)) if item and w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.find(documents(spark, rows), bench)).collect()}
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if who := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n)) if len(w[i : i + n]) == n else set()
                    found |= who if len(w[i : i + n]) == n else set()
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert tuple(got[d]) == (d, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))
    assert {r.n_hit for r in decontaminate.find(documents(spark), bench.limit(0)).collect()} == {0}


def test_url_rules_and_edges(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q", "https://example.net/fr", "ftp://de.example.com/de/#f", "http://notexample.com/de/", "x://org/fr/1", "http://h"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(df, queries.URL_RULES).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 2, 3, 5, 8)] == [("", ""), ("", ""), ("", ""), ("a.example.net", "/en/x"), ("de.example.com", "/de/"), ("h", "")]
    assert [got[i].rule for i in range(9)] == [None, None, None, "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None]
    assert [got[i].verdict for i in (3, 4, 5, 7)] == ["allow", "block", "block", "allow"] and {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.url_filter(df.limit(0), queries.URL_RULES).collect() == []


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(["ab", "b", "bc", "abc"])
    p = np.random.default_rng(1).random((pieces.size, 2))
    model = language_id.LanguageModel(["x", "y"], pieces, p)

    def number(s):
        from tessera.llm.common import span_hashes

        n = pieces.number(span_hashes(np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(s)])))[0]
        return 0 if n < 0 and len(s) == 1 else n

    def total(s):
        return 1 if not s else sum(p[number(s[:k])] * total(s[k:]) for k in range(1, len(s) + 1) if number(s[:k]) >= 0)

    for word in ("abcab", "bcbc", "zabc"):
        assert model.logs([word])[0] == pytest.approx(np.log(total(word)))


def test_language_and_quality_held_out(spark):
    rng = random.Random(2)
    words = {"en": "the quick house over with that water from".split(), "de": "der schnelle und wasser nicht mit haus über".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k, "s", 0, "k", "h") for i in range(160) for k in [rng.choice(["en", "de"])]]
    bad = {i for i in range(160) if rng.random() < 0.5}
    rows = [(i, "BUY!!! 99 99 99 $$$ " * 8 + t if i in bad else t, *rest) for i, t, *rest in rows]
    rows += [(500, None, "en", "s", 0, "k", "h"), (501, "12 !", None, "s", 0, "k", "h"), (None, "the water", None, "s", 0, "k", "h")]
    docs, lang = documents(spark, rows), {r[0]: r[2] for r in rows}
    got = language_id.predict(docs, language_id.fit(docs, queries.tokenizer_path("piece_bpe_32k.model"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == ("und" if r.doc_id in (500, 501) else "en" if r.doc_id is None else lang[r.doc_id])
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id is not None and r.doc_id < 160]
    assert held and np.mean([(r.score >= 0.5) == (r.doc_id not in bad) for r in held]) > 0.9
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0), queries.tokenizer_path("piece_bpe_32k.model"))).collect()} == {"und"}


def test_html_text(spark):
    body = "<p>First &amp; long   sentence of the article, with commas, and more.</p><p>Second one, which is<br>long enough too, is it not.</p>"
    page = f"<html><head><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav><div class='main'>{body}</div><script>var a;</script><footer>Foot</footer></body></html>"
    df = spark.createDataFrame([(1, "http://h/1", page, "x"), (2, "http://h/2", page, "x"), (3, None, None, "x"), (4, "http://h/3", "", "x")], "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == got[2].text == "First & long sentence of the article, with commas, and more.\nSecond one, which is long enough too, is it not."
    assert got[1].n_chars == len(got[1].text) and (got[3].text, got[4].text, got[3].n_chars) == ("", "", 0)
    assert html_text.extract(df.limit(0)).collect() == []


def test_url_scores_keep_every_ngram(spark):
    """Over 1,000,000 distinct n-grams; scores against a plain model that counts them all."""
    rng = random.Random(3)
    name = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    urls = [f"http://{h}/{name(50)}" for h in ("a.net", "b.org/fr") for _ in range(5000)]
    free = [u.replace("a.net", "c.example").replace("b.org/fr", "d.example") for u in rng.sample(urls, 40)] + [None, ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + free)], "page_id long, url string")
    counts, order = [Counter(), Counter()], url_filter.ORDER
    symbols = lambda u: [url_filter.START] * order + list((u or "").encode()) + [url_filter.END]
    for u in urls:
        if zlib.crc32(u.encode()) % url_filter.CALIBRATION:
            s, own = symbols(u), counts["a.net" in u]
            own.update(tuple(s[i - k : i + 1]) for k in range(order + 1) for i in range(max(order - 1, k), len(s)))
            own[()] += len(s) - order
    assert len(set(counts[0]) | set(counts[1])) > 1_000_000
    got = {r.page_id: r for r in url_filter.url_filter(df, queries.URL_RULES).collect()}
    assert len(got) == len(urls) + len(free)
    for d, u in enumerate(free, len(urls)):
        s, logs = symbols(u), [0.0, 0.0]
        for side in (0, 1):
            for i in range(order, len(s)):
                p = 1 / 256
                for k in range(order + 1):
                    n = counts[side][tuple(s[i - k : i])]
                    p = (counts[side][tuple(s[i - k : i + 1])] + url_filter.MASS * p) / (n + url_filter.MASS) if n else p
                logs[side] += np.log(p)
        assert got[d].score == pytest.approx((logs[1] - logs[0]) / (len(s) - order), abs=1e-9)


def test_html_text_keeps_the_whole_article(spark):
    lead, long, rest = "<p>A lead of the article, here.</p>", "<p>" + "Long text of the article. " * 9 + "</p>", "<p>Some more text that belongs to it.</p>"
    flat = lambda s: re.sub(" +", " ", re.sub("<[^>]*>", " ", s)).strip()
    pages = [
        f"<article><h1><a href=x>Head</a></h1>{lead}<div class=body>{long}</div></article>",
        f"<article><h1><a href=x>Head</a></h1><div class=body>{lead}{long}</div></article>",
        f"<div class=post><h1><a href=x>Head</a></h1><div class=body>{lead}{long}</div></div>",
        f"<article><section>{long}</section><section>{rest}</section></article>",
        f"<article>{lead}<ul><li>{long}</li></ul></article>",
        # another template, with a small container of the host's path
        f"<div class=story>{long}{lead}</div>",
        f"<div class=story>{lead}</div><div class=other>{long}{rest}</div>",
    ]
    rows = [(i, f"http://{'h' if i > 4 else i}/{i}", f"<html><body><nav><a href=x>Menu</a></nav>{p}</body></html>") for i, p in enumerate(pages)]
    rows += [(9, "http://h/9", rows[5][2])]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, p in enumerate(pages):
        assert got[i].text.split() == flat(p).split()


def test_html_text_of_wrappers_with_noise_words():
    body, menu = "<p>" + "Text of the article. " * 9 + "</p>", "<div class='site-footer'>Foot</div><div id=adBanner>Ad</div><div class='x promo'>Buy</div>"
    text = lambda page: html_text.extract_page(f"<html><body>{page}</body></html>")
    want = ("Text of the article. " * 9).strip()
    for attributes in ("class='content no-sidebar'", "id=page-with-footer", "class=search-result-article", "class=promo", "role=banner"):
        assert text(f"<div {attributes}>{body}</div>{menu}")[0] == want
        assert text(f"<div {attributes}>{body}</div>{menu}")[2] > 0
        # little text, but an article or main of its own
        for tag in ("article", "main"):
            assert "Short." in text(f"<div {attributes}><{tag}><p>Short.</p></{tag}></div><div>{body}</div>{menu}")[0]
    assert text(f"<h1 class=post-header>Head</h1>{body}{menu}")[0] == "Head\n" + want
    assert text(f"<h1 class=header>Head</h1>{body}{menu}")[0] == "Head\n" + want
    # comments stay out, as articles inside the article too
    assert text(f"<article>{body}<div class=comments><article>Nice.</article></div></article>{menu}")[0] == want
    # an advertisement longer than the article beside it
    assert text(f"<div class=ad>{body}</div><article><p>Short.</p></article>{menu}")[0] == "Short."
    # without a text beside names of noise, names are no reason
    assert text("<div class=promo>One</div><div class=notice>Two</div>")[0] == "One\nTwo"
    assert text(f"<p>In <span class=ad>Ad</span> line</p>{body}")[0] == "In line\n" + want


def test_decontamination_in_blocks_equals_one_block(spark):
    rng = random.Random(4)
    items = [(f"i{k}", " ".join(rng.choice("abcd") for _ in range(n))) for k, n in enumerate([3, 5, 7, 13, 14, 20, 30])]
    texts = [" - ".join(rng.choice(items)[1] for _ in range(k % 4)) + " z" * (k % 3) for k in range(30)]
    # null and repeated ids, of unlike and of equal texts
    rows = [(None if k % 5 == 0 else k // 3, t, None, None, 0, "k", "h") for k, t in enumerate([*texts, *texts[:9], None, ""])]
    bench, docs = spark.createDataFrame(items, "item_id string, text string"), documents(spark, rows)
    plain = lambda found: sorted(map(repr, found.collect()))
    one, many = decontaminate.find(docs, bench), decontaminate.find(docs, bench, block_bytes=40)
    assert many.schema == one.schema and plain(many) == plain(one) and len(plain(one)) == len(rows)
    assert decontaminate.find(docs.limit(0), bench, block_bytes=40).collect() == []


def test_forward_crosses_long_words_and_pieces():
    """Pieces of over 8 characters, words of over 24, and a word whose probability has no float of its own."""
    names = ["a", "b", "ab", "abababababab", "bb"]
    pieces = language_id.Pieces(names)
    p = np.random.default_rng(2).random((pieces.size, 2)) / 10
    number = {s: int(pieces.number(language_id.span_hashes(np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(s)])))[0]) for s in names}
    model = language_id.LanguageModel(["x", "y"], pieces, p)
    for word in ("ab" * 6, "ab" * 17 + "b", "bab" * 13 + "c", "ab" * 1500):
        logs = [np.zeros(2)]
        for e in range(1, len(word) + 1):
            ways = [logs[e - len(s)] + np.log(p[number[s]]) for s in names if word[:e].endswith(s)] or [logs[e - 1] + np.log(p[0])]
            logs.append(np.logaddexp.reduce(ways))
        assert model.logs([word])[0] == pytest.approx(logs[-1])
    assert max(map(len, language_id.vocabulary(queries.tokenizer_path("piece_bpe_32k.model")))) > 8
    data, offsets = np.frombuffer(("ab" * 1500).encode(), np.uint8), np.array([0, 3000])
    assert np.isfinite(language_id._maximise(pieces, data, offsets, np.array([0]), np.array([1]), 2)).all()
