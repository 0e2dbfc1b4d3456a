"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's probability is the sum
over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The
probabilities are fitted by expectation maximisation (forward and backward) on a bounded hash sample of
labelled documents, whole texts, with the same number of documents for each language where there are enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, held_out, ship, slices, span_hashes, span_sums, utf8, words

#: Documents that the model is fitted on, about; each language has an equal part.
SAMPLE = 2000
ITERATIONS = 4
#: Characters after which sums over segmentations are scaled, so that those of long words don't underflow.
SCALED = 16
#: Characters of words whose sums are held at once, about.
CELLS = 500_000
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Bits of a table that tells most strings that are no piece.
SIEVE = 1 << 22

#: Bytes of words after lower-casing.
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model, lower-cased, of letters alone; a word's first piece isn't told apart."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i).replace("▁", "").lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in pieces if p and LETTERS[np.frombuffer(p.encode(), np.uint8)].all()})


class Pieces:
    """Finds pieces in words. Number 0 is any single character that is no piece."""

    def __init__(self, pieces: list[str]):
        data, offsets = utf8(pa.array(pieces, pa.string()))
        h = span_hashes(data, offsets[:-1], offsets[1:]) if len(pieces) else np.zeros(0, np.uint64)
        self.hashes = np.sort(h)
        self.size = len(h) + 1
        self.longest = max(map(len, pieces), default=1)
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(h % np.uint64(SIEVE)).astype(np.int64)] = True

    def number(self, h: np.ndarray) -> np.ndarray:
        """Of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        at = np.flatnonzero(self.sieve[(h & np.uint64(SIEVE - 1)).astype(np.int64)])
        if len(at) and len(self.hashes):
            i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            same = self.hashes[i] == h[at]
            out[at[same]] = i[same] + 1
        return out

    def lattices(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """The words data[starts:ends] by their number of characters: for each number n the words' indexes and an
        array (word, from character, characters - 1) of piece numbers, -1 for none."""
        is_char = (data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(is_char)])
        begin = np.append(np.flatnonzero(is_char), len(data))  # byte of each character
        first, n, sums = chars[starts], chars[ends] - chars[starts], span_sums(data)
        for size in np.unique(n[n > 0]).tolist():
            own = np.flatnonzero(n == size)
            for at in range(0, len(own), max(1, CELLS // size)):
                word = own[at : at + max(1, CELLS // size)]
                grid = np.full((len(word), size, min(self.longest, size)), -1, np.int32)
                for j in range(grid.shape[2]):
                    s = (first[word][:, None] + np.arange(size - j)).ravel()
                    found = self.number(span_hashes(data, begin[s], begin[s + j + 1], sums)).reshape(len(word), -1)
                    grid[:, : size - j, j] = np.where(found < 0, 0, found) if j == 0 else found
                yield word, grid


def forward(grid: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logs of sums over segmentations: (word, character, language), [:, 0] is 0. p: (piece, language)."""
    b, n, longest = grid.shape
    alpha = np.zeros((b, n + 1, p.shape[1]))
    alpha[:, 0] = 1
    scale, total = np.zeros_like(alpha), np.zeros((b, p.shape[1]))
    for e in range(1, n + 1):
        for j in range(min(longest, e)):
            g = grid[:, e - 1 - j, j]
            own = np.flatnonzero(g >= 0)
            if len(own):
                alpha[own, e] += alpha[own, e - 1 - j] * p[g[own]]
        scale[:, e] = total
        if e % SCALED == 0:  # all that later characters look back to is divided by the last sum
            window, by = slice(max(0, e + 1 - longest), e + 1), alpha[:, e].copy()
            alpha[:, window] /= by[:, None]
            scale[:, window] += np.log(by)[:, None]
            total = total + np.log(by)
    return np.log(alpha) + scale


def backward(grid: np.ndarray, p: np.ndarray) -> np.ndarray:
    mirrored = np.full_like(grid, -1)
    n = grid.shape[1]
    for j in range(grid.shape[2]):
        mirrored[:, : n - j, j] = grid[:, : n - j, j][:, ::-1]
    return forward(mirrored, p)[:, ::-1]


class LanguageModel:
    def __init__(self, languages: list[str], pieces: Pieces, p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p

    def word_logs(self, data, starts, ends) -> np.ndarray:
        out = np.zeros((len(starts), len(self.languages)))
        for word, grid in self.pieces.lattices(data, starts, ends):
            out[word] = forward(grid, self.p)[:, -1]
        return out

    def logs(self, texts: list[str | None]) -> np.ndarray:
        """Log-likelihood of each text in each language."""
        data, offsets = utf8(pa.array([(t or "").lower() for t in texts], pa.string()))
        h, s, e, rows = words(data[: offsets[-1]], offsets, LETTERS)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        own = self.word_logs(data, s[first], e[first])[inverse]
        return np.stack([np.bincount(rows, own[:, k], len(texts)) for k in range(len(self.languages))], 1) if len(h) and self.languages else np.zeros((len(texts), len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        logs = self.logs(texts)
        best = logs.argmax(1) if logs.shape[1] else np.zeros(len(texts), int)
        score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1) if logs.shape[1] else np.zeros(len(texts))
        known = [has_letter(t) and bool(self.languages) for t in texts]
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, score, 0.0)


def _word_counts(batches):
    """(lang, text) to (lang, word, n)."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            data, offsets = utf8(pa.array([(text or "").lower()], pa.string()))
            h, s, e, _ = words(data[: offsets[-1]], offsets, LETTERS)
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            raw = data.tobytes()
            found = [raw[a:b].decode(errors="replace") for a, b in zip(s[first].tolist(), e[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def fit(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learns from rows outside the held-out fold with a non-null language: about sample / languages documents of
    each, by hash of the id."""
    spark = df.sparkSession
    ship(spark)
    known = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(id_col) != 2))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    pieces = Pieces(vocabulary(vocabulary_path))
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], pieces, np.ones((pieces.size, 0)))
    space = 1 << 40
    limit = F.create_map(*[F.lit(x) for k in languages for x in (k, min(space, space * sample // (len(languages) * counts[k]) + 1))])
    chosen = known.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(space)) < F.try_element_at(limit, F.col(lang_col)))
    found = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_word_counts, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).toArrow()
    lang = np.searchsorted(languages, found.column("lang").to_pylist()) if len(found) else np.zeros(0, int)
    data, offsets = utf8(found.column("word"))
    return LanguageModel(languages, pieces, _maximise(pieces, data, offsets, lang, found.column("n").to_numpy(), len(languages)))


def _maximise(pieces: Pieces, data, offsets, lang, n, n_languages: int) -> np.ndarray:
    p = np.full((pieces.size, n_languages), 1 / pieces.size)
    lattices = list(pieces.lattices(data, offsets[:-1], offsets[1:]))
    for _ in range(ITERATIONS):
        expected = np.zeros((pieces.size, n_languages))
        for w, g in lattices:
            # each row counts for its own language alone
            weight = np.zeros((len(w), n_languages))
            weight[np.arange(len(w)), lang[w]] = n[w]
            alpha, beta = forward(g, p), backward(g, p)
            beta -= alpha[:, -1:]
            for i in range(g.shape[1]):
                for j in range(min(g.shape[2], g.shape[1] - i)):
                    own = np.flatnonzero(g[:, i, j] >= 0)
                    if len(own):
                        u = g[own, i, j]
                        x = np.exp(alpha[own, i] + beta[own, i + j + 1]) * p[u] * weight[own]
                        for k in range(n_languages):
                            expected[:, k] += np.bincount(u, x[:, k], pieces.size)
        expected += SMOOTHING
        p = expected / expected.sum(0)
    return p


def _predict(shared):
    def run(batches):
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, 1 << 20):
                part = batch.slice(a, b - a)
                lang, score = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["_id", "held_out", "lang_pred", "score"])

    return run


def keep_known(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose text predict() gives a language; a null text or one without a letter has none."""

    def run(batches):
        for batch in batches:
            _, offsets = utf8(batch.column(text_col))
            for a, b in slices(offsets, 1 << 20):
                part = batch.slice(a, b - a)
                lang, _ = shared.value.predict(part.column(text_col).to_pylist())
                yield part.filter(pa.array([x != UNDETERMINED for x in lang], pa.bool_()))

    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(run, df.schema)


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, held_out, lang_pred and score, the posterior of lang_pred under equal priors.

    A null text, or one without a letter, is und with score 0, and so is all where no language was learned. Of
    languages that tie the first by name is taken. A text of letters that are in no word (none of a-z and ASCII
    only) has equal posteriors. A null id is not held out. An empty df gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = docs.schema["_id"].dataType.simpleString()
    out = docs.mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"_id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("_id", id_col)
