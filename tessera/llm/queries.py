"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

import os

from . import decontaminate, exact_dedup, html_text, language_id, mixing, ngram_join, quality, suffix_dedup, token_codes, url_filter
from .common import table


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op2_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer_path(name="word_bpe_49k.json"):
    """Of a public vocabulary; TOKENIZER_DIR names another folder than the installed one."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_codes(spark, sf_dir, documents=None):
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    return token_codes.read_digest(spark, token_codes.write_tokens(documents, tokenizer_path()))


def op5_mixing(spark, sf_dir, documents=None):
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    return mixing.mix(documents).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontaminate(spark, sf_dir, documents=None):
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    return decontaminate.digest(decontaminate.find(documents, table(spark, sf_dir, "benchmark")))


def op7_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.fit(documents, tokenizer_path("piece_bpe_32k.model")))


def op8_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql():
    return {"op2_ngram_join": ngram_join.SQL, "op3_exact_dedup": exact_dedup.SQL, "op6_decontaminate": decontaminate.SQL, "op9_suffix_dedup": suffix_dedup.SQL}
