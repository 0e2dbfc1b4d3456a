"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing, token codes.

Each stage takes (spark, docs, sf_dir); run() writes its rows as Parquet into the shared folder and reads them
again as the next stage's docs. All stages but the last return the columns of documents, whatever others docs has
as well. An empty docs gives no rows at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.llm import decontaminate, language_id, mixing, ngram_join, queries
from tessera.llm.common import stage, table


#: Words of a shingle and the least Jaccard similarity, in per cent, of near copies; op2 has constants of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_known_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language can be told; the others (null, or no letter) go. Where no row has a language, all go."""
    return language_id.keep_known(docs, language_id.fit(docs, queries.tokenizer_path("piece_bpe_32k.model")))


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of links: near copies by NEAR_WORDS and NEAR_PERCENT.
    Null ids and texts without words stay; rows that repeat an id stay or go together."""
    return ngram_join.keep_one(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words is in benchmark windows go; null texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, from never to three times; those without words go. Rows that repeat an
    id count as so many rows, and a null source is a source."""
    return mixing.take(docs)


def write_token_codes(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the written token files, as of op4; a row for each copy, null texts with the end id alone."""
    return queries.op4_token_codes(spark, sf_dir, docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_token_codes),
]

#: The model's decisions and the seeded draws have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
