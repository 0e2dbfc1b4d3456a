"""Exact dedup: two-pass Bloom filtering, in DataFrame functions alone.

Pass one counts, for each of two independent hashes of a text, how many rows fall on each cell of a bit table, and
keeps the cells with two rows or more as 64-bit words. A table has 16 cells a row or more, up to MOST_CELLS, which
bounds the broadcast (MOST_CELLS / 64 words, and only those with a bit). Pass two probes both tables: a row of which a
cell has one row only cannot have an equal text, and passes straight through; the others are grouped by SHA-256.
Pass one sends a cell number for each row, not the row; digests are only shuffled for rows that may repeat, texts never.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Groups that may hold a large share of the rows; any other holds less than a 1/HOT of them.
HOT = 1024
#: Rows of an id and a digest that are broadcast, at most.
BROADCAST_ROWS = 1 << 19
#: Cells of a table, at most.
MOST_CELLS = 1 << 28


def _cells(rows: int) -> int:
    return min(MOST_CELLS, max(1 << 10, 1 << (16 * rows).bit_length()))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None) -> DataFrame:
    """One row per row of df: its id, keep_id, group_size, kept and text_sha256.

    Of rows with equal texts the largest id stays. A null text counts as empty. A null id is smaller than
    any other, and keep_id is null only where all ids of a group are. Rows that repeat id and text are one
    document: kept alike, each counted in group_size. Other columns of df are ignored; an empty df gives no
    rows; texts of any length are read whole. cells: of each of the two bit tables; by default from the number of rows.
    """
    if cells is not None and cells < 1:
        raise ValueError("cells must be 1 or more")
    digests = stage(
        df.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256")), "dedup-digests"
    )
    cells, rows = cells or _cells(digests.count()), digests
    for i in (1, 2):
        rows = rows.withColumn(f"_cell{i}", F.pmod(F.xxhash64(F.lit(i), F.col("text_sha256")), F.lit(cells)))
    for i in (1, 2):
        cell = F.col(f"_cell{i}")
        twice = rows.groupBy(cell).agg(F.count("*").alias("_n")).filter("_n > 1")
        words = twice.groupBy(F.shiftright(cell, 6).alias(f"_word{i}")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(_cell{i} & 63 AS int))")).alias(f"_bits{i}"))
        rows = rows.withColumn(f"_word{i}", F.shiftright(cell, 6)).join(F.broadcast(words), f"_word{i}", "left")
    bit = lambda i: F.coalesce(F.expr(f"getbit(_bits{i}, cast(_cell{i} & 63 AS int)) = 1"), F.lit(False))
    maybe = bit(1) & bit(2)
    rows = rows.select("doc_id", "text_sha256", maybe.alias("_maybe"))

    groups = (
        rows.filter("_maybe").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    )
    hot = groups.orderBy(F.desc("group_size"), "text_sha256").limit(HOT).select("text_sha256", F.col("keep_id").alias("_k"), F.col("group_size").alias("_n"))
    seen = rows.join(F.broadcast(hot), "text_sha256", "left")
    straight = seen.filter(~F.col("_maybe") | F.col("_n").isNotNull()).select(
        "doc_id", F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_k")).alias("keep_id"), F.coalesce("_n", F.lit(1)).alias("group_size"), "text_sha256"
    )
    rest = seen.filter(F.col("_maybe") & F.col("_n").isNull()).select("doc_id", "text_sha256").join(groups, "text_sha256", "left")
    rest = rest.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    out = straight.unionByName(rest)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("bigint"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None) -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns. Texts aren't shuffled where BROADCAST_ROWS rows or fewer go."""
    gone = exact_dedup(df, id_col, text_col, cells).filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha")).distinct()
    gone = stage(gone, "dedup-gone")
    few = gone.count() <= BROADCAST_ROWS
    sha = F.sha2(F.coalesce(df[text_col], F.lit("")).cast("binary"), 256)
    return df.join(F.broadcast(gone) if few else gone, df[id_col].eqNullSafe(F.col("_gone")) & (sha == F.col("_gone_sha")), "left_anti")


#: DuckDB's form of the query op3.
SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
