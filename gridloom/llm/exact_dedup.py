"""Exact deduplication by progressive refinement, in DataFrame operations only.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted.
Null counts as empty; empty texts are equal to each other.  Rows are compared by ever longer keys:

1. the length of the normalised text,
2. the hash of its first ``prefix`` characters, within equal lengths,
3. SHA-256 of all of it, within equal lengths and prefixes.

Only rows whose group still has two members go on.  :func:`exact_groups` reads the whole texts of those rows alone
again and hashes them.  :func:`exact_dedup` has to give the digest of every text, so it makes length, prefix hash
and digest in one pass over the texts; the digests of rows that dropped out before are compared with nothing.

Groups are counted with partial aggregates and joined back, so a group may hold any share of the
rows.  Of equal texts the one with the most code points, then the smallest id, stays; a null id comes last.
Every input row gives one output row, whatever its id: rows of one id, or without an id, are told apart by a number,
and of rows that tie in everything exactly one is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, moved, text_of, written


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_of(text), f"[{SPACE}]+", "")


def lengths(text: Column, prefix: int) -> list[Column]:
    """The first two keys: size and prefix hash of the normalised text."""
    norm = normalised(text)
    return [F.length(norm).alias("size"), F.xxhash64(F.substring(norm, 1, prefix)).alias("head")]


def refine(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose ``key`` at least one other row shares."""
    shared = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(shared, key, "left_semi")


def leaders(rows: DataFrame) -> DataFrame:
    """(full, group_size, keep): of rows(row, order, chars, full) with equal hashes, the row that stays."""
    lead = F.struct((-F.col("chars")).alias("short"), F.col("order").isNull().alias("none"), "order", "row")
    best = rows.groupBy("full").agg(F.count(F.lit(1)).alias("group_size"), F.min(lead).alias("top")).where("group_size > 1")
    return best.select("full", "group_size", F.col("top.row").alias("keep_row"), F.col("top.order").alias("keep_id"))


def exact_groups(docs: DataFrame, row_col: str, text_col: str = "text", prefix: int = 64, id_col: str = "doc_id") -> DataFrame:
    """(row, keep_row, group_size) of numbered rows that have equals; others have none and are absent."""
    text = F.col(text_col)
    short = docs.select(F.col(row_col).alias("row"), *lengths(text, prefix))
    same_size = written(refine(written(short, "lengths"), ["size"]), "lengths")
    left = written(refine(same_size, ["size", "head"]).select("row"), "survivors")
    whole = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("order"), text.alias("_text")).join(moved(left), "row", "left_semi")
    whole = whole.select("row", "order", F.length(text_of("_text")).alias("chars"), F.unhex(F.sha2(normalised("_text"), 256)).alias("full"))
    whole = written(whole, "hashes")
    return whole.join(leaders(whole), "full").select("row", "keep_row", "group_size")


def without_copies(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbered documents, one of each group of equals, with all their columns."""
    gone = exact_groups(docs, row_col, text_col, id_col=id_col).where("row <> keep_row").select(F.col("row").alias(row_col))
    return docs.join(moved(gone), row_col, "left_anti")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and text_sha256."""
    text = F.col(text_col)
    chars, full = F.length(text_of(text)).alias("chars"), F.unhex(F.sha2(normalised(text), 256)).alias("full")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("order"), chars, *lengths(text, prefix), full)
    rows = written(rows, "hashes")
    same_size = written(refine(rows, ["size"]), "lengths")
    best = written(leaders(refine(same_size, ["size", "head"])), "leaders")
    found = rows.select("row", "order", "full").join(best, "full", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("order").alias(id_col), F.when(alone, F.col("order")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("full")).alias("text_sha256"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept
 FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
