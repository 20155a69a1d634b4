"""Mixing sources to target weights by capped water-filling.

The budget of the mix (``share`` of all words) is split over the sources by weight.  A source whose
part is above ``epochs`` times its size is clamped there and its excess goes to the others by weight,
until none is above.  The end of that process has a closed form: with the sources in ascending
order of cap / weight, the level L_i that is left when the sources before i are clamped rises as long as
source i is above its cap and falls after; its maximum L gives each target as min(cap, L * weight).  It
takes two running sums over the table of sources.

Then each source takes floor(target / size) whole repetitions of all its documents, and for the rest
those documents that come first in a seeded order until the rest is used up; the document at the
boundary is taken if at least half of it fits.  So a source's words miss its target by at most half a
document, and no document is taken more than ``epochs`` times.

Along that order the rest is used up once, so what a source takes is told by one place in the order, its cut.
:func:`mixed` joins the table of cuts, one row for each source, to the documents: no text is moved.

A null source is a source and sorts last.  Null and empty texts have size 0: they repeat with the
whole repetitions and have no words.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import numbered, running_sum, word_count, written


def source_key(source: str = "source") -> Column:
    """A key without nulls; its byte order is the sources' code point order, null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2) -> DataFrame:
    """``sizes(key, source_size)`` with ``target``; weights repeat over the keys in order.

    There is one row for each source here, so these windows hold the list of sources, not documents.
    """
    num, den = share
    rank = F.row_number().over(W.orderBy("key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    rising = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before, after, every = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(1))
    spare = F.lit(num) * F.sum("source_size").over(every) - F.lit(den) * F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = spare.cast("double") / (F.lit(den) * F.sum("weight").over(after)).cast("double")
    rows = rows.withColumn("level", level).withColumn("above", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.coalesce(F.max(F.when(F.col("above"), F.col("level"))).over(every), F.lit(float("inf")))
    return rows.select("key", "source_size", F.least(F.col("cap").cast("double"), water * F.col("weight")).alias("target"))


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, row_col: str | None) -> list[Column]:
    """Of a document its source, its size, and its place in the seeded order: a digest, then what tells equal digests apart."""
    row = F.col(row_col) if row_col else F.lit("")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), row)))
    return [source_key(source_col).alias("key"), word_count(F.col(text_col)).alias("size"), order.alias("order"), row.alias("row")]


def shares(rows: DataFrame, **aims) -> DataFrame:
    """Of written rows(key, size, order, row), one row for each source: key, source_size, target, whole (repetitions of all) and cut (the last place that is taken once more)."""
    aim = targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), **aims)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aim = written(aim.withColumn("whole", whole), "targets")
    ranked = running_sum(rows.select("key", "size", "order", "row"), "key", ["order", "size", "row"], "size", "before").join(aim, "key")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    inside = (F.col("before") + F.col("size") / 2 <= rest) & (rest > 0)
    cut = ranked.groupBy("key").agg(F.max(F.when(inside, F.struct("order", "size", "row"))).alias("cut"))
    return written(aim.join(cut, "key"), "shares")


def times(order: Column, size: Column, row: Column, whole: Column, cut: Column) -> Column:
    """How often the mix takes a document, from its place and its source's whole and cut."""
    extra = F.struct(order.alias("order"), size.alias("size"), row.alias("row")) <= cut
    return whole + F.coalesce(extra, F.lit(False)).cast("long")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, row_col: str | None = None, **aims) -> DataFrame:
    """The documents with ``_times``, how often the mix takes each.

    Rows of one id and one size are taken alike unless ``row_col`` tells them apart.
    """
    columns = placed(docs, id_col, text_col, source_col, seed, row_col)
    share = shares(written(docs.select(*columns), "sizes"), **aims).select(F.col("key").alias("_key"), F.col("whole").alias("_whole"), F.col("cut").alias("_cut"))
    found = docs.select("*", *[c.alias(n) for c, n in zip(columns, ("_key", "_size", "_order", "_place"), strict=True)]).join(share, "_key")
    taken = times(F.col("_order"), F.col("_size"), F.col("_place"), F.col("_whole"), F.col("_cut"))
    return found.select(*docs.columns, taken.alias("_times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **aims) -> DataFrame:
    """id, size, source_size, target and times of each document; texts are read once.

    Rows are told apart by file and place: those without an id have an order of their own, those of one id follow each other in it.
    """
    named = numbered(docs.select(id_col, text_col, source_col) if "_row" in docs.columns else docs)
    rows = written(named.select(F.col(id_col).alias("_id"), *placed(named, id_col, text_col, source_col, seed, "_row")), "sizes")
    found = rows.join(shares(rows, **aims), "key")
    return found.select(F.col("_id").alias(id_col), "size", "source_size", "target", times(*map(F.col, ("order", "size", "row", "whole", "cut"))).alias("times"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size, md5('0|' || doc_id::VARCHAR) AS o FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, [3, 1, 2][1 + ((row_number() OVER (ORDER BY key) - 1) % 3)]::BIGINT AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (2 * sum(weight) OVER (ORDER BY cap::DOUBLE / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT key, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), 'inf'::DOUBLE) * weight) AS target FROM l),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
j AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM p JOIN t USING (key))
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN before + size / 2.0::DOUBLE <= target - whole * source_size AND target - whole * source_size > 0 THEN 1 ELSE 0 END) AS taken FROM j
"""
