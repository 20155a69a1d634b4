"""Reshaping of cell tables: cells(doc_id, row_idx, col_idx, value) in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cells as c


def melt(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Wide to long with fixed column positions."""
    wide = df.select(*ids, *[F.col(x).cast("string").alias(x) for x in columns])
    long = wide.unpivot(ids, columns, "col_name", "value")
    place = F.create_map(*[y for i, x in enumerate(columns) for y in (F.lit(x), F.lit(i))])
    return long.withColumn("col_idx", place[F.col("col_name")])


def assign_header(cells: DataFrame) -> DataFrame:
    """Row 0 names the columns (Col_i where it is empty); other rows move up."""
    head = F.max(F.when(F.col("row_idx") == 0, F.col("value"))).over(W.partitionBy("doc_id", "col_idx"))
    name = F.coalesce(F.when(F.col("h") != "", F.col("h")), F.concat(F.lit("Col_"), F.col("col_idx").cast("string")))
    return cells.withColumn("h", head).where("row_idx > 0").select("doc_id", (F.col("row_idx") - 1).alias("row_idx"), "col_idx", name.alias("col_name"), "value")


def drop_empty(cells: DataFrame) -> DataFrame:
    """Without rows, then columns, that are all empty."""
    any_in = lambda *by: F.max(F.when(F.col("value") != "", 1).otherwise(0)).over(W.partitionBy(*by))
    rows = cells.withColumn("_r", any_in("doc_id", "row_idx")).where("_r = 1").drop("_r")
    return rows.withColumn("_c", any_in("doc_id", "col_idx")).where("_c = 1").drop("_c")


def pad_rows(rows: DataFrame, width: Column, values: str = "values") -> DataFrame:
    """Array rows cut or filled with empty texts to the header's width."""
    padded = F.concat(F.col(values), F.array_repeat(F.lit(""), F.greatest(width - F.size(values), F.lit(0)).cast("int")))
    return rows.withColumn(values, F.slice(padded, F.lit(1), width.cast("int")))


def promote_header(cells: DataFrame) -> DataFrame:
    """For each table the row among the first ten that is the true header."""
    v = c.strip(F.col("value"))
    hit = v.isin("구분", "구 분", "항목") | v.rlike("^제[0-9]+기")
    return cells.where((F.col("row_idx") < 10) & hit).groupBy("doc_id").agg(F.min("row_idx").alias("header_row"))


def drop_repeated_header(cells: DataFrame, header: DataFrame) -> DataFrame:
    """Without rows that hold a placeholder or exactly the set of header(doc_id, name)."""
    names = header.groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("_names"))
    v = c.strip(F.col("value"))
    rows = cells.groupBy("doc_id", "row_idx").agg(F.sort_array(F.collect_set(v)).alias("_set"), F.max(v.rlike("^Col_[0-9]+").cast("int")).alias("_p"))
    bad = rows.join(names, "doc_id", "left").where("_p = 1 OR _set = _names").select("doc_id", "row_idx")
    return cells.join(bad, ["doc_id", "row_idx"], "left_anti")


def interpolate_headers(heads: DataFrame) -> DataFrame:
    """heads(doc_id, col_idx, num): unknown numbers by straight lines between known neighbours."""
    left = W.partitionBy("doc_id").orderBy("col_idx").rowsBetween(W.unboundedPreceding, -1)
    right = W.partitionBy("doc_id").orderBy("col_idx").rowsBetween(1, W.unboundedFollowing)
    known = F.when(F.col("num").isNotNull(), F.struct("col_idx", "num"))
    near = heads.withColumn("_l", F.last(known, True).over(left)).withColumn("_r", F.first(known, True).over(right))
    line = F.col("_l.num") + (F.col("_r.num") - F.col("_l.num")) * (F.col("col_idx") - F.col("_l.col_idx")) / (F.col("_r.col_idx") - F.col("_l.col_idx"))
    return near.select("doc_id", "col_idx", F.coalesce("num", line).alias("num"))


def chunk_of(row: Column, size: int = 30) -> Column:
    return F.floor(row / size).cast("long")


def head_tail(rows: DataFrame, key: list[str], order: list[str], head: int, tail: int) -> DataFrame:
    """The first and last rows of each group."""
    w = W.partitionBy(*key)
    out = rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count(F.lit(1)).over(w))
    return out.where((F.col("_n") <= head) | (F.col("_n") > F.col("_all") - tail)).drop("_n", "_all")


def metadata_block(meta: DataFrame) -> DataFrame:
    """meta(doc_id, title, info, market), arrays of (label, value): sheet cells (doc_id, row, col, value).

    The title stands first; below it the two lists side by side, in columns 0/1 and 4/5.
    """
    title = meta.where("title IS NOT NULL").select("doc_id", F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("title").alias("value"))

    def side(name: str, col: int) -> DataFrame:
        rows = meta.select("doc_id", F.col("title").isNotNull().cast("int").alias("_t"), F.posexplode(name).alias("_i", "p"))
        cell = F.explode(F.array(F.struct(F.lit(col).alias("col"), F.col("p.label").alias("value")), F.struct(F.lit(col + 1).alias("col"), F.col("p.value").alias("value"))))
        return rows.select("doc_id", (F.col("_t") + F.col("_i")).alias("row"), cell.alias("c")).select("doc_id", "row", "c.col", "c.value")

    return title.unionByName(side("info", 0)).unionByName(side("market", 4))


def join_by_position(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of two halves of a table side by side, by their ordinal; the longer half's rest is left out."""
    number = lambda d: d.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return number(left).join(number(right).drop(*[x for x in order if x in left.columns]), [key, "_n"]).drop("_n")
