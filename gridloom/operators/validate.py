"""Checks: unparsable numbers, control totals, confidence, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cells as c
from . import layout


def invalid_cells(cells: DataFrame) -> DataFrame:
    return cells.where(c.unparsable(F.col("value")))


def control_totals(cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """cells(doc_id, row_idx, col_idx, col_name, value): (doc_id, row_idx, col_idx, rule) of wrong cells.

    Rows before the sum row: the spread columns must add up to the total column; each non-zero spread cell of a
    wrong row is reported.  Sum row: each spread column's rows must add up to it.  Tables without a sum
    row, spread columns or seven columns are not checked.
    """
    num, name, idx = c.safe_float(F.col("value")), F.col("col_name"), F.col("col_idx")
    marked = cells.select("doc_id", "row_idx", "col_idx", num.alias("num"), c.spread_header(name, idx).alias("spread"), c.total_header(name).alias("total"), ((idx < 6) & (c.strip(F.col("value")) == "합계")).alias("sum_label"))
    shape = marked.groupBy("doc_id").agg(F.min(F.when(F.col("sum_label"), F.col("row_idx"))).alias("sum_row"), F.min(F.when(F.col("total"), F.col("col_idx"))).alias("total_col"), F.max("col_idx").alias("last"))
    shape = shape.where("sum_row IS NOT NULL AND last >= 6")
    rows = marked.join(shape, "doc_id").where("row_idx <= sum_row")
    data = rows.where("row_idx < sum_row")
    nonzero = F.col("spread") & (F.col("num") != 0)
    per_row = data.groupBy("doc_id", "row_idx").agg(F.sum(F.when(F.col("col_idx") == F.col("total_col"), F.col("num"))).alias("want"), F.coalesce(F.sum(F.when(nonzero, F.col("num"))), F.lit(0.0)).alias("got"))
    wrong = per_row.where((F.col("want") != 0) & (F.abs(F.col("got") - F.col("want")) > tolerance)).select("doc_id", "row_idx")
    by_row = data.where(nonzero).join(wrong, ["doc_id", "row_idx"], "left_semi").select("doc_id", "row_idx", "col_idx", F.lit("row").alias("rule"))
    per_col = rows.where("spread").groupBy("doc_id", "col_idx", "sum_row").agg(F.max(F.when(F.col("row_idx") == F.col("sum_row"), F.col("num"))).alias("want"), F.coalesce(F.sum(F.when(F.col("row_idx") < F.col("sum_row"), F.col("num"))), F.lit(0.0)).alias("got"))
    by_col = per_col.where(F.abs(F.col("got") - F.col("want")) > tolerance).select("doc_id", F.col("sum_row").alias("row_idx"), "col_idx", F.lit("column").alias("rule"))
    return by_row.unionByName(by_col)


def confidence(boxes: DataFrame, cells: DataFrame, known: DataFrame, overlap: DataFrame | None = None) -> DataFrame:
    """Mean of what is known of: box confidence, fill rate, share of known names in column 0, likely column count.

    With ``overlap(doc_id, overlap)``, the best match with known headers, that stands in place of the column count.
    """
    box = boxes.groupBy("doc_id").agg(F.avg("confidence").alias("box"))
    first = (F.col("col_idx") == 0) & (F.trim("value") != "")
    names = known.select(F.col("canonical_name").alias("_name"), F.lit(1).alias("k")).distinct()
    marked = cells.join(names, F.trim("value") == F.col("_name"), "left")
    per = marked.groupBy("doc_id").agg(F.avg((F.col("value") != "").cast("double")).alias("fill"), F.avg(F.when(first, F.coalesce("k", F.lit(0)))).alias("names"), (F.max("col_idx") + 1).alias("cols"))
    both = per.join(box, "doc_id", "full")
    if overlap is not None:
        both = both.join(overlap, "doc_id", "left")
    last = layout.confidence_term(F.col("cols")) if overlap is None else F.col("overlap")
    terms = F.array_compact(F.array("box", F.least(F.col("fill") * 1.5, F.lit(1.0)), "names", last))
    return both.select("doc_id", (F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.size(terms)).alias("confidence"))


def compared(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """The expected rows with ``hit`` (a row of that label was found) and ``good`` (its equal cells); the first column is the label."""
    label = c.normal_label(F.col(columns[0]))
    want = expected.withColumn("_k", label).where("_k <> ''").select("case", "row_idx", "_k", F.col(columns[0]).alias("label"), *[c.normal_label(F.col(x)).alias(f"e_{x}") for x in columns])
    first = actual.withColumn("_k", label).groupBy("case", "_k").agg(F.min(F.struct("row_idx", *[c.normal_label(F.col(x)).alias(f"a_{x}") for x in columns])).alias("a"))
    hits = [F.coalesce((F.col(f"e_{x}") == F.col(f"a.a_{x}")).cast("int"), F.lit(0)) for x in columns]
    return want.join(first, ["case", "_k"], "left").select("case", "row_idx", "label", F.col("a").isNotNull().alias("hit"), sum(hits[1:], hits[0]).alias("good"))


def evaluate(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """expected/actual(case, row_idx, columns...): recall of rows and accuracy of rows and cells per case."""
    rows, n = compared(expected, actual, columns), len(columns)
    out = rows.groupBy("case").agg(F.avg(F.col("hit").cast("double")).alias("row_recall"), F.avg((F.col("good") == n).cast("double")).alias("exact_row_accuracy"), (F.sum("good") / (F.count(F.lit(1)) * n)).alias("cell_accuracy"))
    return out.select("case", *[F.round(x, 4).alias(x) for x in ("row_recall", "exact_row_accuracy", "cell_accuracy")])


def mismatches(expected: DataFrame, actual: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """(case, row_idx, label, reason): every row that was not found, and rows that differ as long as the report holds fewer than ``most``."""
    wrong = compared(expected, actual, columns).where(F.col("good") < len(columns))
    before = F.row_number().over(W.partitionBy("case").orderBy("row_idx")) - 1
    listed = wrong.withColumn("_n", before).where(~F.col("hit") | (F.col("_n") < most))
    return listed.select("case", "row_idx", "label", F.when(F.col("hit"), "differs").otherwise("row_not_found").alias("reason"))


def averages(scores: DataFrame) -> DataFrame:
    """One row: the number of cases and the plain means of their scores."""
    return scores.agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(x), 4).alias(f"avg_{x}") for x in ("row_recall", "exact_row_accuracy", "cell_accuracy")])


def case_reports(expected: DataFrame, actual: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """One row for each case: its counts and scores, and its mismatches as they were written, with what was expected and what was found.

    expected_rows, row_hits, exact_row_hits, cell_matches, total_cells, the three scores, and sample_mismatches(label, reason, expected, actual): every row that was not found,
    and rows that differ as long as the list holds fewer than ``most``.
    """
    n, label = len(columns), c.normal_label(F.col(columns[0]))
    rows = compared(expected, actual, columns)
    told = expected.select("case", "row_idx", F.array(*columns).alias("expected"))
    first = actual.withColumn("_k", label).groupBy("case", "_k").agg(F.min(F.struct("row_idx", F.array(*columns).alias("actual"))).alias("a")).select("case", "_k", F.col("a.actual").alias("actual"))
    wrong = rows.where(F.col("good") < n).withColumn("_n", F.row_number().over(W.partitionBy("case").orderBy("row_idx")) - 1).where(~F.col("hit") | (F.col("_n") < most))
    wrong = wrong.withColumn("_k", c.normal_label(F.col("label"))).join(told, ["case", "row_idx"]).join(first, ["case", "_k"], "left")
    entry = F.struct("row_idx", "label", F.when(F.col("hit"), "differs").otherwise("row_not_found").alias("reason"), F.when(F.col("hit"), F.col("expected")).alias("expected"), F.when(F.col("hit"), F.col("actual")).alias("actual"))
    samples = wrong.groupBy("case").agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    rate = lambda x, of: F.round(x / of, 4)
    hits, exact, good, all_ = F.sum(F.col("hit").cast("long")), F.sum((F.col("good") == n).cast("long")), F.sum("good"), F.count(F.lit(1))
    per = rows.groupBy("case").agg(
        all_.alias("expected_rows"), hits.alias("row_hits"), exact.alias("exact_row_hits"), good.alias("cell_matches"), (all_ * n).alias("total_cells"),
        rate(hits, all_).alias("row_recall"), rate(exact, all_).alias("exact_row_accuracy"), rate(good, all_ * n).alias("cell_accuracy"),
    )
    shown = F.transform(F.coalesce("_s", F.array().cast(samples.schema["_s"].dataType)), lambda x: F.struct(x["label"].alias("label"), x["reason"].alias("reason"), x["expected"].alias("expected"), x["actual"].alias("actual")))
    return per.join(samples, "case", "left").select(*per.columns, shown.alias("sample_mismatches"))
