"""Rows and columns from the geometry of text boxes: boxes(doc_id, box_id, text, x_center, y_center, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rows_chained(boxes: DataFrame, tolerance: float | Column) -> DataFrame:
    """Row number by the distance to the previous box (less than the tolerance stays)."""
    w = W.partitionBy("doc_id").orderBy("y_center", "box_id")
    new = F.when(F.col("y_center") - F.lag("y_center").over(w) < tolerance, 0).otherwise(1)
    return boxes.withColumn("_new", new).withColumn("row_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_new")


def rows_anchored(boxes: DataFrame, tolerance: float | Column) -> DataFrame:
    """Row number by the distance to the row's first box (the tolerance itself stays): a fold over sorted boxes; the tolerance may be an aggregate."""
    sorted_ = F.array_sort(F.collect_list(F.struct("y_center", "box_id")))
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("y"), F.filter(F.array(F.struct(F.lit(None).cast("int").alias("box_id"), F.lit(None).cast("int").alias("row_no"))), lambda _: F.lit(False)).alias("out"))

    def step(acc, b):
        opens = acc["y"].isNull() | (b["y_center"] - acc["y"] > F.col("_tol"))
        row = F.when(opens, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(row.alias("row"), F.when(opens, b["y_center"]).otherwise(acc["y"]).alias("y"), F.concat(acc["out"], F.array(F.struct(b["box_id"].cast("int").alias("box_id"), row.alias("row_no")))).alias("out"))

    listed = boxes.groupBy("doc_id").agg(sorted_.alias("_l"), (tolerance if isinstance(tolerance, Column) else F.lit(tolerance)).alias("_tol"))
    folded = listed.select("doc_id", F.aggregate("_l", start, step)["out"].alias("_o"))
    return folded.select("doc_id", F.inline("_o"))


def merge_close(positions: DataFrame, threshold: float) -> DataFrame:
    """positions(doc_id, pos INT): neighbours within the threshold become their integer mean, from left to right."""
    empty = F.filter(F.array(F.lit(None).cast("int")), lambda _: F.lit(False))

    def step(acc, p):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) == 0) | (p - F.when(F.size(acc) > 0, last) > threshold), F.concat(acc, F.array(p))).otherwise(
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.floor((last + p) / 2).cast("int")))
        )

    return positions.groupBy("doc_id").agg(F.aggregate(F.array_sort(F.collect_list(F.col("pos").cast("int"))), empty, step).alias("_m")).select("doc_id", F.posexplode("_m").alias("idx", "pos"))


def gap_clusters(positions: DataFrame, k: int) -> DataFrame:
    """positions(doc_id, pos): cut at the k-1 widest gaps (of equals the later one); mean of each part."""
    w = W.partitionBy("doc_id").orderBy("pos")
    p = positions.distinct().withColumn("i", F.row_number().over(w)).withColumn("gap", F.lead("pos").over(w) - F.col("pos"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("gap").desc_nulls_last(), F.desc("i")))
    p = p.withColumn("cut", F.when(F.col("gap").isNotNull() & (rank <= k - 1), 1).otherwise(0))
    p = p.withColumn("cluster", F.coalesce(F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return p.groupBy("doc_id", "cluster").agg(F.avg("pos").alias("center"), F.count(F.lit(1)).alias("n"))


def histogram_peaks(positions: DataFrame, bins: int, k: int) -> DataFrame:
    """positions(doc_id, pos): the k highest interior local maxima of a histogram; the last point falls outside."""
    ends = positions.groupBy("doc_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).where("hi > lo")
    ends = ends.withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    frame = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counted = positions.join(ends, "doc_id").withColumn("bin", F.floor((F.col("pos") - F.col("lo")) / F.col("step")).cast("int")).groupBy("doc_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    hist = frame.join(counted, ["doc_id", "bin"], "left").fillna(0, ["n"])
    w = W.partitionBy("doc_id").orderBy("bin")
    peaks = hist.withColumn("_l", F.lag("n").over(w)).withColumn("_r", F.lead("n").over(w)).where("n > 0 AND n >= _l AND n >= _r")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("bin")))
    return peaks.withColumn("rk", rank).where(F.col("rk") <= k).select("doc_id", "bin", "n", (F.col("lo") + F.col("step") * (F.col("bin") + 0.5)).alias("center"))


def assign_columns(boxes: DataFrame, centers: DataFrame) -> DataFrame:
    """Column of each box: how many midpoints between neighbouring centers(doc_id, center) lie left of it."""
    w = W.partitionBy("doc_id").orderBy("center")
    mid = centers.withColumn("m", (F.col("center") + F.lead("center").over(w)) / 2).where("m IS NOT NULL").groupBy("doc_id").agg(F.collect_list("m").alias("_m"))
    place = F.coalesce(F.size(F.filter("_m", lambda m: F.col("x_center") > m)), F.lit(0))
    return boxes.join(mid, "doc_id", "left").withColumn("col_no", F.when(F.col("_m").isNull(), 0).otherwise(place)).drop("_m")


def _candidates(boxes: DataFrame, grid: DataFrame) -> DataFrame:
    """Boxes are few beside the cells of a grid, so cells look them up and are not sorted for it."""
    return grid.join(boxes.hint("shuffle_hash"), "doc_id")


def boxes_to_cells(boxes: DataFrame, grid: DataFrame) -> DataFrame:
    """Texts of grid(doc_id, row, col, x_min, x_max, y_min, y_max): a box goes to the first cell that holds its center, else to the nearest."""
    inside = F.col("x_center").between(F.col("gx_min"), F.col("gx_max")) & F.col("y_center").between(F.col("gy_min"), F.col("gy_max"))
    dx, dy = F.col("x_center") - (F.col("gx_min") + F.col("gx_max")) / 2, F.col("y_center") - (F.col("gy_min") + F.col("gy_max")) / 2
    key = ["doc_id", "box_id"]
    centers = boxes.select(*key, "x_center", "y_center")
    held = _candidates(centers, grid).where(inside).groupBy(*key).agg(F.min(F.struct("row", "col")).alias("b"))
    outside = centers.join(held, key, "left_anti")
    nearest = _candidates(outside, grid).groupBy(*key).agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "row", "col")).alias("b")).select(*key, F.struct("b.row", "b.col").alias("b"))
    won = held.unionByName(nearest).join(boxes.select(*key, "text"), key)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", "text"))), lambda s: s["text"]), " ")
    return won.groupBy("doc_id", F.col("b.row").alias("row"), F.col("b.col").alias("col")).agg(text.alias("value"))


def boxes_to_smallest(boxes: DataFrame, grid: DataFrame, *kept: str) -> DataFrame:
    """Each box in the smallest cell that holds its center, with those columns of its own that are to be kept; boxes outside all cells are left out."""
    area = (F.col("gx_max") - F.col("gx_min")) * (F.col("gy_max") - F.col("gy_min"))
    inside = F.col("x_center").between(F.col("gx_min"), F.col("gx_max")) & F.col("y_center").between(F.col("gy_min"), F.col("gy_max"))
    return _candidates(boxes, grid).where(inside).groupBy("doc_id", "box_id").agg(F.min(F.struct(area.alias("a"), "row", "col", *kept)).alias("b")).select("doc_id", "box_id", "b.row", "b.col", *[f"b.{x}" for x in kept])


def cells_by_overlap(boxes: DataFrame, grid: DataFrame) -> DataFrame:
    """For each cell the box that covers most of it (the first of equals)."""
    side = lambda a: F.least(f"{a}_max", f"g{a}_max") - F.greatest(f"{a}_min", f"g{a}_min")
    pairs = _candidates(boxes, grid).withColumn("_x", side("x")).withColumn("_y", side("y")).where("_x > 0 AND _y > 0").withColumn("_a", F.col("_x") * F.col("_y"))
    return pairs.groupBy("doc_id", "row", "col").agg(F.min(F.struct((-F.col("_a")).alias("a"), "box_id", "text")).alias("b")).select("doc_id", "row", "col", "b.box_id", F.col("b.text").alias("value"))


def with_fallback(boxes: DataFrame, grid: DataFrame, columns: int = 3, share: float = 0.6) -> DataFrame:
    """Cells (doc_id, row, col, value, by): by the grid where it has enough columns, else by coordinates alone.

    Without a grid, rows are anchored with a tolerance of 0.6 x the page's mean box height, in whole units.
    """
    ruled = grid.groupBy("doc_id").agg(F.countDistinct("col").alias("_n")).where(F.col("_n") >= columns).select("doc_id")
    by_grid = boxes_to_cells(boxes.join(ruled, "doc_id", "left_semi"), grid).withColumn("by", F.lit("grid"))
    rest = boxes.join(ruled, "doc_id", "left_anti")
    rows = rest.join(rows_anchored(rest, F.floor(F.avg(F.col("y_max") - F.col("y_min")) * share)), ["doc_id", "box_id"])
    order = W.partitionBy("doc_id", "row_no").orderBy("x_center", "box_id")
    by_place = rows.select("doc_id", F.col("row_no").cast("int").alias("row"), (F.row_number().over(order) - 1).alias("col"), F.col("text").alias("value"), F.lit("coordinates").alias("by"))
    return by_grid.unionByName(by_place)


def over_share_of_max(sums: DataFrame, value: str, share: float, by: str) -> DataFrame:
    """Rows of a projection above a share of its maximum."""
    top = sums.groupBy(by).agg(F.max(value).alias("_top"))
    return sums.join(top, by).where(F.col(value) > share * F.col("_top")).drop("_top")


def uniform_suffix(widths: DataFrame, factor: float = 1.3, *more: Column) -> DataFrame:
    """widths(doc_id, idx, w): where the last run of columns no wider than factor times the upper median begins; ``more`` aggregates come along.  Rows without a place or a width count for those alone."""
    named = F.col("idx").isNotNull() & F.col("w").isNotNull()
    listed = widths.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(named, F.col("w")))).alias("_s"), F.sort_array(F.collect_list(F.when(named, F.struct("idx", "w")))).alias("_w"), *more).where(F.size("_s") > 0)
    kept = listed.columns[3:]
    median = F.element_at("_s", F.floor(F.size("_s") / 2).cast("int") + 1)
    listed = listed.withColumn("median", median)
    wide = F.filter("_w", lambda s: s["w"] > factor * F.col("median"))
    return listed.select("doc_id", "median", (F.coalesce(F.array_max(F.transform(wide, lambda s: s["idx"])), F.lit(-1)) + 1).cast("long").alias("start_idx"), *kept)


def confidence_term(columns: Column) -> Column:
    """Penalty for an unlikely number of columns; none from 8 to 15."""
    return F.when(columns < 5, 0.1).when(columns < 8, 0.4).when(columns > 15, 0.5)


def cluster_positions(positions: DataFrame, wanted: DataFrame) -> DataFrame:
    """positions(doc_id, pos) in wanted(doc_id, k) groups: (doc_id, idx, center), cut at the widest gaps.

    With k different positions or fewer, these stay and more follow at steps of 100 after the last.
    """
    of = W.partitionBy("doc_id")
    w = of.orderBy("pos")
    p = positions.select("doc_id", "pos").repartition("doc_id").distinct().join(wanted, "doc_id")  # moved once, by document
    p = p.withColumn("i", F.row_number().over(w)).withColumn("m", F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).withColumn("gap", F.lead("pos").over(w) - F.col("pos"))
    rank = F.row_number().over(of.orderBy(F.col("gap").desc_nulls_last(), F.desc("i")))
    few = F.col("m") <= F.col("k")  # every position is a group
    p = p.withColumn("cut", F.when(few | (F.col("gap").isNotNull() & (rank <= F.col("k") - 1)), 1).otherwise(0))
    p = p.withColumn("idx", F.coalesce(F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    groups = p.groupBy("doc_id", "idx").agg(F.avg("pos").alias("center"), F.first("m").alias("m"), F.first("k").alias("k"))
    more = F.when((F.col("idx") == F.col("m") - 1) & (F.col("k") > F.col("m")), F.sequence(F.lit(0), (F.col("k") - F.col("m")).cast("int"))).otherwise(F.array(F.lit(0)))
    groups = groups.withColumn("n", F.explode(more))
    return groups.select("doc_id", (F.col("idx") + F.col("n")).alias("idx"), (F.col("center") + 100 * F.col("n")).alias("center"))


def column_places(boxes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, idx, center) of the columns of boxes(doc_id, x_center, x_min, x_max): the k highest inner peaks of a histogram, else :func:`cluster_positions`.

    Bins are 0.3 mean box widths wide, 5 at least, and there are at least two for each column.
    """
    x = F.col("x_center")
    ends = boxes.groupBy("doc_id").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("m"), F.avg(F.col("x_max") - F.col("x_min")).alias("w")).join(wanted, "doc_id")
    ends = ends.where("m >= k AND hi > lo").withColumn("bins", F.greatest(F.floor((F.col("hi") - F.col("lo")) / F.greatest(F.col("w") * 0.3, F.lit(5.0))), 2 * F.col("k")).cast("int"))
    ends = ends.withColumn("step", (F.col("hi") - F.col("lo")) / F.col("bins"))
    counted = boxes.join(ends, "doc_id").withColumn("bin", F.floor((x - F.col("lo")) / F.col("step")).cast("int")).groupBy("doc_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    hist = ends.select("doc_id", "k", "lo", "step", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")).join(counted, ["doc_id", "bin"], "left").fillna(0, ["n"])
    by_bin = W.partitionBy("doc_id").orderBy("bin")
    peaks = hist.withColumn("_l", F.lag("n").over(by_bin)).withColumn("_r", F.lead("n").over(by_bin)).where("n > 0 AND n >= _l AND n >= _r")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("bin")))
    top = peaks.withColumn("rk", rank).withColumn("found", F.count(F.lit(1)).over(W.partitionBy("doc_id"))).where("found >= k AND rk <= k")
    by_peak = top.select("doc_id", (F.row_number().over(by_bin) - 1).alias("idx"), (F.col("lo") + F.col("bin") * F.col("step") + F.col("step") / 2).alias("center"))
    rest = boxes.join(by_peak.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", x.alias("pos"))
    return by_peak.unionByName(cluster_positions(rest, wanted))


def narrow_start(widths: DataFrame, wanted: DataFrame, factor: float = 1.3) -> DataFrame:
    """(doc_id, start_idx): where the narrow columns at the right begin, by the median of the right half; the last wanted(doc_id, k) where that is off by more than 3."""
    listed = widths.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "w"))), lambda s: s["w"]).alias("_w")).where(F.size("_w") >= 2).join(wanted, "doc_id")
    half = F.sort_array(F.slice("_w", F.floor(F.size("_w") / 2).cast("int") + 1, F.size("_w")))
    listed = listed.withColumn("median", F.element_at(half, F.floor(F.size(half) / 2).cast("int") + 1))
    wide = F.array_max(F.transform("_w", lambda x, i: F.when(x > factor * F.col("median"), i)))
    start = F.coalesce(wide + 1, F.lit(0))
    n = F.size("_w")
    return listed.select("doc_id", F.when(F.abs(n - start - F.col("k")) > 3, F.greatest(n - F.col("k"), F.lit(0))).otherwise(start).cast("long").alias("start_idx"))
