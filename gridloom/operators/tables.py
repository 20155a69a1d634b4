"""Whole tables from cells(doc_id, row_idx, col_idx, col_name, value) and boxes: headers, ranges, placement, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import cells as c
from . import entities, layout, votes
from .shared import kept

#: Words of header rows, by the way a table was found.
HEADER_WORDS = ["회사명", "부서명", "이름", "계정"]
LINE_WORDS = [*HEADER_WORDS, "번호", "기관명"]
#: Labels that end a table's data, and the mark of rows that stand before them.
END_LABELS = ["합계", "비중(%)", "누적합계", "누적비중(%)"]
BEFORE_DATA = "전일기준"
#: Words of texts above a table.
TITLE_WORDS, INFO_WORDS, MARKET_WORDS = ["수요예측", "BBB", "AA", "결과"], ["사채만기", "모집금액", "모집밴드", "모집번드"], ["개별민평", "국고", "Spread"]
#: Words that tell a document's type.
DEMAND_WORDS, BALANCE_WORDS = ["수요예측", "총참여금액", "참여금액", "모집밴드", "스프레드", "최종참여일시"], ["유동자산", "비유동자산", "자산총계", "부채총계", "자본총계"]
#: Kind of a name column, word of its header, its usual place, largest letter distance of a correction.
NAME_COLUMNS = [("company", "회사", 0, 4), ("department", "부서", 1, 4), ("account", "계정", 3, 2)]


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def normalize_raw(cells: DataFrame) -> DataFrame:
    """Raw tables of two rows or more: the first row names the columns, then rows and columns without data go.

    A column whose data are all empty goes although it has a name.
    """
    v = c.strip(F.coalesce("value", F.lit("")))
    of = lambda *by: W.partitionBy("doc_id", *by)
    head = F.max(F.when(F.col("row_idx") == 0, v)).over(of("col_idx"))
    rows = cells.select("doc_id", "row_idx", "col_idx", v.alias("value"), head.alias("_h"), F.max("row_idx").over(of()).alias("_last"))
    name = F.coalesce(F.when(F.col("_h") != "", F.col("_h")), F.concat(F.lit("Col_"), F.col("col_idx").cast("string")))
    data = rows.where("_last >= 1 AND row_idx > 0").select("doc_id", (F.col("row_idx") - 1).alias("row_idx"), "col_idx", name.alias("col_name"), "value")
    full = lambda by: F.max((F.col("value") != "").cast("int")).over(of(by))
    return data.withColumn("_r", full("row_idx")).withColumn("_c", full("col_idx")).where("_r = 1 AND _c = 1").drop("_r", "_c")


def data_range(cells: DataFrame) -> DataFrame:
    """(doc_id, start_row, end_row): data begin after the last row that is marked as standing before them, and end at the first closing label."""
    v = c.strip(F.col("value"))
    rows = cells.groupBy("doc_id", "row_idx").agg(
        F.max((F.col("col_idx") == 0) & v.contains(BEFORE_DATA)).alias("mark"), F.max(F.col("col_idx").isin(0, 3) & v.isin(END_LABELS)).alias("label")
    )
    end = F.coalesce(F.min(F.when(F.col("label") & ~F.col("mark"), F.col("row_idx"))).over(W.partitionBy("doc_id")), F.max("row_idx").over(W.partitionBy("doc_id")) + 1)
    start = F.max(F.when(F.col("mark") & (F.col("row_idx") < F.col("end_row")), F.col("row_idx") + 1))
    return rows.withColumn("end_row", end).groupBy("doc_id").agg(F.coalesce(start, F.lit(0)).alias("start_row"), F.max("end_row").alias("end_row"))


def spread_start(cells: DataFrame) -> DataFrame:
    """(doc_id, start_col, columns): the first column whose name is a number, alone or in its last parentheses; else the one after the first total."""
    name, idx = F.col("col_name"), F.col("col_idx")
    first = F.coalesce(F.min(F.when(c.spread_number(name), idx)), F.min(F.when(c.total_header(name), idx)) + 1)
    return cells.groupBy("doc_id").agg(first.alias("start_col"), (F.max("col_idx") + 1).alias("columns"))


def column_kinds(cells: DataFrame, sample: int = 5) -> DataFrame:
    """(doc_id, col_idx, kind): by the header, else by the numbers among the first five values."""
    number = c.strip(F.replace("value", F.lit(","), F.lit(""))).rlike(r"^-?[0-9]+\.?[0-9]*$") & (F.col("row_idx") < sample)
    per = cells.groupBy("doc_id", "col_idx", "col_name").agg(F.sum(number.cast("int")).alias("n"))
    return per.select("doc_id", "col_idx", c.column_kind(F.col("col_name"), F.col("n")).alias("kind"))


def layout_hash(grid: DataFrame) -> DataFrame:
    """grid(doc_id, row, col, x, y, w, h, img_w, img_h): a hash of the grid's shape and its cells as shares of the image, to two places, halves up."""
    size = lambda name: F.greatest(F.col(name), F.lit(1))
    text = lambda v, by: F.format_string("%.2f", F.floor(F.col(v) / size(by) * 100 + 0.5) / 100)
    cell = F.concat_ws(",", text("x", "img_w"), text("y", "img_h"), text("w", "img_w"), text("h", "img_h"))
    per = grid.groupBy("doc_id").agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c"), F.array_sort(F.collect_list(F.struct("row", "col", cell.alias("t")))).alias("l"))
    data = F.concat(F.col("r").cast("string"), F.lit("x"), F.col("c").cast("string"), F.lit("|"), F.array_join(F.col("l.t"), ","))
    return per.select("doc_id", F.col("r").alias("rows"), F.col("c").alias("columns"), F.substring(F.sha2(data, 256), 1, 16).alias("fingerprint"))


def usable_templates(hashes: DataFrame, least: int = 5) -> DataFrame:
    """hashes(doc_id, fingerprint): each document with the number of documents of its layout, where that is enough to reuse what was learned."""
    counted = hashes.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("sample_count")).where(F.col("sample_count") >= least)
    return hashes.join(counted, "fingerprint").select("doc_id", "fingerprint", "sample_count")


def with_template(boxes: DataFrame, hashes: DataFrame, grids: DataFrame, least: int = 5) -> DataFrame:
    """Cells of documents whose layout is known: boxes go to the learned grid(fingerprint, row, col, gx_min, ...) without looking for lines again."""
    usable = usable_templates(hashes, least).select("doc_id", "fingerprint")
    return layout.boxes_to_cells(boxes.join(usable, "doc_id", "left_semi"), usable.join(grids, "fingerprint").drop("fingerprint"))


# -- responses ---------------------------------------------------------------------------------------


def response_json(raw: Column) -> Column:
    """The JSON object in a response: a fenced block or all of it; repaired if it does not parse; null if there is none."""
    fenced = F.regexp_extract(raw, r"```(?:json)?\s*([\s\S]*?)```", 1)
    text = c.strip(F.when(raw.rlike(r"```(?:json)?\s*[\s\S]*?```"), fenced).otherwise(raw))
    parses = lambda t: F.try_parse_json(t).isNotNull()
    whole = lambda t: F.when(parses(t), t)
    found = c.bound(text, lambda t: F.coalesce(whole(t), c.bound(c.repair_json(t), whole)))
    return c.bound(found, lambda t: F.when(t.rlike(r"^\s*\{"), t))


def response_cells(responses: DataFrame, key: str, raw: str) -> DataFrame:
    """Cells of the tables in responses: headers filled up with Col_i and rows with empty texts, then empty rows and columns left out."""
    data = responses.select(key, F.from_json(response_json(F.col(raw)), "headers array<string>, rows array<array<string>>").alias("j"))
    width = F.greatest(F.coalesce(F.size("j.headers"), F.lit(0)), F.array_max(F.transform("j.rows", lambda r: F.size(r))))
    rows = data.where(F.size("j.rows") > 0).select(key, "j.headers", width.alias("_w"), F.posexplode("j.rows").alias("row_idx", "_v"))
    cells = rows.select(key, "row_idx", "headers", "_v", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("col_idx"))
    at = lambda a: F.get(a, F.col("col_idx"))
    name = F.coalesce(at(F.col("headers")), F.concat(F.lit("Col_"), F.col("col_idx").cast("string")))
    cells = cells.select(key, "row_idx", "col_idx", name.alias("col_name"), F.coalesce(at(F.col("_v")), F.lit("")).alias("value"))
    full = lambda by: F.max((F.col("value") != "").cast("int")).over(W.partitionBy(key, by))
    return cells.withColumn("_r", full("row_idx")).withColumn("_c", full("col_idx")).where("_r = 1 AND _c = 1").drop("_r", "_c")


def document_type(text: Column, width: Column, height: Column) -> Column:
    """By words, else a wide image is a demand forecast; null if nothing tells."""
    wide = (height > 0) & (width / height > 1.8)
    return F.when(contains_any(text, DEMAND_WORDS), "demand_forecast").when(contains_any(text, BALANCE_WORDS), "financial_statement").when(wide, "demand_forecast")


# -- tables from boxes -------------------------------------------------------------------------------


def header_line(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, height, header_y): the top of the first box with a header word, else 15 % of the page's height."""
    word = contains_any(F.col("text"), LINE_WORDS)
    found = boxes.where(word).groupBy("doc_id").agg(F.min_by("y_min", "box_id").alias("y"))
    return pages.join(found, "doc_id", "left").select("doc_id", "height", F.coalesce("y", F.col("height") * 0.15).alias("header_y"))


def metadata(boxes: DataFrame, lines: DataFrame, extra_title: list[str] | None = None) -> DataFrame:
    """(doc_id, title, info, market_info) of boxes that end above lines(doc_id, header_y): the last title, and lists in the boxes' order."""
    text, order = F.col("text"), F.col("box_id")
    title = contains_any(text, [*TITLE_WORDS, *(extra_title or [])])
    info = ~title & contains_any(text, INFO_WORDS)
    market = ~title & ~info & contains_any(text, MARKET_WORDS)
    listed = lambda hit: F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("box_id", "text")))), lambda s: s["text"])
    above = boxes.join(lines.select("doc_id", "header_y"), "doc_id").where("y_max < header_y")
    return above.groupBy("doc_id").agg(F.coalesce(F.max_by(F.when(title, text), F.when(title, order)), F.lit("")).alias("title"), listed(info).alias("info"), listed(market).alias("market_info"))


def line_tables(boxes: DataFrame, pages: DataFrame, relative: bool = True) -> DataFrame:
    """Cells of tables without lines: rows by the gap to the previous box, the first row names the columns by ordinal.

    The gap is 2 % of the page's height and 15 at least, or 20; a page needs two rows.  Boxes are placed once: a row's texts are one list, and lie beside those of the first.
    """
    lines = header_line(boxes, pages).withColumn("_gap", F.greatest(F.lit(15.0), F.col("height") * 0.02) if relative else F.lit(20.0))
    inside = boxes.join(lines, "doc_id").where("y_min >= header_y - 10")
    rows = layout.rows_chained(inside, F.col("_gap"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x_center", "y_center", "box_id", "text"))), lambda s: s["text"])
    listed = rows.groupBy("doc_id", "row_no").agg(texts.alias("_texts"))
    listed = listed.withColumn("_head", F.first("_texts").over(W.partitionBy("doc_id").orderBy("row_no"))).where("row_no > 0")
    cells = listed.select("doc_id", (F.col("row_no") - 1).cast("int").alias("row_idx"), F.posexplode("_head").alias("col_idx", "col_name"), "_texts")
    return cells.select("doc_id", "row_idx", "col_idx", "col_name", F.coalesce(F.get("_texts", F.col("col_idx")), F.lit("")).alias("value"))


def grid_tables(boxes: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells of ruled tables: each box in the smallest cell around its center, the first row with a header word names the columns.

    Tables without such a row, and without a row below it, are absent.  The texts of a document become one row, which its cells look up; they are neither moved nor sorted for it.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", "text"))), lambda s: s["text"]), " ")
    texts = layout.boxes_to_smallest(boxes, grid, "text").groupBy("doc_id", "row", "col").agg(text.alias("value"))
    columns = texts.groupBy("doc_id", "col").agg(F.min(F.when(contains_any(F.col("value"), HEADER_WORDS), F.col("row"))).alias("_top"), F.collect_list(F.struct("row", "value")).alias("_v"))
    docs = columns.groupBy("doc_id").agg(F.min("_top").alias("_top"), F.map_from_entries(F.collect_list(F.struct("col", "_v"))).alias("_texts")).where("_top IS NOT NULL")
    cells = grid.select("doc_id", "row", "col").join(docs.hint("shuffle_hash"), "doc_id").where("row > _top").withColumn("_v", F.col("_texts")[F.col("col")])
    at = lambda row: F.get(F.filter("_v", lambda x: x["row"] == F.col(row)), F.lit(0))["value"]
    name = c.strip(at("_top"))
    col_name = F.coalesce(F.when(name != "", name), F.concat(F.lit("Col_"), F.col("col").cast("string")))
    return cells.select("doc_id", (F.col("row") - F.col("_top") - 1).alias("row_idx"), F.col("col").alias("col_idx"), col_name.alias("col_name"), F.coalesce(at("row"), F.lit("")).alias("value"))


# -- spread columns ----------------------------------------------------------------------------------


def restore_headers(cells: DataFrame) -> DataFrame:
    """Placeholder headers from the table itself: the row of the reference day's spreads, then straight lines between known neighbours.

    Interpolated numbers are written without decimals where they are whole, else with one.
    """
    v, name = c.strip(F.col("value")), F.col("col_name")
    marked = (F.col("col_idx") < 6) & v.contains("기준일") & (v.contains("스프레드") | v.contains("SP"))
    ref = F.min(F.when(marked, F.col("row_idx"))).over(W.partitionBy("doc_id"))
    open_ = c.strip(name).rlike("^Col_[0-9]+$")
    bare = F.replace(v, F.lit(","), F.lit(""))
    per = cells.withColumn("_ref", ref).groupBy("doc_id", "col_idx", "col_name").agg(F.max(F.when((F.col("row_idx") == F.col("_ref")) & bare.rlike(c.PLAIN), bare)).alias("_v"))
    per = per.withColumn("h", F.when(open_, F.coalesce("_v", "col_name")).otherwise(name))
    s = c.strip(F.col("h"))
    digits = F.replace(F.regexp_replace(s, "^[+-]+", ""), F.lit("."), F.lit("")).rlike("^[0-9]+$")
    num = F.when(digits & (F.col("col_idx") >= 5), s.try_cast("double"))
    known = F.when(num.isNotNull(), F.struct("col_idx", num.alias("num")))
    w = W.partitionBy("doc_id").orderBy("col_idx")
    per = per.withColumn("_l", F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_r", F.first(known, True).over(w.rowsBetween(1, W.unboundedFollowing)))
    step = (F.col("_r.num") - F.col("_l.num")) / (F.col("_r.col_idx") - F.col("_l.col_idx"))
    line = F.col("_l.num") + step * (F.col("col_idx") - F.col("_l.col_idx"))
    text = F.when(line == F.floor(line), F.floor(line).cast("string")).otherwise(F.format_string("%.1f", F.bround(line, 1)))
    still = s.rlike("^Col_[0-9]+$") & line.isNotNull()
    return per.select("doc_id", "col_idx", "col_name", F.when(still, text).otherwise(F.col("h")).alias("restored"))


def place_spreads(cells: DataFrame, grid: DataFrame, occupied: DataFrame) -> DataFrame:
    """The cells with spread values moved to the columns that the page shows as filled.

    grid(doc_id, row, col, x_min, x_max) and occupied(doc_id, row, col) come from the image.  Data rows and grid rows are
    matched by ordinal.  In a row without a spread value and with one filled cell the total goes there; one value goes to the one
    filled cell, or to the nearest of several (the first of equals).  Tables with fewer than 3 or more than 22 spread columns, or a grid that
    differs by more than 3 columns, stay as they are.
    """
    # cells are put together to rows once; what is told of a document is told beside its first row, and from there to all of them
    rows = cells.select("doc_id", "row_idx", F.struct("col_idx", "col_name", "value").alias("cell")).groupBy("doc_id", "row_idx").agg(F.collect_list("cell").alias("cells"))
    ends = W.unboundedPreceding, W.unboundedFollowing
    of = W.partitionBy("doc_id").orderBy("row_idx")
    v, at = lambda x: c.strip(x["value"]), lambda x, *places: x["col_idx"].isin(*places)
    mark = F.array_join("cells.value", "\n").contains(BEFORE_DATA) & F.exists("cells", lambda x: at(x, 0) & F.coalesce(x["value"].contains(BEFORE_DATA), F.lit(False)))
    label = F.exists("cells", lambda x: at(x, 0, 3) & F.coalesce(v(x).isin(END_LABELS), F.lit(False)))
    rows = rows.withColumns({"_mark": mark, "_label": label, "_heads": F.struct(F.col("cells.col_idx").alias("cols"), F.col("cells.col_name").alias("names"))})
    end = F.coalesce(F.min(F.when(F.col("_label") & ~F.col("_mark"), F.col("row_idx"))).over(of.rowsBetween(*ends)), F.max("row_idx").over(of.rowsBetween(*ends)) + 1)
    rows = rows.withColumns({"end_row": end, "_all": F.collect_set("_heads").over(of.rowsBetween(*ends)), "_i": F.row_number().over(of)})

    # the grid and what is filled in it, each as one row for a document
    top = F.col("row") == 0
    widths = grid.groupBy("doc_id", F.when(top, F.col("col")).alias("idx"), F.when(top, F.col("x_max") - F.col("x_min")).alias("w")).agg(F.max("col").alias("far"), F.count(F.lit(1)).cast("int").alias("n"))
    widths = widths.select("doc_id", "idx", "w", "far", F.explode(F.array_repeat(F.lit(0), F.when(F.col("idx").isNull(), 1).otherwise(F.col("n")))))
    shape = layout.uniform_suffix(widths, 1.3, (F.max("far") + 1).alias("grid_cols")).select("doc_id", F.col("start_idx").cast("int").alias("gs"), "grid_cols")
    filled = occupied.groupBy("doc_id", "row").agg(F.collect_list("col").alias("cols")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row", "cols"))).alias("filled"))

    named = F.flatten(F.transform("_all", lambda x: F.arrays_zip(x["cols"].alias("k"), x["names"].alias("name"))))
    place = lambda hit: F.array_min(F.transform(F.filter(named, lambda x: hit(x["name"])), lambda x: x["k"]))
    begins = F.struct(F.coalesce(place(c.spread_number), place(c.total_header) + 1).alias("start_col"), (F.array_max(F.flatten("_all.cols")) + 1).alias("columns"))
    first = lambda x: F.when(F.col("_i") == 1, x)
    rows = rows.join(shape, "doc_id", "left").join(filled, "doc_id", "left").withColumn("_b", first(begins)).withColumn("spreads", F.col("_b.columns") - F.col("_b.start_col"))
    fits = F.col("spreads").between(3, 22) & (F.abs(F.col("grid_cols") - F.col("gs") - F.col("spreads")) <= 3)
    offsets = lambda x: F.filter(F.transform(x["cols"], lambda k: k - F.col("gs")), lambda o: (o >= 0) & (o < F.col("spreads")))
    lines = F.transform("filled", lambda x: F.struct((-F.size(F.filter(x["cols"], lambda k: (k >= F.col("gs")) & (x["row"] < 5)))).alias("n"), x["row"].alias("row"), F.sort_array(F.array_distinct(offsets(x))).alias("occ"), F.exists(x["cols"], lambda k: k < F.least("gs", F.lit(3))).alias("text")))
    rows = rows.withColumn("_lines", F.when(fits, lines))
    fullest = F.array_min(F.filter("_lines", lambda x: x["n"] < 0))  # the header
    shown = F.filter("_lines", lambda x: (x["row"] > F.coalesce(fullest["row"], F.lit(0))) & (x["text"] | (F.size(x["occ"]) > 0)))
    rows = rows.withColumn("_told", F.when(F.col("_lines").isNotNull(), F.struct("_b.start_col", "_b.columns", F.transform(shown, lambda x: x["occ"]).alias("lines"))))
    start = F.max(F.when(F.col("_mark") & (F.col("row_idx") < F.col("end_row")), F.col("row_idx") + 1)).over(of.rowsBetween(*ends))
    rows = rows.select("doc_id", "row_idx", "cells", "end_row", F.coalesce(start, F.lit(0)).alias("start_row"), F.first("_told", True).over(of.rowsBetween(*ends)).alias("_told"))

    inside = (F.col("row_idx") >= F.col("start_row")) & (F.col("row_idx") < F.col("end_row"))
    rows = rows.withColumns({"start_col": F.col("_told.start_col"), "occ": F.when(inside, F.get("_told.lines", F.col("row_idx") - F.col("start_row"))), "total_col": F.pmod(F.col("_told.start_col") - 1 + F.col("_told.columns"), F.col("_told.columns"))})
    number = lambda x: (x["value"] != "") & c.plain_number(F.replace(v(x), F.lit(","), F.lit(""))).isNotNull()
    vals = F.filter("cells", lambda x: (x["col_idx"] >= F.col("start_col")) & number(x))
    total = F.array_max(F.transform(F.filter("cells", lambda x: (x["col_idx"] == F.col("total_col")) & (v(x) != "") & (v(x) != "nan")), lambda x: x["value"]))
    rows = rows.withColumn("vals", F.when(F.col("occ").isNotNull(), vals)).withColumn("total", F.when(F.size("vals") == 0, total))
    one, held = F.size("vals") == 1, F.get("vals", F.lit(0))
    near = F.array_min(F.transform("occ", lambda o: F.struct(F.abs(o - (held["col_idx"] - F.col("start_col"))).alias("d"), o.alias("o"))))["o"]
    to = F.when(one & (F.size("occ") > 0), near).when((F.size("vals") == 0) & (F.size("occ") == 1) & F.col("total").isNotNull(), F.get("occ", F.lit(0)))
    rows = rows.select("doc_id", "row_idx", "cells", (F.col("start_col") + to).alias("to"), F.when(one, held["col_idx"]).alias("from"), F.when(one, held["value"]).otherwise(F.col("total")).alias("moved"))
    moves = F.col("to").isNotNull() & ~F.coalesce(F.col("to") == F.col("from"), F.lit(False))
    out = rows.select("doc_id", "row_idx", "to", F.when(moves, F.col("from")).alias("from"), "moved", moves.alias("moves"), F.inline("cells"))
    value = F.when(F.col("moves") & (F.col("col_idx") == F.col("to")), F.col("moved")).when(F.col("col_idx") == F.col("from"), "").otherwise(F.col("value"))
    return out.select("doc_id", "row_idx", "col_idx", "col_name", value.alias("value"))


# -- corrections -------------------------------------------------------------------------------------


def name_kind(name: Column, idx: Column) -> Column:
    """Kind of a name column among the first six; null for others."""
    out = F.when(idx >= 6, F.lit(None).cast("string"))
    for kind, word, place, _ in NAME_COLUMNS:
        out = out.when(F.lower(name).contains(word) | (idx == place), kind)
    return out


def farthest() -> Column:
    """How far a correction of a kind may go."""
    most = F.lit(None).cast("int")
    for kind, _, _, limit in NAME_COLUMNS:
        most = F.coalesce(F.when(F.col("kind") == kind, F.lit(limit)), most)
    return most


def correct_names(cells: DataFrame, known: DataFrame, variants: DataFrame, spell=c.jamo) -> DataFrame:
    """cells with ``value`` corrected in name columns, and ``tier``, and with further columns as they are; known(kind, canonical_name, frequency), variants(kind, variant_text, canonical_name, occurrence_count).

    All kinds go through one lookup, by (kind, value); how far a correction may go is a column of the kind.  Different names and what becomes of them are written once, so cells
    are read twice and are not moved while the names fit into a broadcast; where they do not, cells that hold no name are spread evenly (``_at``).
    """
    rows = cells.withColumn("kind", name_kind(F.col("col_name"), F.col("col_idx")))
    open_ = F.col("kind").isNotNull() & (F.col("value") != "")
    rows = rows.withColumn("_at", F.when(open_, F.lit(0).cast("long")).otherwise(F.xxhash64("doc_id", "row_idx", "col_idx")))
    asked = kept(rows.where(open_).select("kind", "value").distinct(), "names")
    found = kept(entities.correct(asked, known, variants, farthest(), spell, ("kind",)), "corrections").withColumn("_at", F.lit(0).cast("long"))
    more = [x for x in cells.columns if x not in ("doc_id", "row_idx", "col_idx", "col_name", "value")]
    return rows.join(found, ["_at", "kind", "value"], "left").select("doc_id", "row_idx", "col_idx", "col_name", F.coalesce("corrected", "value").alias("value"), "tier", F.col("value").alias("original"), "kind", *more)


def correct_table(cells: DataFrame, pairs: list[tuple[str, str]], known: DataFrame, variants: DataFrame, dictionary_first: bool, spell=c.jamo) -> DataFrame:
    """Literal replacements in the first six columns and name corrections, in either order."""
    literal = lambda d: d.withColumn("value", F.when(F.col("col_idx") < 6, entities.replace_all(F.col("value"), pairs)).otherwise(F.col("value")))
    if dictionary_first:
        return correct_names(literal(cells), known, variants, spell)
    return literal(correct_names(cells, known, variants, spell))


def new_variants(corrected: DataFrame) -> DataFrame:
    """(kind, variant_text, canonical_name, occurrence_count) that :func:`correct_names` found by letters, to be appended to the known variants."""
    fuzzy = corrected.where("tier = 'fuzzy' AND original <> value")
    return fuzzy.groupBy("kind", F.col("original").alias("variant_text"), F.col("value").alias("canonical_name")).agg(F.count(F.lit(1)).alias("occurrence_count"))


def learned_variants(cells: DataFrame, known: DataFrame, variants: DataFrame, spell=c.jamo) -> DataFrame:
    """The :func:`new_variants` of cells that need not be corrected themselves: they are read once, to count their different names."""
    names = cells.select(name_kind(F.col("col_name"), F.col("col_idx")).alias("kind"), "value").where("kind IS NOT NULL AND value <> ''")
    counted = kept(names.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("occurrence_count")), "names")
    fuzzy = entities.correct(counted.select("kind", "value"), known, variants, farthest(), spell, ("kind",)).where("tier = 'fuzzy' AND corrected <> value")
    return fuzzy.join(counted, ["kind", "value"]).select("kind", F.col("value").alias("variant_text"), F.col("corrected").alias("canonical_name"), "occurrence_count")


def accept_chunks(original: DataFrame, corrected: DataFrame, size: int = 30) -> DataFrame:
    """Corrected cells chunk by chunk of ``size`` rows; a chunk whose correction has another number of rows stays as it was."""
    chunk = F.floor(F.col("row_idx") / size).cast("int").alias("chunk")
    rows = lambda d, n: d.groupBy("doc_id", chunk).agg(F.countDistinct("row_idx").alias(n))
    same = rows(original, "n_in").join(rows(corrected, "n_out"), ["doc_id", "chunk"]).where("n_in = n_out").select("doc_id", "chunk", F.lit(True).alias("_ok"))
    key = ["doc_id", "row_idx", "col_idx"]
    out = original.select(*key, "value", chunk).join(same, ["doc_id", "chunk"], "left").join(corrected.select(*key, F.col("value").alias("_new")), key, "left")
    return out.select(*key, F.when(F.col("_ok"), F.coalesce("_new", F.lit(""))).otherwise(F.col("value")).alias("value"))


# -- votes -------------------------------------------------------------------------------------------


def run_choices(runs: DataFrame) -> DataFrame:
    """(doc_id, runs, heads): the runs of the most frequent number of rows, then of columns, and the name that most of them give each column.

    Decided on one row for each column of a run, so no cell is moved for it.
    """
    named = runs.groupBy("doc_id", "run_id", "col_idx", "col_name").agg(F.max("row_idx").alias("row_idx"))  # cells are many, names of a column few
    names = named.select("doc_id", "run_id", "col_idx", "row_idx", F.struct("col_idx", "run_id", c.strip(F.col("col_name")).alias("value")).alias("named"))
    per_run = names.groupBy("doc_id", "run_id").agg(F.max("row_idx").alias("rows"), F.max("col_idx").alias("cols"), F.collect_set("named").alias("names"))
    shapes = F.sort_array(F.collect_list(F.struct(F.lit(1).cast("long").alias("n"), F.col("run_id").alias("p"), "rows", "cols", "names")))
    docs = per_run.groupBy("doc_id").agg(shapes.alias("shapes"))
    for of in "rows", "cols":
        usual = F.when(F.array_min(f"shapes.{of}") == F.array_max(f"shapes.{of}"), F.array_min(f"shapes.{of}")).otherwise(votes.most_frequent(F.col("shapes"), lambda x: x[of])["value"])  # noqa: B023
        docs = docs.withColumn("usual", usual).withColumn("shapes", F.filter("shapes", lambda x: x[of] == F.col("usual")))  # noqa: B023
    docs = docs.select("doc_id", F.col("shapes.p").alias("runs"), F.flatten("shapes.names").alias("l"))

    def head(column: Column) -> Column:
        own = lambda: F.filter("l", lambda x: x["col_idx"] == column)
        candidates = F.transform(own(), lambda x: F.struct(F.lit(1).cast("long").alias("n"), x["run_id"].alias("p"), x["value"].alias("value")))
        return F.struct(column.alias("key"), c.bound(candidates, lambda l: F.when(F.size(F.array_distinct(l["value"])) == 1, F.get(l, F.lit(0))["value"]).otherwise(votes.most_frequent(l)["value"])).alias("value"))

    heads = F.map_from_entries(F.transform(F.array_distinct("l.col_idx"), head))
    return docs.select("doc_id", "runs", heads.alias("heads"))


def consensus_tables(runs: DataFrame) -> DataFrame:
    """One table from several extractions runs(doc_id, run_id, row_idx, col_idx, col_name, value).

    Runs of the most frequent number of rows, then of columns, take part.  A cell's majority wins; without one, the first six columns
    vote by text and then by characters, others take the most frequent value.  Ties go to the earlier run.

    The runs are read twice: for their shapes, and for the votes, which all come from one list of a cell's values.  Where these are equal, or most are, or all differ in length, functions that Spark compiles
    say what wins; only the rest is counted by lambdas.
    """
    key = ["doc_id", "row_idx", "col_idx"]
    chosen = run_choices(runs).hint("shuffle_hash")  # looked up, so cells are sorted once, for their lists, and nothing of a document is written beside each
    kept = runs.join(chosen, "doc_id").where(F.array_contains("runs", F.col("run_id")))
    kept = kept.select(*key, F.element_at("heads", F.col("col_idx")).alias("col_name"), F.struct("run_id", c.strip(F.col("value")).alias("value")).alias("cell"))
    listed = kept.groupBy(*key, "col_name").agg(F.collect_list("cell").alias("cells"))
    listed = listed.select(*key, "col_name", "cells", F.col("cells.value").alias("values"), F.array_distinct("cells.value").alias("different"))
    n, different = F.size("values"), F.size("different")
    middle = F.get(F.sort_array("values"), F.floor(n / 2).cast("int"))  # a majority holds the middle
    most = n - F.size(F.array_remove("values", middle)) > F.floor(n / 2)
    lengths = F.array_distinct(F.transform("values", F.length))
    alone = (different == n) & (F.size(F.array_distinct("cells.run_id")) == n) & (F.size(F.array_except("different", F.array(F.lit(None).cast("string")))) == n) & (F.size(lengths) == n)  # then the earliest value has the earliest length, too
    value = F.when(different == 1, F.get("values", F.lit(0))).when(F.coalesce(most, F.lit(False)), middle).when(alone, F.array_min("cells")["value"]).otherwise(counted_votes(F.col("cells"), F.col("different"), F.col("col_idx")))
    return listed.select(*key, "col_name", value.alias("value"))


def counted_votes(cells: Column, different: Column, column: Column) -> Column:
    """What wins of a cell's (run_id, value), by count; in the first six columns without a majority by characters."""

    def count(v: Column) -> Column:
        own = F.filter(cells, lambda x: x["value"].eqNullSafe(v))
        return F.struct(F.size(own).cast("long").alias("n"), F.array_min(F.transform(own, lambda x: x["run_id"])).alias("p"), v.alias("value"))

    def decided(found: Column) -> Column:
        top = votes.most_frequent(found)
        return F.when((-top["m"] <= F.floor(votes.total(found) / 2)) & (column < 6), votes.by_characters(found)).otherwise(top["value"])

    return c.bound(F.transform(different, count), decided)


def merge_by_width(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two extractions of a table: the one with more columns (the first of equals) is kept, its empty cells filled from the other."""
    key = ["doc_id", "row_idx", "col_idx"]
    own = F.max("col_idx").over(W.partitionBy("doc_id"))
    width = lambda d: d.groupBy("doc_id").agg(F.max("col_idx").alias("_other"))
    # either side learns before they meet which one is kept: what a full join gives lies by no key, so its cells would be moved for it
    left = first.select(*key, F.col("value").alias("a"), own.alias("_own")).join(width(second), "doc_id", "left").select(*key, "a", F.coalesce(F.col("_other") > F.col("_own"), F.lit(False)).alias("_l"))
    right = second.select(*key, F.col("value").alias("b"), own.alias("_own")).join(width(first), "doc_id", "left").select(*key, "b", (F.col("_own") > F.coalesce("_other", F.lit(-1))).alias("_r"))
    rows = left.join(right, key, "full").withColumn("_second", F.coalesce("_l", "_r"))
    base, aux = F.when(F.col("_second"), F.col("b")).otherwise(F.col("a")), F.when(F.col("_second"), F.col("a")).otherwise(F.col("b"))
    empty = lambda x: c.strip(x).isin("", "nan")
    use = empty(base) & aux.isNotNull() & ~empty(aux)
    return rows.where(base.isNotNull()).select(*key, F.when(use, c.strip(aux)).otherwise(base).alias("value"), use.alias("filled"))


# -- what is learned from tables ---------------------------------------------------------------------


def keyword_events(titles: DataFrame, cells: DataFrame, values: int = 20, types: DataFrame | None = None) -> DataFrame:
    """(doc_id, keyword, weight): words of the title (3), of the headers (2) and of the first distinct values of the first column (1).

    With types(doc_id, doc_type) also the type; it comes to the texts where they lie by document, and no word is moved for it.
    """
    word = lambda text: F.explode(c.tokens(text)).alias("keyword")
    heads = cells.select("doc_id", "col_idx", "col_name").distinct()
    first = cells.where("col_idx = 0").groupBy("doc_id", "value").agg(F.min("row_idx").alias("_row"))
    first = first.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("_row"))).where(F.col("_n") <= values)
    typed = lambda d: d if types is None else d.join(types.select("doc_id", "doc_type"), "doc_id")
    kept = ["doc_id"] if types is None else ["doc_id", "doc_type"]
    parts = [typed(d).select(*kept, word(F.col(text)), F.lit(weight).alias("weight")) for d, text, weight in ((titles.select("doc_id", "title"), "title", 3.0), (heads, "col_name", 2.0), (first, "value", 1.0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def header_lists(cells: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, headers): the named columns in order, of tables with three of them or more."""
    name = c.strip(F.col("col_name"))
    heads = cells.where((name != "") & ~F.col("col_name").startswith("Col_")).select("doc_id", "col_idx", name.alias("name")).distinct()
    listed = heads.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "name"))), lambda s: s["name"]).alias("headers"))
    return listed.where(F.size("headers") >= least)


def feature_text(meta: DataFrame, cells: DataFrame, rows: int = 5) -> DataFrame:
    """(doc_id, text) for a classifier: title and info of meta(doc_id, title, info), the headers and the first values of the first column."""
    joined = lambda hit, value, *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct(*by, F.col(value).alias("v"))))), lambda s: s["v"]), " ")
    per = cells.groupBy("doc_id").agg(joined(F.col("row_idx") == 0, "col_name", "col_idx").alias("_h"), joined((F.col("col_idx") == 0) & (F.col("row_idx") < rows), "value", "row_idx").alias("_f"))
    return meta.join(per, "doc_id").select("doc_id", F.concat_ws(" ", "title", F.array_join("info", " "), "_h", "_f").alias("text"))


def header_overlap(cells: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, overlap): the largest share of a known header list, patterns(headers), that a table has.

    Tables and lists meet on the names that they share, so the patterns may be as many as have been learned; without any, there are no rows.
    """
    own = cells.select("doc_id", c.strip(F.col("col_name")).alias("name")).distinct()
    lists = patterns.select(F.array_distinct("headers").alias("headers")).distinct().withColumn("_id", F.xxhash64("headers")).withColumn("_n", F.size("headers")).where("_n > 0")
    named = lists.select("_id", "headers", "_n", F.explode("headers").alias("name"))
    shared = own.join(named, "name").groupBy("doc_id", "_id", "headers", "_n").agg(F.count(F.lit(1)).alias("_m"))
    best = shared.groupBy("doc_id").agg(F.max(F.col("_m") / F.col("_n")).alias("overlap"))
    some = lists.limit(1).select(F.lit(True).alias("_some"))
    return own.select("doc_id").distinct().join(best, "doc_id", "left").join(F.broadcast(some)).select("doc_id", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


# -- tables from coordinates, stored results, halves -------------------------------------------------


def coordinate_tables(boxes: DataFrame, share: float = 0.6) -> DataFrame:
    """Cells of pages without usable lines, from coordinates alone.

    Rows are anchored with a tolerance of ``share`` times the mean box height, in whole units.  There are as many columns as the fullest row has boxes; they stand where
    boxes of all rows gather (:func:`.layout.column_places`), and a box belongs to the column between whose midpoints its center lies.  The first row names the columns
    (``Col_i`` where it is empty); of a page with one row, that row is the data and columns are named by their number.  Rows and columns without data go.
    """
    rows = boxes.join(layout.rows_anchored(boxes, F.floor(F.avg(F.col("y_max") - F.col("y_min")) * share)), ["doc_id", "box_id"])
    width = rows.groupBy("doc_id", "row_no").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.max("n").cast("int").alias("k"), (F.max("row_no") + 1).cast("int").alias("rows"))
    placed = layout.assign_columns(rows, layout.column_places(boxes, width.select("doc_id", "k"))).join(width, "doc_id")
    at = F.least(F.col("col_no"), F.col("k") - 1).alias("col_idx")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x_center", "y_center", "box_id", "text"))), lambda s: s["text"]), " ")
    texts = placed.groupBy("doc_id", F.col("row_no").alias("row_idx"), at).agg(text.alias("value"))
    frame = width.select("doc_id", "rows", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row_idx"), "k").select("doc_id", "rows", "row_idx", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("col_idx"))
    cells = frame.join(texts, ["doc_id", "row_idx", "col_idx"], "left").withColumn("value", F.coalesce("value", F.lit("")))
    named = normalize_raw(cells.where("rows > 1").select("doc_id", "row_idx", "col_idx", "value"))
    alone = cells.where("rows = 1 AND value <> ''").select("doc_id", "row_idx", "col_idx", F.col("col_idx").cast("string").alias("col_name"), "value")
    return named.unionByName(alone)


def grid_or_coordinates(boxes: DataFrame, grid: DataFrame, columns: int = 3) -> DataFrame:
    """Cells (with ``by``: grid or coordinates) of pages: boxes in the detected grid where that gives a table of ``columns`` columns or more, else by coordinates.

    In a grid the first row names the columns, and rows and columns without data go, as in :func:`coordinate_tables`.
    """
    texts = layout.boxes_to_cells(boxes, grid)
    frame = grid.select("doc_id", F.col("row").alias("row_idx"), F.col("col").alias("col_idx")).distinct()
    ruled = normalize_raw(frame.join(texts.withColumnsRenamed({"row": "row_idx", "col": "col_idx"}), ["doc_id", "row_idx", "col_idx"], "left"))
    wide = ruled.groupBy("doc_id").agg(F.countDistinct("col_idx").alias("n")).where(F.col("n") >= columns).select("doc_id")
    first = ruled.join(wide, "doc_id", "left_semi").withColumn("by", F.lit("grid"))
    return first.unionByName(coordinate_tables(boxes.join(wide, "doc_id", "left_anti")).withColumn("by", F.lit("coordinates")))


def stored_tables(cache: DataFrame, key: str, result: str) -> DataFrame:
    """Cells (key, table_no, row_idx, col_idx, col_name, value) of stored results, each one table {headers, rows} or a list of them.

    Tables without headers or rows are passed over and do not count.  Headers beyond the first row's width are left out; a row that is shorter has empty texts.
    """
    one = "headers array<string>, rows array<array<string>>"
    text = c.strip(F.col(result))
    tables = F.when(text.startswith("["), F.from_json(text, f"array<struct<{one}>>")).otherwise(F.array(F.from_json(text, one)))
    usable = F.filter(tables, lambda t: t.isNotNull() & (F.coalesce(F.size(t["headers"]), F.lit(0)) > 0) & (F.coalesce(F.size(t["rows"]), F.lit(0)) > 0))
    rows = cache.select(key, F.posexplode(usable).alias("table_no", "t")).select(key, "table_no", F.col("t.headers").alias("headers"), F.size(F.get("t.rows", F.lit(0))).alias("_w"), F.posexplode("t.rows").alias("row_idx", "v"))
    rows = rows.withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.least(F.col("_w"), F.size("headers")) - 1)))
    return rows.select(key, "table_no", "row_idx", "col_idx", F.get("headers", F.col("col_idx")).alias("col_name"), F.coalesce(F.get("v", F.col("col_idx")), F.lit("")).alias("value"))


def stored_metadata(cache: DataFrame, key: str, result: str) -> DataFrame:
    """(key, title) of stored results: of a list, that of the first table that has any metadata."""
    text = c.strip(F.col(result))
    meta = "metadata struct<title:string>"
    listed = F.filter(F.from_json(text, f"array<struct<{meta}>>"), lambda t: t["metadata"].isNotNull())
    found = F.when(text.startswith("["), F.get(listed, F.lit(0))["metadata"]["title"]).otherwise(F.from_json(text, meta)["metadata"]["title"])
    return cache.select(key, F.coalesce(found, F.lit("")).alias("title"))


def merge_halves(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two halves of a page side by side: the left one's cells and the columns that only the right one has.

    Rows meet by the left half's first column where the right half has a column of that name: each left row stays, once for each right row of its
    key, with empty texts where there is none.  Otherwise they meet by their order, as far as both go.  A half that is empty leaves the other as it is; so
    does a right half without columns of its own.
    """
    key = ["doc_id"]
    names = lambda d, side: d.groupBy("doc_id", "col_name").agg(F.min("col_idx").alias(f"_{side}"))
    ln, rn = names(left, "l"), names(right, "r")
    only = rn.join(ln, ["doc_id", "col_name"], "left_anti")
    first = left.groupBy("doc_id").agg(F.min_by("col_name", "col_idx").alias("_key"), (F.max("col_idx") + 1).alias("_width"))
    shared = first.join(rn.withColumnRenamed("col_name", "_key"), ["doc_id", "_key"], "left").select("doc_id", "_width", F.col("_r").alias("_key_col"))
    both = shared.join(only.select("doc_id").distinct(), "doc_id")
    at = only.withColumn("_to", F.row_number().over(W.partitionBy("doc_id").orderBy("_r")) - 1).select("doc_id", "col_name", "_to")

    lk = left.join(both, key).groupBy("doc_id", "row_idx", "_key_col").agg(F.min_by("value", "col_idx").alias("_v"))
    rk = right.join(both, key).groupBy("doc_id", F.col("row_idx").alias("_rrow"), "_key_col").agg(F.max(F.when(F.col("col_idx") == F.col("_key_col"), F.col("value"))).alias("_v"))
    nth = lambda d, order: d.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy(order)))
    keyed = lk.where("_key_col IS NOT NULL").drop("_key_col").join(rk.where("_key_col IS NOT NULL").drop("_key_col"), ["doc_id", "_v"], "left").select("doc_id", "row_idx", "_rrow")
    ordered = nth(lk.where("_key_col IS NULL"), "row_idx").join(nth(rk.where("_key_col IS NULL"), "_rrow").select("doc_id", "_n", "_rrow"), ["doc_id", "_n"]).select("doc_id", "row_idx", "_rrow")
    pairs = keyed.unionByName(ordered).withColumn("_place", (F.row_number().over(W.partitionBy("doc_id").orderBy("row_idx", F.col("_rrow").asc_nulls_first())) - 1).cast("int"))

    own = pairs.join(left, ["doc_id", "row_idx"]).select("doc_id", F.col("_place").alias("row_idx"), "col_idx", "col_name", "value")
    more = pairs.join(both.select("doc_id", "_width"), "doc_id").join(at, "doc_id")
    found = right.select("doc_id", F.col("row_idx").alias("_rrow"), "col_name", "value")
    new = more.join(found, ["doc_id", "_rrow", "col_name"], "left").select("doc_id", F.col("_place").alias("row_idx"), (F.col("_width") + F.col("_to")).cast("int").alias("col_idx"), "col_name", F.coalesce("value", F.lit("")).alias("value"))
    columns = ["doc_id", "row_idx", "col_idx", "col_name", "value"]
    docs = both.select("doc_id")
    alone = left.join(docs, "doc_id", "left_anti").select(columns).unionByName(right.join(left.select("doc_id").distinct(), "doc_id", "left_anti").select(columns))
    return alone.unionByName(own).unionByName(new)
