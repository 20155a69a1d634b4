"""Rows of a document are dealt once, before they are expanded to cells; cells are not moved to their document again."""

import pytest

from gridloom.operators import tables
from gridloom.plans import fixtures as x
from gridloom.plans import flows, rules
from gridloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc_id")


@pytest.mark.parametrize("sql", [rules.SHEET, flows.SHEETS], ids=["sheet", "sheets"])
def test_cells_stay_with_their_document(spark, sql):
    assert moves(x.frame(spark, SF, sql).groupBy("doc_id", "row_idx").count()) == 0


def test_consensus_moves_no_cell(spark):
    assert moves(QUERIES["consensus_table"](spark, SF)) == 0


def test_names_of_a_run_that_vary_by_row(spark):
    rows = [(1, u, r, 0, " a " if (u, r) == (0, 1) else ("a" if u < 2 else "b"), v) for u in range(3) for r, v in ((0, "x"), (1, "y" if u else " z "))]
    out = tables.consensus_tables(spark.createDataFrame(rows, "doc_id long, run_id int, row_idx int, col_idx int, col_name string, value string"))
    assert sorted(tuple(r) for r in out.select("row_idx", "col_idx", "col_name", "value").collect()) == [(0, 0, "a", "x"), (1, 0, "a", "y")]


def test_parts_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(x, "PART_BYTES", 1000)
    assert x.parts(spark, f"{SF}/region.parquet") == int(spark.conf.get("spark.sql.shuffle.partitions")) < x.parts(spark, f"{SF}/lineitem.parquet")


def test_raw_tables_move_no_cell(spark):
    assert moves(QUERIES["raw_table_normalize"](spark, SF)) == 0


def test_restored_headers_move_no_cell(spark):
    assert moves(QUERIES["header_restore"](spark, SF)) == 0


def test_corrections_move_no_cell(spark):
    assert moves(QUERIES["correction_events"](spark, SF)) == 0


def test_generated_methods_can_be_compiled(spark):
    """Of more than 8000 bytes none is, and Spark takes up to 65535 by default."""
    QUERIES["correction_events"](spark, SF)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_white_space_of_any_kind_is_stripped(spark):
    from gridloom.functions import cells as c

    rows = [(" a b\t",), ("\n\x0b\f\r x\u00a0 ",), ("",), (" \t ",), (None,), ("가 나 ",), ("a \u2028",)]
    found = [r[0] for r in spark.createDataFrame(rows, "v string").select(c.strip(c.F.col("v"))).collect()]
    assert found == ["a b", "x\u00a0", "", "", None, "가 나", "a \u2028"]


def test_names_move_no_cell(spark):
    plan = QUERIES["entity_table_correct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x and "value" in x.split("]")[0]]


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_names_are_corrected_whichever_join(spark, limit):
    cells = spark.createDataFrame([(d, 0, k, "회사명" if k == 0 else "x", v) for d in range(3) for k, v in ((0, "firm on"), (1, None), (2, ""), (7, "firm on"))], "doc_id long, row_idx int, col_idx int, col_name string, value string")
    known = spark.createDataFrame([("company", "firm one", 5)], "kind string, canonical_name string, frequency long")
    variants = spark.createDataFrame([], "kind string, variant_text string, canonical_name string, occurrence_count long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        out = sorted((r["doc_id"], r["col_idx"], r["value"], r["tier"]) for r in tables.correct_names(cells, known, variants).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out == [(d, *x) for d in range(3) for x in ((0, "firm one", "fuzzy"), (1, None, None), (2, "", None), (7, "firm on", None))]


@pytest.mark.parametrize("name", ["sheet_plan", "spread_realign"])
def test_plans_and_spreads_move_no_cell(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if " Exchange hashpartitioning(" in x and "row_idx" in x.split("Exchange")[1].split("), ")[0]]


def test_a_plan_makes_its_cells_once(spark):
    """Once for the workbook, once for the errors; what is dealt by number is the rows of cells."""
    plan = QUERIES["sheet_plan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") <= 2


def test_heads_of_ragged_and_empty_tables(spark):
    from gridloom.operators import sheets

    rows = [("a", 1, 0, 0, "n", "x"), ("a", 1, 1, 0, "n", "y"), ("a", 1, 1, 2, "p", "5%"), ("b", 0, 0, 0, "n", "n")]
    meta = spark.createDataFrame([("a", "t", None, []), ("b", "u", None, None)], "doc_id string, title string, info array<struct<label:string,value:string>>, market_info array<struct<label:string,value:string>>")
    out = sheets.sheet_plan(spark.createDataFrame(rows, "doc_id string, table_no int, row_idx int, col_idx int, col_name string, value string"), None, meta, meta.select("doc_id"))
    found = sorted((r["doc_id"], r["sheet"], r["row"], r["col"], r["value"], r["number"]) for r in out.collect())
    heads = [("a", "표2", 0, 0, "n", None), ("a", "표2", 0, 2, "p", None)]
    assert found == sorted([("a", "표1", 0, 0, "t", None), *heads, ("a", "표2", 1, 0, "x", None), ("a", "표2", 2, 0, "y", None), ("a", "표2", 2, 2, "5%", 0.05), ("b", "결과", 0, 0, sheets.NO_TABLES, None)])


def test_numbers_without_marks(spark):
    from gridloom.functions import cells as c

    rows = ["₩ 1,2 원", "5%%", "5%,", "%", "1 2\t3%", "-.5e3 원%", "1d", "", None, "원"]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "v string").select(c.parse_numeric(c.F.col("v"))).collect()]
    assert found == [12.0, 5.0, None, None, 123.0, -500.0, None, None, None, None]


def test_n_grams_are_not_moved(spark, monkeypatch):
    from gridloom.operators import classify

    docs = spark.createDataFrame([(d, f"ab{d % 3} cd") for d in range(40)], "doc_id long, text string")
    counts = classify.gram_counts(classify.dealt(docs), 2, 4)
    assert "Exchange hashpartitioning(doc_id" not in counts._jdf.queryExecution().optimizedPlan().toString() and "gram" not in "".join(x for x in counts._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
    monkeypatch.setattr(classify, "PART_BYTES", 20)
    assert classify.dealt(docs).rdd.getNumPartitions() == 12  # 240 bytes; with texts, not with the session, grows the number of tasks


def test_positions_are_moved_once(spark):
    plan = QUERIES["cluster_positions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.split("\n") if "Exchange hashpartitioning(" in x and "pos" in x.split("hashpartitioning")[1].split(")")[0]]) == 0 and plan.count("Exchange hashpartitioning(doc_id") <= 2


def test_shuffles_start_with_more_partitions_for_larger_tables(spark, monkeypatch):
    monkeypatch.setattr(x, "SHUFFLE_BYTES", 10000)
    QUERIES["cluster_positions"](spark, SF)
    assert int(spark.conf.get(x.PARTITIONS)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.undo()
    QUERIES["cluster_positions"](spark, SF)
    assert int(spark.conf.get(x.PARTITIONS)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_merged_cells_are_not_moved(spark):
    assert moves(QUERIES["merge_by_width"](spark, SF)) == 0


def test_merge_of_documents_of_one_side(spark):
    cells = lambda rows: spark.createDataFrame(rows, "doc_id string, row_idx int, col_idx int, value string")
    first = cells([("a", 0, 0, "x"), ("b", 0, 0, " "), ("b", 0, 1, "z"), ("d", 0, 0, "p")])
    second = cells([("b", 0, 0, " y "), ("b", 1, 0, "w"), ("c", 0, 0, "v"), ("d", 0, 0, "q"), ("d", 0, 1, ""), ("d", 1, 0, None)])
    out = tables.merge_by_width(first, second)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 0, "x", False), ("b", 0, 0, "y", True), ("b", 0, 1, "z", False), ("c", 0, 0, "v", False), ("d", 0, 0, "q", False), ("d", 0, 1, "", False)]


def test_changed_cells_are_moved_by_file_only(spark):
    plan = QUERIES["output_changes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(path" in x and "sheet" in x.split("hashpartitioning")[1].split("), ")[0]]


def test_words_are_not_moved_to_their_type(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["keyword_fingerprint"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    generated = plan.index("Generate explode")
    assert "Exchange hashpartitioning(doc_id" not in plan[:generated]


def test_cells_of_grids_are_neither_moved_nor_sorted(spark):
    """Lines are dealt by document before boxes and grids are made of them; boxes and their texts are looked up."""
    plan = QUERIES["grid_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in "".join(x for x in plan.split("\n") if " Exchange hashpartitioning(" in x)
    assert "SortMergeJoin" not in plan


def test_grid_of_texts_in_few_columns(spark):
    boxes = spark.createDataFrame([("a", 0, "회사명", 5.0, 5.0), ("a", 1, "b", 5.0, 15.0), ("a", 2, "a", 6.0, 15.0), ("a", 3, " ", 15.0, 5.0), ("b", 0, "x", 5.0, 5.0)], "doc_id string, box_id int, text string, x_center double, y_center double")
    cells = [(d, r, k, 10.0 * k, 10.0 * k + 9, 10.0 * r, 10.0 * r + 9) for d in "abc" for r in range(2) for k in range(3)]
    grid = spark.createDataFrame(cells, "doc_id string, row int, col int, gx_min double, gx_max double, gy_min double, gy_max double")
    out = tables.grid_tables(boxes, grid)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 0, "회사명", "b a"), ("a", 0, 1, "Col_1", ""), ("a", 0, 2, "Col_2", "")]


def test_lines_place_their_boxes_once(spark):
    """Boxes are read for the header's place and for the rows, and rows are not joined with themselves."""
    boxes = spark.range(9).selectExpr("id % 2 AS doc_id", "CAST(id AS INT) AS box_id", "CAST(id AS STRING) AS text", "CAST(id AS DOUBLE) AS x_center", "CAST(30 * (id div 4) AS DOUBLE) AS y_center", "CAST(500 AS DOUBLE) AS y_min")
    pages = spark.createDataFrame([(0, 100.0), (1, 100.0)], "doc_id long, height double")
    out = tables.line_tables(boxes, pages)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 9") == 2
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0, 0, "0", "4"), (0, 0, 1, "2", "6"), (0, 1, 0, "0", "8"), (0, 1, 1, "2", ""), (1, 0, 0, "1", "5"), (1, 0, 1, "3", "7")]


def test_routes_come_along_with_corrected_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0, "회사명", "firm on", "lines"), (1, 0, 1, "x", None, "raw")], "doc_id long, row_idx int, col_idx int, col_name string, value string, route string")
    known = spark.createDataFrame([("company", "firm one", 5)], "kind string, canonical_name string, frequency long")
    variants = spark.createDataFrame([], "kind string, variant_text string, canonical_name string, occurrence_count long")
    out = tables.correct_table(cells, [("on", "on")], known, variants, True)
    assert sorted((r["col_idx"], r["value"], r["route"]) for r in out.collect()) == [(0, "firm one", "lines"), (1, None, "raw")]


def test_learned_variants_read_cells_once(spark):
    """The query's cells are read to count their names; what follows reads what was counted."""
    plan = QUERIES["learned_variants"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_only_events_asked_for_are_made(spark):
    from gridloom.operators import learning

    cells = spark.range(4).selectExpr("id % 2 AS doc_id", "CAST(id div 2 AS INT) AS row_idx", "0 AS col_idx", "'이름' AS col_name", "CAST(id AS STRING) AS value")
    types = spark.createDataFrame([(0, "x"), (1, "y")], "doc_id long, doc_type string")
    events = learning.learn(cells, types)
    assert events._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 4") == 1
    some = learning.learn(cells, types, kinds=("number",))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, events.where("kind = 'number'").collect())) and some.count() == 4


@pytest.mark.parametrize("sql", [rules._ROWS, flows._PLACED], ids=["sheet", "placed"])
def test_rows_of_unions_are_made_once(spark, sql):
    """As the SQL says, from one reading of their table, which is dealt once."""
    made, said = x.frame(spark, SF, sql), spark.sql(sql)
    assert made.dtypes == said.dtypes and made.count() == said.count() and not made.exceptAll(said).take(1)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_learned_cells_stay_in_their_parts(spark, monkeypatch):
    """Also where there are more parts than the session's shuffles have."""
    monkeypatch.setattr(x, "PART_BYTES", 10000)
    assert moves(QUERIES["learn_events"](spark, SF)) == 0


def test_a_plan_puts_its_cells_together_once(spark):
    """Cells become rows once; windows and joins see rows, and no lambda stands where a cell is told its number and style."""
    plan = QUERIES["sheet_plan"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "Window" in x and "col_idx" in x.split("],")[-1]]
    assert "lambda" not in plan[0] and len([x for x in plan if "collect_list" in x]) == 1


def test_promotion_of_ragged_tables(spark):
    """Columns that the header's row lacks, nulls, a header with a name twice, a table that is gone."""
    from gridloom.operators import sheets

    rows = [("a", 0, 0, "Col_0", " 구분"), ("a", 0, 1, "Col_1", None), ("a", 1, 0, "Col_0", "x "), ("a", 1, 2, "Col_2", "y"), ("a", 2, 0, "Col_0", None), ("a", 3, 0, "Col_0", "열2"), ("a", 3, 1, "Col_1", "구분"), ("a", 3, 2, "Col_2", "열3"), ("a", 4, 0, "Col_0", "Col_9"),
            ("b", 0, 0, "n", "n"), ("c", 0, 0, "구분", "구분"), ("c", 0, 0, "구분", "z"), ("c", 1, 0, None, "w")]
    out = sheets.promoted(spark.createDataFrame(rows, "doc_id string, row_idx int, col_idx int, col_name string, value string"))
    assert sorted(tuple(r) for r in out.select("doc_id", "row_idx", "place", "col_idx", "col_name", "value").collect() if r["col_name"]) == [("a", 1, 0, 0, "구분", "x "), ("a", 1, 0, 2, "열3", "y"), ("c", 0, 0, 0, "구분", "z"), ("c", 0, 0, 0, "구분", "구분")]


def test_votes_by_brute_force(spark):
    """Equal values, majorities, values of different and of equal lengths, empty ones, among two to five runs."""
    import random
    from collections import defaultdict

    pick, rows = random.Random(5), []
    for d in range(60):
        for u in range(pick.choice((2, 3, 5))):
            rows += [(d, u, r, k, "n", pick.choice(("ab", "ab", "ac", "abc", "b", "", "xy1", " ab "))) for r in range(2) for k in (1, 7)]
    out = tables.consensus_tables(spark.createDataFrame(rows, "doc_id long, run_id int, row_idx int, col_idx int, col_name string, value string"))

    def best(found):  # of (run, what) the most frequent, the earliest of equals
        seen = defaultdict(list)
        for u, x in found:
            seen[x].append(u)
        return min((-len(us), min(us), x) for x, us in seen.items())

    cells = defaultdict(list)
    for d, u, r, k, _, x in rows:
        cells[d, r, k].append((u, x.strip()))
    for key, found in cells.items():
        n, _, x = best(found)
        if -n * 2 <= len(found) - len(found) % 2 and key[2] < 6 and -n < 2:
            size = best([(u, len(y)) for u, y in found])[2]
            x = "".join(best([(u, y[i]) for u, y in found if len(y) == size])[2] for i in range(size))
        cells[key] = x
    assert {(r["doc_id"], r["row_idx"], r["col_idx"]): r["value"] for r in out.collect()} == cells


def test_chosen_runs_are_looked_up(spark):
    """Cells are sorted for their lists alone: the join with what is chosen for their document sorts nothing."""
    assert "SortMergeJoin" not in QUERIES["consensus_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_spreads_read_their_cells_once(spark):
    plan = QUERIES["spread_realign"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") <= 3  # cells, grid and filled places


def test_spread_numbers(spark):
    from gridloom.functions import cells as c

    names = ["-100", "++6.5%", "%5", "Col_3", "x (+3.5)", "x (5%)", "(7)b)", "()", "(1)(2) z", "1)", "+", ".", "5(a)", "12 (b", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in names], "h string").select(c.spread_number(c.F.col("h"))).collect()] == [True, True, True, False, True, False, False, False, True, False, False, False, False, False, None]
