"""Events of a batch, state from base and deltas, and the chain from documents to workbooks."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from gridloom.operators import conversion, learning, sheets
from gridloom.plans import fixtures, flows
from gridloom.sources import xlsx

CELLS = "doc_id string, row_idx int, col_idx int, col_name string, value string"
SF = "/root/testdata/sf0.001"


def learned(spark):
    rows = [("회사명", ["삼성 증권", "한국,-", " 12-3 ", "삼성 증권"]), ("부서", ["운용팀", "x", "운용팀 ", "7"]), ("Col_2", ["1,000", "abc", "-2.5", ""]), (" 금액 ", ["5", "", "", "1d"])]
    cells = spark.createDataFrame([("d", r, k, n, v) for k, (n, vs) in enumerate(rows) for r, v in enumerate(vs)] + [("e", 0, 0, "a", "bb cc")], CELLS).repartition(3)
    types = spark.createDataFrame([("d", "demand"), ("e", "other")], "doc_id string, doc_type string")
    pair = "array<struct<label:string,value:string>>"
    meta = spark.createDataFrame([("d", "수요 예측", [("발행", "1"), (None, "2")], []), ("e", "", [], [("국고", "3")])], f"doc_id string, title string, info {pair}, market_info {pair}")
    return learning.learn(cells, types, meta)


def test_events_by_hand(spark):
    found = sorted((r["kind"], r["doc_id"], r["name"] or "", r["position"], r["weight"], r["number"], r["text"]) for r in learned(spark).collect())
    word = lambda d, w, x: ("keyword", d, w, None, x, None, None)
    want = [("column", "d", "회사명", 0, None, None, None), ("column", "d", "부서", 1, None, None, None), ("column", "d", "금액", 3, None, None, None), ("column", "e", "a", 0, None, None, None)]
    want += [("header", "d", "", None, None, 4.0, '["회사명","부서","금액"]')]
    want += [word("d", "수요", 3.0), word("d", "예측", 3.0), word("d", "회사명", 2.0), word("d", "부서", 2.0), word("d", "Col_2", 2.0), word("d", "금액", 2.0), word("d", "삼성", 1.0), word("d", "증권", 1.0), word("d", "한국", 1.0), word("d", "12", 1.0), word("e", "bb", 1.0), word("e", "cc", 1.0)]
    want += [("number", "d", n, None, None, x, None) for n, x in (("부서", 7.0), ("Col_2", 1000.0), ("Col_2", -2.5), (" 금액 ", 5.0))]
    want += [("entity", "d", n, None, None, None, k) for n, k in (("삼성 증권", "company"), ("한국,-", "company"), ("운용팀", "department"))]  # 12-3 is a number, x is too short, e has too few columns
    want += [("metadata", "d", "info_labels", None, None, None, '["발행"]'), ("metadata", "d", "title_sample", None, None, None, "수요 예측"), ("metadata", "e", "market_info_labels", None, None, None, '["국고"]')]
    assert found == sorted(want)
    plan = learned(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") <= 6  # cells once for both kinds of events; the rest brings types


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "events")
    one, two = learned(spark).where("doc_id = 'd'"), learned(spark).where("doc_id = 'e'")
    learning.write_batch(one, folder, "b1")
    learning.write_batch(two, folder, "b2")
    read = lambda: sorted(map(repr, spark.read.parquet(folder).collect()))
    first = read()
    files = {p for p in glob.glob(f"{folder}/batch=b2/*.parquet")}
    learning.write_batch(one, folder, "b1")
    assert read() == first and {p for p in glob.glob(f"{folder}/batch=b2/*.parquet")} == files


@pytest.mark.parametrize("kind", sorted(learning.AGGREGATES))
def test_state_equals_full_aggregation(spark, tmp_path, kind):
    events = flows.learned_events(lambda sql: fixtures.frame(spark, SF, sql)).where("doc_id < 300").cache()
    aggregate = learning.AGGREGATES[kind]
    state = learning.State(spark, str(tmp_path / "state"), aggregate)
    part = lambda k: events.where(F.pmod("doc_id", F.lit(4)) == k)
    shown = lambda d: sorted(map(repr, (tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in d.select(sorted(d.columns)).collect())))
    assert state.current().count() == 0
    assert state.add("a", part(0)) and state.add("b", part(1)) and state.add("b", part(1))
    assert shown(state.current()) == shown(aggregate.partial(part(0).unionByName(part(1))))
    assert state.compact() == "000000000" and state.compact() is None
    assert not state.add("a", part(0))  # the base holds it
    assert state.add("c", part(2)) and state.add("d", part(3))
    plan = state.current()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 3 and "Scan ExistingRDD" not in plan  # the base and two deltas, no history
    assert shown(state.current()) == shown(aggregate.partial(events))
    state.compact()
    assert shown(state.current()) == shown(aggregate.partial(events)) and sorted(os.listdir(tmp_path / "state" / "bases")) == ["000000001"]


def test_a_compaction_that_broke_off_counts_for_nothing(spark, tmp_path):
    state = learning.State(spark, str(tmp_path / "state"), learning.AGGREGATES["keywords"])
    state.add("a", learned(spark).where("doc_id = 'd'"))
    before = sorted(map(repr, state.current().collect()))
    state.aggregate.partial(learned(spark)).write.parquet(str(tmp_path / "state" / "bases" / "000000000"))  # and no list of its batches
    assert sorted(map(repr, state.current().collect())) == before
    state.compact()
    assert sorted(map(repr, state.current().collect())) == before


def test_seeds_are_added_once(spark, tmp_path):
    seeds = lambda s: s.createDataFrame([("company", "삼성 증권", 100), ("company", "새 이름", 1)], "text string, name string, n long")
    aggregate = learning.Aggregate(("text", "name"), {"n": "sum"}, learning.AGGREGATES["entities"].make, seeds)
    state = learning.State(spark, str(tmp_path / "state"), aggregate)
    assert {r["name"]: r["n"] for r in state.current().collect()} == {"삼성 증권": 100, "새 이름": 1}
    state.add("a", learned(spark))
    found = {r["name"]: r["n"] for r in state.current().collect()}
    assert found["삼성 증권"] == 1 and found["새 이름"] == 1 and found["운용팀"] == 1


def test_the_chain_ends_in_workbooks(spark, tmp_path):
    """All outputs of the chain agree with each other; sources are scanned a few times, however many outputs there are."""
    few = lambda sql: fixtures.frame(spark, SF, sql).where("doc_id < 60") if "doc_id" in fixtures.frame(spark, SF, sql).columns else fixtures.frame(spark, SF, sql)
    out = conversion.convert(flows.inputs(few))
    cells = {(r["doc_id"], r["row_idx"], r["col_idx"]): r for r in out.cells.collect()}
    assert {r["route"] for r in cells.values()} == {"cached", "raw", "ruled", "lines"} and len(cells) == out.cells.count()
    for d, scans in ((out.cells, 0), (out.types, 0), (out.errors, 0), (out.events, 0), (out.plan, 1)):  # from what was written; the plan reads the list of documents for those without cells
        assert d._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == scans
    errors = {(r["doc_id"], r["row_idx"], r["col_idx"]) for r in out.errors.collect()}
    assert errors <= set(cells)
    plan = out.plan.withColumn("doc_id", F.col("doc_id").cast("string"))
    body = plan.where("style NOT IN ('head', 'title', 'meta', 'meta-number')")
    promoted = sheets.promoted(out.cells)
    assert body.where("sheet = '표1'").count() == promoted.count()
    assert body.where("style LIKE '%!'").count() == promoted.join(out.errors.select("doc_id", "row_idx", "col_idx").distinct(), ["doc_id", "row_idx", "col_idx"]).count()
    xlsx.register(spark)
    xlsx.arranged(plan).write.format("xlsx").mode("append").save(str(tmp_path / "out"))
    docs = {r["doc_id"] for r in flows.inputs(few).documents.collect()}
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{d}.xlsx" for d in docs)
    back = spark.read.format("xlsx").load(str(tmp_path / "out"))
    assert back.where("sheet = '결과'").count() == len(docs - {r["doc_id"] for r in out.cells.collect()})
    assert out.events.where("kind = 'keyword'").count() > 0
