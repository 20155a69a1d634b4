"""Plans of workbooks, the committing sink, the reader, and corrections found in changed files."""

import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.operators import sheets
from gridloom.sources import xlsx
from gridloom.streaming import outputs

PLAN = "doc_id string, sheet string, row int, col int, value string, number double, fmt string, style string"


def table(doc, names, rows, number=0):
    return [(doc, number, r, k, n, v) for r, line in enumerate(rows) for k, (n, v) in enumerate(zip(names, line))]


def cells(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, table_no int, row_idx int, col_idx int, col_name string, value string")


def planned(df, doc, sheet="표1"):
    return {(r["row"], r["col"]): (r["value"], r["number"], r["fmt"], r["style"]) for r in df.where((F.col("doc_id") == doc) & (F.col("sheet") == sheet)).collect()}


def test_plan_by_hand(spark):
    """Each line is a rule: what a cell of the table becomes in the sheet."""
    names = ["구분", "+30", "-100", "비고"]
    rows = [["매출액", "1,234", "12.5%", "x"], ["합계", "1234.50", "₩7", ""], ["비중(%)", "5%", "", "-"], ["[자산]", "0", "-5", "2024-01-05"], ["ㆍ현금", "1e3", "1d", "(5)"], ["2025년 12월", "", "", ""], ["1,000", "1,000", "1e30", " 9 "], ["구 분", "당기", "전기", "7"]]
    errors = spark.createDataFrame([("d", 1, 2), ("d", 6, 0)], "doc_id string, row_idx int, col_idx int")
    meta = spark.createDataFrame([("d", "수요예측 결과", [("발행", "A"), ("", "gone")], [("개별민평", "4.078"), ("국고", "n/a"), ("Spread", "5")])], "doc_id string, title string, info array<struct<label:string,value:string>>, market_info array<struct<label:string,value:string>>")
    documents = spark.createDataFrame([("d",), ("none",)], "doc_id string")
    plan = sheets.sheet_plan(cells(spark, table("d", names, rows) + table("d", ["a", "b"], [["p", "5"]], 1)), errors, meta, documents, "demand_forecast")
    found = planned(plan, "d")
    top = 1 + 3 + 1  # title, three lines, an empty one
    body, signed = "#,##0;[Red]\\-#,##0;\\-;", "\\+#,##0;\\-#,##0"
    want = {
        (0, 0): ("수요예측 결과", None, None, "title"), (1, 0): ("· 발행", None, None, "meta"), (1, 2): ("A", None, None, "meta"),
        (1, 4): ("· 개별민평", None, None, "meta"), (1, 6): ("4.078", 4.078, "0.000", "meta-number"), (2, 4): ("· 국고", None, None, "meta"), (2, 6): ("n/a", None, None, "meta"), (3, 4): ("· Spread", None, None, "meta"), (3, 6): ("5", 5.0, "0.000", "meta-number"),
        (top, 0): ("구분", None, None, "head"), (top, 1): ("+30", 30.0, signed, "head"), (top, 2): ("-100", -100.0, signed, "head"), (top, 3): ("비고", None, None, "head"),
        (top + 1, 0): ("매출액", None, None, "normal-first"), (top + 1, 1): ("1,234", 1234.0, body, "normal"), (top + 1, 2): ("12.5%", 0.125, "0.0%", "normal"), (top + 1, 3): ("x", None, None, "normal"),
        (top + 2, 0): ("합계", None, None, "subtotal-first"), (top + 2, 1): ("1234.50", 1234.5, "#,##0.00", "subtotal"), (top + 2, 2): ("₩7", 7.0, body, "subtotal!"), (top + 2, 3): ("", None, None, "subtotal"),
        (top + 3, 0): ("비중(%)", None, None, "summary-first"), (top + 3, 1): ("5%", 0.05, "0.0%", "summary"), (top + 3, 2): ("", None, None, "summary"), (top + 3, 3): ("-", None, None, "summary"),
        (top + 4, 0): ("[자산]", None, None, "category-first"), (top + 4, 1): ("0", 0.0, body, "category"), (top + 4, 2): ("-5", -5.0, body, "category"), (top + 4, 3): ("2024-01-05", None, None, "category"),
        (top + 5, 0): ("ㆍ현금", None, None, "detail-first"), (top + 5, 1): ("1e3", 1000.0, body, "detail"), (top + 5, 2): ("1d", None, None, "detail"), (top + 5, 3): ("(5)", None, None, "detail"),
        (top + 6, 0): ("2025년 12월", None, None, "period-first"), (top + 6, 1): ("", None, None, "period"), (top + 6, 2): ("", None, None, "period"), (top + 6, 3): ("", None, None, "period"),
        (top + 7, 0): ("1,000", None, None, "normal-first!"), (top + 7, 1): ("1,000", 1000.0, body, "normal"), (top + 7, 2): ("1e30", 1e30, body, "normal"), (top + 7, 3): ("9", 9.0, body, "normal"),
        (top + 8, 0): ("구 분", None, None, "header-first"), (top + 8, 1): ("당기", None, None, "header"), (top + 8, 2): ("전기", None, None, "header"), (top + 8, 3): ("7", 7.0, body, "header"),
    }
    assert found == want
    assert planned(plan, "d", "표2") == {(0, 0): ("a", None, None, "head"), (0, 1): ("b", None, None, "head"), (1, 0): ("p", None, None, "normal-first"), (1, 1): ("5", 5.0, body, "normal")}
    assert planned(plan, "none", "결과") == {(0, 0): ("추출된 표가 없습니다.", None, None, "normal-first")}


def test_headers_are_promoted(spark):
    raw = [["재무제표", "", ""], ["(단위: 원)", "", "Col_x"], ["구분", "", "제3기"], ["현금", "1", "2"], ["Col_1", "3", "4"], ["구분", "열2", "제3기"], ["열2", "제3기", "구분"], ["부채", "5", "6"]]
    found = sheets.promoted(cells(spark, table("d", ["Col_0", "Col_1", "Col_2"], raw) + table("e", ["구분", "b", "c"], [["구분", "x", "제1기"], ["c", "b", "구분"]]))).collect()
    d = {(r["place"], r["col_idx"]): (r["row_idx"], r["col_name"], r["value"]) for r in found if r["doc_id"] == "d"}
    assert [d[p, 0][0] for p in range(4)] == [0, 1, 3, 7] and len(d) == 12  # title rows stay, the header and three useless rows go
    assert [d[0, k][1] for k in range(3)] == ["구분", "열2", "제3기"]
    assert {(r["place"], r["row_idx"]) for r in found if r["doc_id"] == "e"} == {(0, 0)}  # no placeholder: nothing is promoted, a row of the names goes


def part(doc, rows=3):
    return [(doc, "표1", r, k, f"{doc} {r}", 1.5 if k else None, "#,##0.00" if k else None, "head" if r == 0 else None) for r in range(rows) for k in range(2)]


def test_retried_tasks_leave_one_file(spark, tmp_path):
    """A task fails after its first workbook and is run again; another runs twice to its end: each document has one file, nothing else is left."""
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame(part("a") + part("b"), PLAN).collect()
    writer = xlsx.Writer(folder, "default", False)

    def failing():
        yield from rows[:7]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    late = writer.write(iter(rows))  # its message never arrives
    kept = writer.write(iter(rows))
    assert not [f for f in os.listdir(folder) if f.endswith(".xlsx")] and late.files != kept.files
    writer.commit([kept, None])
    assert sorted(os.listdir(folder)) == ["a.xlsx", "b.xlsx"]
    other = xlsx.Writer(folder, "default", True)
    other.write(iter(rows))
    other.abort([None])
    assert sorted(os.listdir(folder)) == ["a.xlsx", "b.xlsx"]
    again = xlsx.Writer(folder, "default", True)
    again.commit([again.write(iter(rows[:6]))])
    assert sorted(os.listdir(folder)) == ["a.xlsx"]
    twice = xlsx.Writer(folder, "default", False)
    with pytest.raises(ValueError, match="several partitions"):
        twice.commit([twice.write(iter(rows[:3])), twice.write(iter(rows[3:6]))])
    assert sorted(os.listdir(folder)) == ["a.xlsx"]


def test_a_job_that_fails_changes_nothing(spark, tmp_path):
    xlsx.register(spark)
    folder = str(tmp_path / "out")
    write = lambda d, mode: xlsx.arranged(d).write.format("xlsx").mode(mode).save(folder)
    write(spark.createDataFrame(part("a") + part("b"), PLAN), "append")
    before = {f: open(os.path.join(folder, f), "rb").read() for f in os.listdir(folder)}
    bad = spark.createDataFrame(part("a", 5) + [(f"z{i}", "표1", 0, 0, "x", None, None, "no such style") for i in range(3)], PLAN)
    with pytest.raises(Exception, match="no such style"):
        write(bad, "overwrite")
    assert {f: open(os.path.join(folder, f), "rb").read() for f in os.listdir(folder)} == before
    write(spark.createDataFrame(part("c"), PLAN), "overwrite")
    assert os.listdir(folder) == ["c.xlsx"]


def test_round_trip(spark, tmp_path):
    xlsx.register(spark)
    folder = str(tmp_path / "out")
    raw = table("d/1", ["구분", "+30", "Col_2"], [["매출액", "1,234", "x < y & \"z\""], ["합계", "-0.5%", "\x01가나"], ["", "", "9007199254740993"]])
    plan = sheets.sheet_plan(cells(spark, raw + table("e", ["a"], [["1"]]) + table("e", ["b"], [["2"]], 1)), profile="demand_forecast")
    xlsx.arranged(plan).write.format("xlsx").mode("append").save(folder)
    found = spark.read.format("xlsx").option("filesPerTask", "1").load(folder).collect()
    want = {("d%2f1.xlsx" if r["doc_id"] == "d/1" else "e.xlsx", r["sheet"], r["row"], r["col"]): r for r in plan.where("coalesce(value, '') <> ''").collect()}
    got = {(os.path.basename(r["path"]), r["sheet"], r["row"], r["col"]): r for r in found}
    assert set(got) == set(want) and all(r["head"] == 0 for r in found)
    for k, r in got.items():
        assert r["number"] == want[k]["number"] and (r["number"] is not None or r["value"] == want[k]["value"].replace("\x01", ""))
    styles = zipfile.ZipFile(os.path.join(folder, "e.xlsx")).read("xl/styles.xml").decode()
    assert "FF002060" in styles and 'color rgb="FFFFFFFF"' in styles and "\\+#,##0;\\-#,##0" in styles and styles.count("<xf ") == len(xlsx.style_names()) * len(xlsx.FORMATS)
    assert spark.read.format("xlsx").load(str(tmp_path / "nowhere")).count() == 0


def test_reader_knows_other_writers(spark, tmp_path):
    """Shared strings, cells without names, booleans, formula values and rich text, as other programs write them."""
    xlsx.register(spark)
    path = str(tmp_path / "other.xlsx")
    ns = f'xmlns="{xlsx.MAIN}"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{xlsx.REL}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{xlsx.PACKAGE}/relationships"><Relationship Id="rId7" Type="t" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>")
        z.writestr("xl/worksheets/one.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c t="s"><v>1</v></c><c r="AB2" t="b"><v>1</v></c></row><row><c><f>1+1</f><v>2.5</v></c><c t="str"><v>text</v></c><c/></row></sheetData></worksheet>')
    found = {(r["row"], r["col"]): (r["value"], r["number"], r["head"]) for r in spark.read.format("xlsx").load(path).collect()}
    assert found == {(1, 1): ("plain", None, -1), (1, 2): ("rich text", None, -1), (1, 27): ("1", None, -1), (2, 0): ("2.5", 2.5, -1), (2, 1): ("text", None, -1)}


def edited(spark, folder, doc, changes, second):
    """Write a document's workbook again with some cells changed, as a person would, at a time of its own."""
    rows = [(doc, "표1", 0, k, n, None, None, "head") for k, n in enumerate(("회사명", "금액", "비고"))]
    rows += [(doc, "표1", r, k, *changes.get((r, k), (f"{doc}{r}{k}", None)), None, "normal") for r in (1, 2) for k in range(3)]
    xlsx.arranged(spark.createDataFrame(rows, PLAN)).write.format("xlsx").mode("append").save(folder)
    when = time.time() - 1000 + second
    os.utime(os.path.join(folder, f"{doc}.xlsx"), (when, when))


def test_corrections_are_found_once(spark, tmp_path):
    xlsx.register(spark)
    folder, state = str(tmp_path / "out"), str(tmp_path / "state")
    numbers = {(1, 1): ("1,234", 1234.0)}
    edited(spark, folder, "a", numbers, 1)
    edited(spark, folder, "b", {}, 1)
    outputs.register_outputs(spark, folder, state)
    query = outputs.poll(spark, folder, state, str(tmp_path / "checkpoint"), settle="0")
    found = lambda: sorted((os.path.basename(r["path"]), r["row"], r["col"], r["col_name"], r["original"], r["corrected"], r["kind"]) for r in outputs.events(spark, state).collect())
    query.processAllAvailable()
    assert found() == []  # what was registered has not changed
    edited(spark, folder, "a", {(1, 1): ("1234", 1234.0), (2, 0): ("삼성증권", None), (1, 2): ("", None)}, 20)  # another format, a correction, an emptied cell
    edited(spark, folder, "c", {}, 20)  # nobody has registered this one
    query.processAllAvailable()
    one = [("a.xlsx", 2, 0, "회사명", "a20", "삼성증권", "company")]
    assert found() == one
    query.processAllAvailable()
    assert found() == one
    query.stop()
    edited(spark, folder, "a", {(1, 1): ("1235", 1235.0), (2, 0): ("삼성증권", None)}, 40)  # while nobody looked
    query = outputs.poll(spark, folder, state, str(tmp_path / "checkpoint"), settle="0")
    query.processAllAvailable()
    assert found() == sorted([*one, ("a.xlsx", 1, 1, "금액", "1234", "1235", "number")])
    edited(spark, folder, "b", {(1, 1): ("5", 5.0)}, 60)  # converted again
    outputs.register_outputs(spark, folder, state)
    query.processAllAvailable()
    query.stop()
    assert len(found()) == 2
