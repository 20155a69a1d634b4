"""Truth tables, folds on random input, and the pieces without SQL."""

import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import cells as c
from gridloom.functions import pixels
from gridloom.operators import classify, entities, layout, learn, validate, votes
from gridloom.sources import recognise, xlsx
from gridloom.streaming import ingest


def values(spark, texts, *cols):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [tuple(r)[1:] for r in d.select("i", *cols).orderBy("i").collect()]


def test_cell_types(spark):
    table = [
        ("", "text", None, False), ("₩1,234", "currency", 1234.0, False), ("1234 원", "currency", 1234.0, False), ("₩,,", "currency", None, True), ("23.5%", "percent", 23.5, False), ("1,234%", "text", 1234.0, False),
        ("2024-01-15", "date", None, False), ("2024.1.5", "date", None, False), ("1,234.56", "number", 1234.56, False), ("-0.5", "number", -0.5, False), (".5", "text", 0.5, False), (",", "number", None, True), ("(1,234)", "text", None, False), ("1d", "text", None, False),
    ]
    v = F.col("v")
    got = values(spark, [t[0] for t in table], c.cell_type(v), c.parse_numeric(v), c.unparsable(v))
    assert got == [t[1:] for t in table]


def test_letters(spark):
    pairs = [("하", "아", 1), ("홍국증권", "흥국증권", 1), ("", "가", 2), ("각", "가", 1), ("ab", "ac", 1)]
    d = spark.createDataFrame(pairs, "a string, b string, n int")
    assert d.where(c.jamo_distance(F.col("a"), F.col("b")) != F.col("n")).count() == 0


def test_rows_and_repairs(spark):
    rows = {"구분": "header", "비중(%)": "summary", "자산총계": "subtotal", "[유동자산]": "category", "ㆍ현금": "detail", "2025년 12월말": "period", "매출액": "normal", "누적합계": "subtotal", "누적비중(%)": "summary"}
    assert [r[0] for r in values(spark, list(rows), c.row_type(F.col("v")))] == list(rows.values())
    assert values(spark, ['{"rows":[["a"],["b', "none"], c.repair_json(F.col("v"))) == [('{"rows":[["a"]]}',), ("none",)]
    assert values(spark, ["1O5l"], c.fix_digits(F.col("v"))) == [("1051",)]


def test_character_vote(spark):
    sets = [["abc", "abd", "xbc"], ["ab", "cde"], ["x", "x", "y"]]
    d = spark.createDataFrame([(k, i, s) for k, xs in enumerate(sets) for i, s in enumerate(xs)], "k int, pos int, value string")
    assert [r["value"] for r in votes.vote_characters(d, ["k"]).orderBy("k").collect()] == ["abc", "ab", "x"]


def test_folds(spark):
    rng = random.Random(1)
    data = {k: [rng.randint(0, 120) for _ in range(rng.randint(1, 15))] for k in range(40)}
    want = {}
    for k, xs in data.items():
        out = []
        for p in sorted(xs):
            if out and p - out[-1] <= 9:
                out[-1] = (out[-1] + p) // 2
            else:
                out.append(p)
        want[k] = out
    d = spark.createDataFrame([(k, p) for k, xs in data.items() for p in xs], "doc_id int, pos int")
    got = {}
    for r in layout.merge_close(d, 9).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append(r["pos"])
    assert got == want
    assert pixels.merge_close([1, 2, 3, 10], 3) == [2, 10]
    b = spark.createDataFrame([(1, i, float(y)) for i, y in enumerate((0, 10, 20, 30))], "doc_id int, box_id int, y_center double")
    assert [r["row_no"] for r in layout.rows_anchored(b, 15).orderBy("box_id").collect()] == [0, 0, 1, 1]
    assert [r["row_no"] for r in layout.rows_chained(b, 15).orderBy("box_id").collect()] == [0, 0, 0, 0]
    e = spark.createDataFrame([("t", i, p) for i, p in enumerate((4, 7, 0))], "k string, seq int, position int")
    assert learn.column_positions(e, ["k"]).first()["position"] == 2
    g = spark.createDataFrame([(1, float(p)) for p in (1, 2, 10, 11, 30)], "doc_id int, pos double")
    assert sorted(r["center"] for r in layout.gap_clusters(g, 3).collect()) == [1.5, 10.5, 30.0]


def totals(spark, rows):
    heads = ["회사명", "부서명", "이름", "계정", "일시", "총참여금액", "-100", "-66", "-60", "-56", "-50", "-46", "-40", "-30", "-20", "-10", "0", "+10", "+20", "+30"]
    data = [(1, r, k, heads[k], cells.get(k, "")) for r, cells in enumerate(rows) for k in range(20)]
    return sorted(tuple(r)[1:3] for r in validate.control_totals(spark.createDataFrame(data, "doc_id int, row_idx int, col_idx int, col_name string, value string")).collect())


def test_control_totals(spark):
    fixed = [{5: "20", 6: "20"}, {5: "50", 10: "50"}, {0: "합계", 5: "530", 6: "20", 10: "50", 12: "30", 13: "50", 14: "30", 15: "40", 16: "180", 17: "80"}]
    assert totals(spark, fixed) == [(2, k) for k in range(12, 18)]
    assert totals(spark, [{5: "0", 6: "20"}, {0: "합계", 6: "20"}]) == []
    assert totals(spark, [{5: "30", 6: "20"}, {0: "합계", 6: "20"}]) == [(0, 6)]
    assert totals(spark, [{5: "90", 6: "20", 7: "30"}, {0: "합계", 6: "20", 7: "30"}]) == [(0, 6), (0, 7)]
    assert totals(spark, fixed[:2]) == []


def test_hamming_bands(spark):
    rng = random.Random(4)
    h = [rng.getrandbits(64) for _ in range(60)]
    h += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in h[:20]]
    d = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(h)], "id long, h long")
    got = {r["id"]: (r["nearest"], r["distance"]) for r in entities.hamming_neighbours(d, 5).collect()}
    for i, x in enumerate(h):
        near = min(((x ^ y).bit_count(), j) for j, y in enumerate(h) if j != i)
        assert got.get(i) == ((near[1], near[0]) if near[0] <= 5 else None)


def test_evaluation(spark):
    s = "case string, row_idx int, label string, a string, b string, c string"
    want = spark.createDataFrame([("x", i, k, "1", "2", "3") for i, k in enumerate("ABC")], s)
    have = spark.createDataFrame([("x", 0, "A", "1", "2", "3"), ("x", 1, "B", "1", "2", "9"), ("x", 2, "B", "1", "2", "3")], s)
    assert tuple(validate.evaluate(want, have, ["label", "a", "b", "c"]).first())[1:] == (0.6667, 0.3333, 0.5833)


def test_ngrams(spark):
    got = values(spark, ["Ab  c"], F.array_sort(classify.char_ngrams(F.col("v"), 2, 3)))
    assert Counter(got[0][0]) == Counter([" a", "ab", "b ", " ab", "ab ", " c", "c ", " c "])


def ruled():
    image = np.full((120, 300, 3), 255.0)
    for y in (10, 50, 90):
        image[y : y + 2, 10:290] = 0
    for x in (10, 100, 200, 288):
        image[10:92, x : x + 2] = 0
    image[20:40, 120:160] = 0
    return image


def test_pixels():
    image = ruled()
    cells = pixels.table_cells(image)
    assert len(cells) == 6 and (cells[1]["row"], cells[1]["col"]) == (0, 1)
    assert [pixels.occupied(image, x) for x in cells] == [False, True, False, False, False, False]
    h = pixels.perceptual_hash(image)
    assert (h ^ pixels.perceptual_hash(image * 0.9)).bit_count() <= 4
    assert pixels.is_screenshot(image) and len(pixels.split_wide(np.zeros((4, 2000)))) == 2
    assert pixels.header_kind(image[..., None].repeat(3, 2), []) == "default"
    one = [{"row": 0, "col": 0, "x_min": 0, "x_max": 20, "y_min": 0, "y_max": 20}]
    for colour, kind in (((96, 32, 0), "demand_forecast"), ((243, 226, 217), "financial_statement"), ((255, 255, 120), "default")):
        assert pixels.header_kind(np.full((20, 20, 3), colour, np.uint8), one) == kind
    assert pixels.table_cells(image[:52]) == []  # one row of cells is no table
    thin = np.full((100, 300), 200, np.uint8)
    thin[:, 10:290:40] = 170
    assert len(pixels.column_boundaries(thin)) == 7


def test_merge_close_is_a_fold():
    rng = random.Random(2)
    for _ in range(200):
        places, limit = sorted(rng.sample(range(60), rng.randint(0, 12))), rng.choice([1, 3, 5.5])
        want = []
        for q in places:
            if want and q - want[-1] <= limit:
                want[-1] = (want[-1] + q) // 2
            else:
                want.append(q)
        assert pixels.merge_close(places, limit) == want


def test_pictures_are_prepared():
    flat = np.full((40, 60, 3), 90, np.uint8)
    big = pixels.upscaled(flat, 100)
    assert big.shape == (120, 180, 3) and (big == 90).all() and pixels.upscaled(big, 100) is big
    ramp = np.tile(np.linspace(20, 235, 64), (64, 1)).astype(np.uint8)
    assert abs(pixels.upscaled(ramp, 128)[:, ::3].astype(float) - np.repeat(ramp, 3, 0)[:, :]).mean() < 3
    assert pixels.otsu(np.array([[10] * 20 + [200] * 30], np.uint8)) in range(10, 200)
    page = np.full((64, 64), 150, np.uint8)  # faint, so it is taken for a scan
    page[20:44, 20:44] = 130
    out = pixels.prepared(page, 64)
    assert set(np.unique(out)) <= {0, 255} and out[30, 30] == 0
    assert pixels.prepared(ruled(), 100).shape == ruled().shape[:2]
    dark = pixels.crop(np.full((10, 10, 3), 20, np.uint8), {"x_min": 2, "x_max": 8, "y_min": 2, "y_max": 8})
    assert dark.shape == (8, 8, 3) and (dark == 235).all()


def test_images(spark):
    from gridloom.operators import images

    bgr = ruled().astype(np.uint8)
    image = bgr[..., 0]
    rows = [(1, *image.shape, 1, image.tobytes()), (2, *bgr.shape, bgr.tobytes()), (3, 30, 30, 1, bytes(900))]
    df = spark.createDataFrame([(d, h, w, c, bytearray(b)) for d, h, w, c, b in rows], "doc_id long, height int, width int, channels int, pixels binary")
    grid = images.grids(df).collect()
    assert len(grid) == 12 and [r["filled"] for r in grid if r["doc_id"] == 2] == [False, True, False, False, False, False]
    assert {(r["doc_id"], r["high"], r["wide"], r["kind"]) for r in images.facts(df).collect()} == {(1, *image.shape, "default"), (2, *image.shape, "financial_statement"), (3, 30, 30, "default")}
    assert images.crops(df, 0).where("doc_id = 1").count() == 3
    assert images.columns(df).count() == 0
    assert {r["doc_id"]: r["high"] for r in images.prepared(df, 100).collect()} == {1: image.shape[0], 2: image.shape[0], 3: 120}
    assert images.grids(df.limit(0)).count() == 0


def test_recogniser(spark, tmp_path):
    class Fake:
        def boxes(self, content, kind):
            yield 1, f"{kind} {len(content)}", 0.9, 0.0, 10.0, 0.0, 4.0
            yield 1, "faint", 0.1, 0.0, 1.0, 0.0, 1.0

    for name in ("a.png", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"x" * 7)
    found = recognise.files(spark, str(tmp_path))
    boxes = recognise.recognise(found, Fake).collect()
    assert sorted(b["text"] for b in boxes) == ["image 7", "pdf 7"]
    assert recognise.misses(found, found.limit(0)).count() == 2 and recognise.misses(found, found).count() == 0


def test_xlsx(spark, tmp_path):
    rows = [(d, "표1", r, k, f"v<{r}>", 1.5 if k else None, "#,##0.00" if k else None, "header" if r == 0 else None) for d in ("one", "two") for r in range(3) for k in range(2)]
    xlsx.register(spark)
    plan = spark.createDataFrame(rows, "doc_id string, sheet string, row int, col int, value string, number double, fmt string, style string")
    xlsx.arranged(plan).write.format("xlsx").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.xlsx", "two.xlsx"]
    with zipfile.ZipFile(tmp_path / "out" / "one.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "v&lt;0&gt;" in sheet and "<v>1.5</v>" in sheet and 'ySplit="1"' in sheet
    assert xlsx.column_name(27) == "AB" and '<col min="1" max="1" width="30" customWidth="1"/>' in sheet
    odd = [(d, 'a"b', 0, 0, d, float("nan"), None, None) for d in ("a/b", "a_b", "a%2fb")]
    plan = spark.createDataFrame(odd, plan.schema)
    xlsx.arranged(plan).write.format("xlsx").mode("overwrite").option("profile", "demand_forecast").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a%252fb.xlsx", "a%2fb.xlsx", "a_b.xlsx"]
    with zipfile.ZipFile(tmp_path / "out" / "a_b.xlsx") as z:
        assert 'name=\'a"b\'' in z.read("xl/workbook.xml").decode() and ">a_b<" in z.read("xl/worksheets/sheet1.xml").decode() and "FF002060" in z.read("xl/styles.xml").decode()


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").write.mode("append").parquet(source)
    run = lambda: ingest.ingest(spark, source, "k string, n int", lambda b: b, str(tmp_path / "events"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("a", 5)], "k string, n int").write.mode("append").parquet(source)
    run()
    got = ingest.state(spark, str(tmp_path / "events"), lambda e: e.groupBy("k").agg(F.sum("n").alias("n")))
    assert {r["k"]: r["n"] for r in got.collect()} == {"a": 6, "b": 2}


@pytest.mark.parametrize("parts", [1, 7])
def test_order_does_not_matter(spark, parts):
    d = spark.createDataFrame([(1, i % 3, i, "abc"[i % 2]) for i in range(30)], "doc_id int, cell int, pos int, value string").repartition(parts)
    assert sorted(tuple(r) for r in votes.vote(d, ["cell"]).collect()) == [(0, "a", 5, 10, False), (1, "b", 5, 10, False), (2, "a", 5, 10, False)]


def test_classifier_on_unseen_documents(spark):
    from gridloom.plans.queries import QUERIES

    rows = QUERIES["classifier_model"](spark, "/root/testdata/sf0.001").where("NOT learned").collect()
    assert len(rows) > 30 and sum(r["label"] == r["predicted"] for r in rows) >= 0.9 * len(rows)
    assert all(0 < r["confidence"] <= 1 for r in rows)
