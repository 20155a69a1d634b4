"""Table functions in SQL and the stored index of image hashes."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import layout, nearindex
from gridloom.plans import fixtures
from gridloom.sources import tabular

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def boxes(spark):
    tabular.register(spark)
    found = fixtures.frame(spark, SF, fixtures.BOXES)
    found.createOrReplaceTempView("some_boxes")
    return found


@pytest.mark.parametrize("tolerance", [0.5, 20.0, 75.0])
def test_rows_of_boxes_from_sql(spark, boxes, tolerance):
    found = spark.sql(f"SELECT doc_id, box_id, row_no FROM box_rows(TABLE(some_boxes) PARTITION BY doc_id ORDER BY (y_center, box_id), {tolerance}D)")
    want = layout.rows_chained(boxes, tolerance).select("doc_id", "box_id", "row_no")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    lateral = spark.sql(f"SELECT doc_id, max(row_no) + 1 AS n FROM box_rows(TABLE(some_boxes) PARTITION BY doc_id ORDER BY (y_center, box_id), {tolerance}D) GROUP BY doc_id HAVING n > 2")
    assert lateral.count() == want.groupBy("doc_id").agg(F.max("row_no").alias("n")).where("n >= 2").count()


def test_cells_of_rows_from_sql(spark, boxes):
    layout.rows_chained(boxes, 20.0).createOrReplaceTempView("some_rows")
    found = spark.sql("SELECT * FROM row_cells(TABLE(some_rows) PARTITION BY doc_id ORDER BY (row_no, x_center, box_id))")
    rows: dict = {}
    for r in sorted(spark.table("some_rows").collect(), key=lambda r: (r["doc_id"], r["row_no"], r["x_center"], r["box_id"])):
        rows.setdefault(r["doc_id"], {}).setdefault(r["row_no"], []).append(r["text"])
    want = [(d, n - 1, k, name, lines[n][k] if k < len(lines[n]) else "") for d, lines in rows.items() for n in lines if n for k, name in enumerate(lines[0])]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_table_functions_say_what_is_wrong(spark, boxes):
    for call, what in (("TABLE(SELECT 1 AS doc_id) PARTITION BY (doc_id), 5D", "box_id"), ("TABLE(some_boxes) PARTITION BY (doc_id), -1D", "negative"), ("5, 5D", "TABLE argument")):
        with pytest.raises(Exception, match=what):
            spark.sql(f"SELECT * FROM box_rows({call})").collect()


def hashes(rng, n, near=()):
    out = [rng.getrandbits(64) for _ in range(n)]
    for h in (x & ((1 << 64) - 1) for x in near):
        for _ in range(rng.randrange(8)):
            h ^= 1 << rng.randrange(64)
        out.append(h)
    return [h - (1 << 64) if h >> 63 else h for h in out]


def test_near_index_persists_and_moves_the_batch_only(spark, tmp_path):
    rng = random.Random(5)
    folder = str(tmp_path / "near")
    index = nearindex.NearIndex(spark, folder, most=5, buckets=4)
    first = hashes(rng, 300)
    one = [(h, f"a{i:03d}", i % 3 > 0) for i, h in enumerate(first)]
    index.add(spark.createDataFrame(one, "h long, key string, verified boolean"))
    index.save()
    again = nearindex.NearIndex.load(spark, folder)  # in another session
    two = [(h, f"b{i:03d}", True) for i, h in enumerate(hashes(rng, 50, first[:40]))] + [(one[0][0], "a000", True)]  # confirmed later
    again.add(spark.createDataFrame(two, "h long, key string, verified boolean"))
    batch = list(enumerate(hashes(rng, 20, [h for h, _, _ in one[:120]])))
    asked = spark.createDataFrame(batch, "id long, h long")

    def plain(entries):
        out = {}
        for i, q in batch:
            near = [(((q ^ h) & ((1 << 64) - 1)).bit_count(), k) for h, k, v in entries if v]
            near = [x for x in near if x[0] <= 5]
            if near:
                out[i] = (min(near)[1], min(near)[0])
        return out

    found = lambda index, **how: {r["id"]: (r["key"], r["distance"]) for r in index.lookup(asked, **how).collect()}
    assert found(again) == plain(one + two) and len(plain(one + two)) > 30
    assert found(again, verified=False) == plain([(h, k, True) for h, k, _ in one + two])
    plan = again.lookup(asked)._jdf.queryExecution().executedPlan().toString()
    stored = [part.split("\n")[0:6] for part in plan.split("SortMergeJoin")[1:]]
    assert plan.count("SelectedBucketsCount: 4 out of 4") == 2 and stored and "Exchange hashpartitioning(k" in plan
    for line, below in zip(plan.splitlines(), plan.splitlines()[1:]):
        assert not ("Exchange" in line and "gridloom_near" in below)
    again.compact()
    assert len(again.runs) == 1 and found(nearindex.NearIndex.load(spark, folder)) == plain(one + two)
    empty = nearindex.NearIndex(spark, str(tmp_path / "empty"))
    empty.save()
    assert nearindex.NearIndex.load(spark, str(tmp_path / "empty")).lookup(asked).count() == 0
    again._forget(again.runs)
