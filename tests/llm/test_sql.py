"""Substring and window removal against their SQL, over planted texts."""

import random

import duckdb
import pytest

from gridloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Shared passages inside and across documents, runs that touch, one byte repeated, multibyte letters, empty and null texts."""
    r = random.Random(1)
    a = " ".join(r.choice("abcdé") * r.randint(1, 6) for _ in range(200))
    b = " ".join(str(r.random()) for _ in range(80))
    texts = [a, None, "", "x" * 900, a[:500] + " mid " + a[300:], "   ", a[100:700], "q w e " * 90, b, b[:400] + a[:400] + b[400:], b[:399] + "!" + b[401:]]
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op9_window_index"])
def test_sql(spark, folder, name):
    found = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    assert [d[0] for d in cur.description] == found.columns
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(cur.fetchall())
    assert 0 < sum(r[2] for r in rows) < sum(r[1] for r in rows)
