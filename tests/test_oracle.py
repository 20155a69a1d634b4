"""Every table query against its SQL at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from gridloom.plans import flows  # noqa: F401  registers queries
from gridloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), sorted(names)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = table([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        assert found == table(cur.fetchall(), [d[0] for d in cur.description])
    assert found[0] or name in ("template_match",)


def test_no_python_in_plans(spark):
    for name in ORACLE_SQL:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name
