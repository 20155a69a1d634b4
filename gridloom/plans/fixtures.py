"""Inputs derived from the plain tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Rows by document that fixtures are made of, by the name of their view: their SQL (for Spark, and as it is written), the table that they are made from, and its column that tells the document.
DEALT: dict[str, tuple[str, str, str, str]] = {}
#: Size of that table's files for each part that its rows are dealt to, so that the cells of a part fit into a task.
PART_BYTES = 1 << 19
#: Size of a query's largest table for each partition that its shuffles start with, and the setting that says so: with a fixed number, memory of a task would grow with the tables.
SHUFFLE_BYTES, PARTITIONS = 1 << 22, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def dealt(name: str, sql: str, table: str = "lineitem", key: str = "l_orderkey", once: str | None = None) -> str:
    """``sql`` as it is; where it stands in parentheses in a fixture, or is one, it reads its table dealt by ``key``: the table is moved once, and the cells that they become are not moved to their document again; rows begin with it.

    What a union gives lies by no key, and to deal it once more takes a block for each pair of parts, whose number grows with the square of the table.
    So the rows of a union are given a second time, as Spark makes them ``once`` from one reading of the table.
    """
    DEALT[name] = (once or sql, sql, table, key)
    return sql


ALL_LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: Cells of many kinds.
VALUES = """SELECT o_orderkey AS doc_id, o_custkey AS cust, CASE o_orderkey % 14
 WHEN 0 THEN '₩' || CAST(o_custkey AS STRING) WHEN 1 THEN CAST(o_custkey AS STRING) || ' 원' WHEN 2 THEN CAST(o_custkey % 100 AS STRING) || '.5%'
 WHEN 3 THEN '2024-01-' || CAST(1 + o_custkey % 28 AS STRING) WHEN 4 THEN CAST(o_custkey AS STRING) || ',000' WHEN 5 THEN ',' WHEN 6 THEN '  '
 WHEN 7 THEN o_orderpriority WHEN 8 THEN ' -0.' || CAST(o_custkey AS STRING) || ' ' WHEN 9 THEN '(' || CAST(o_custkey AS STRING) || ')' WHEN 10 THEN '₩,,'
 WHEN 11 THEN '1,234%' WHEN 12 THEN '1O5l' ELSE '.5' END AS value FROM orders"""

#: Header texts.
HEADS = """SELECT o_orderkey AS doc_id, CAST(o_custkey % 12 AS INT) AS col_idx, CASE o_orderkey % 16
 WHEN 0 THEN 'Col_' || CAST(o_custkey % 9 AS STRING) WHEN 1 THEN '-' || CAST(o_custkey AS STRING) WHEN 2 THEN '민평(+' || CAST(o_custkey AS STRING) || ')' WHEN 3 THEN '총참여금액'
 WHEN 4 THEN '회사명' WHEN 5 THEN '부서명' WHEN 6 THEN '이름' WHEN 7 THEN '계정' WHEN 8 THEN '최종참여일시' WHEN 9 THEN '합계' WHEN 10 THEN '+0.5%'
 WHEN 11 THEN '참여일' WHEN 12 THEN '운용팀' WHEN 13 THEN '기관' WHEN 14 THEN 'x(y)' ELSE o_orderpriority END AS header FROM orders"""

#: First cells of rows.
FIRSTS = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 13
 WHEN 0 THEN '구 분' WHEN 1 THEN '비중(%)' WHEN 2 THEN '자산총계' WHEN 3 THEN '[유동자산]' WHEN 4 THEN 'ㆍ현금' WHEN 5 THEN '2025년 12월말' WHEN 6 THEN '매출액'
 WHEN 7 THEN '누적합계' WHEN 8 THEN '누적비중(%)' WHEN 9 THEN '-상여' WHEN 10 THEN '' WHEN 11 THEN ' 소계 ' ELSE o_orderpriority END AS value FROM orders"""

#: One table per order: a label, five identity columns with the total last, three spread columns, and a sum row.
_LINE = dealt("order_lines", f"""SELECT l_orderkey AS d, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ALL_LINE}) - 1 AS INT) AS r,
 CAST(l_quantity AS BIGINT) AS a, CAST(floor(l_discount * 1000 + 0.5) AS BIGINT) AS b, CAST(floor(l_tax * 1000 + 0.5) AS BIGINT) AS c FROM lineitem""")
_SUMS = dealt("order_sums", """SELECT l_orderkey AS d, CAST(count(*) AS INT) AS r, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS a, CAST(sum(CAST(floor(l_discount * 1000 + 0.5) AS BIGINT)) AS BIGINT) AS b,
 CAST(sum(CAST(floor(l_tax * 1000 + 0.5) AS BIGINT)) AS BIGINT) AS c FROM lineitem GROUP BY l_orderkey""")
_NUM = lambda e: f"CASE WHEN {e} >= 1000 THEN CAST(CAST(floor({e} / 1000) AS BIGINT) AS STRING) || ',' || substr(CAST(1000 + {e} % 1000 AS STRING), 2) ELSE CAST({e} AS STRING) END"
_WRONG = "d % 7 = 0 AND r = 0 AND kind = 'line'"
CELLS = f"""SELECT d AS doc_id, r AS row_idx, k AS col_idx, CASE k WHEN 0 THEN '회사명' WHEN 5 THEN '총참여금액' WHEN 6 THEN '-100' WHEN 7 THEN '-66' ELSE 'Col_8' END AS col_name,
 CASE k WHEN 0 THEN CASE WHEN kind = 'sum' THEN '합계' ELSE 'name ' || CAST(r AS STRING) END WHEN 5 THEN {_NUM('(a + b + c)')} WHEN 6 THEN {_NUM('a')} WHEN 7 THEN {_NUM(f"(b + CASE WHEN {_WRONG} THEN 1 ELSE 0 END)")}
 ELSE CASE WHEN kind = 'line' AND c = 0 THEN '' ELSE {_NUM("(c + CASE WHEN kind = 'sum' AND d % 11 = 0 THEN 5 ELSE 0 END)")} END END AS value
 FROM (SELECT d, r, a, b, c, 'line' AS kind FROM ({_LINE}) x0 UNION ALL SELECT d, r, a, b, c, 'sum' FROM ({_SUMS}) y0) q CROSS JOIN (VALUES (0), (5), (6), (7), (8)) AS v(k)"""

#: Text boxes, one document per order.
_PLACED = dealt("order_boxes", f"""
 SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ALL_LINE}) - 1 AS INT) AS box_id, l_returnflag || l_linestatus AS text, CAST(0.5 + l_discount AS DOUBLE) AS confidence,
 CAST(100 * l_linenumber + l_quantity AS DOUBLE) AS x_center, CAST(l_partkey % 200 AS DOUBLE) AS y_center, CAST(10 + l_suppkey % 30 AS DOUBLE) AS w FROM lineitem""")
BOXES = f"SELECT doc_id, box_id, text, confidence, x_center, y_center, x_center - w AS x_min, x_center + w AS x_max, y_center - 9 AS y_min, y_center + 9 AS y_max FROM ({_PLACED}) q"

#: Five by eight cells for each document, with gaps between rows.
_DOCS = dealt("order_docs", "SELECT DISTINCT l_orderkey AS doc_id FROM lineitem")
GRID = f"""SELECT d.doc_id, g_r, g_c, CAST(100 * g_c AS DOUBLE) AS gx_min, CAST(100 * g_c + 95 AS DOUBLE) AS gx_max, CAST(40 * g_r AS DOUBLE) AS gy_min, CAST(40 * g_r + 30 + g_c AS DOUBLE) AS gy_max
 FROM ({_DOCS}) d CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS a(g_r) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS b(g_c)"""

#: Raw cells with holes: row 0 is the header, some rows and columns are empty.
RAW = f"""SELECT d AS doc_id, r AS row_idx, k AS col_idx, CASE WHEN k = 3 THEN '' WHEN r % 3 = 2 THEN '' WHEN r = 0 AND k = 1 THEN '' WHEN d % 5 = 0 AND r = 1 AND k = 0 THEN '구분' WHEN k = 0 THEN 'n' || CAST(a AS STRING) WHEN k = 1 THEN CAST(b AS STRING) ELSE CAST(c AS STRING) END AS value
 FROM ({_LINE}) q CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)"""

#: Repeated extraction runs: a cell per user, a candidate per event.
RUNS = "SELECT user_id AS cell, event_id AS pos, CASE WHEN event_id % 5 = 0 THEN upper(event_type) ELSE event_type END AS value FROM events"

#: A dictionary of names, and misread names.
ENTITIES = "SELECT p_name AS canonical_name, CAST(count(*) AS BIGINT) AS frequency FROM part GROUP BY p_name"
VARIANTS = "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN p_name || 'x' ELSE 'q' || substr(p_name, 3) END AS value FROM part"
VARIANT_LOG = "SELECT substr(p_name, 2) AS variant_text, p_name AS canonical_name, CAST(count(*) AS BIGINT) AS occurrence_count FROM part WHERE p_partkey % 2 = 1 GROUP BY p_name"

#: 64-bit hashes of vectors are made by the query itself; events as a log of learned things.
LOG = "SELECT event_id AS seq, event_type AS doc_type, 'k' || CAST(user_id % 50 AS STRING) AS name, CAST(event_id % 17 AS INT) AS position, CAST(floor(value * 100) AS BIGINT) AS amount, CAST(event_id % 3 + 1 AS DOUBLE) AS weight, CAST((event_id % 10) / 10.0 AS DOUBLE) AS confidence FROM events"


def parts(spark: SparkSession, path: str, part_bytes: int | None = None) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (part_bytes or PART_BYTES)))


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture, with the tables that it names read from a folder."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            spark.conf.set(PARTITIONS, max(int(spark.conf.get(PARTITIONS, "1")), parts(spark, f"{sf_dir}/{t}.parquet", SHUFFLE_BYTES)))
    for name, (made, rows, table, key) in reversed(DEALT.items()):  # later ones may be made of earlier ones
        if rows == sql or f"({rows})" in sql:
            by_key, n = f"{table}_by_{key}", parts(spark, f"{sf_dir}/{table}.parquet")
            spark.table(table).repartition(n, key).createOrReplaceTempView(by_key)
            spark.sql(re.sub(rf"\b{table}\b", by_key, made)).createOrReplaceTempView(name)
            sql = f"SELECT * FROM {name}" if rows == sql else sql.replace(f"({rows})", name)
    return spark.sql(sql)
