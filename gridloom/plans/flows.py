"""Queries of what spans several operators: tiers, workbooks, changed outputs, the chain from boxes to sheets; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as c
from ..operators import conversion, learning, sheets, tables
from ..operators.shared import new_folder
from ..sources import tiers
from ..streaming import outputs
from . import fixtures as x
from .queries import ORACLE_SQL, PARSED, TYPE, query
from .rules import HEIGHTS, KNOWN, KNOWN_VARIANTS, NAMED_BOXES, NUMBER, RAW, TOTAL, _FIX

# -- where spread columns begin ----------------------------------------------------------------------

#: Six columns for each order, with names of every kind that the rule tells apart.
NAMED = """
SELECT o_orderkey AS doc_id, 0 AS row_idx, CAST(k AS INT) AS col_idx, 'v' AS value,
  CASE (o_orderkey * 7 + o_custkey * 3 + k * k) % 23
    WHEN 0 THEN '-100' WHEN 1 THEN '4.078% (-50)' WHEN 2 THEN '총참여금액' WHEN 3 THEN ' +66.5% ' WHEN 4 THEN '5(a)' WHEN 5 THEN '참여금액 계' WHEN 6 THEN 'x (+3) y' WHEN 7 THEN '(7)b)'
    WHEN 8 THEN '1,000' WHEN 9 THEN '()' ELSE 'Col_' || CAST(k AS STRING) END AS col_name
FROM orders CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(k)"""

query("spread_start", NAMED, f"""
SELECT doc_id,
  coalesce(min(CASE WHEN {NUMBER('col_name')} THEN col_idx END), min(CASE WHEN {TOTAL.replace('header', 'col_name')} THEN col_idx END) + 1) AS start_col,
  max(col_idx) + 1 AS columns
FROM t GROUP BY doc_id""")(tables.spread_start)

# -- tiers of recognition ----------------------------------------------------------------------------

WAITING = "SELECT event_id AS doc_id, event_type AS account, user_id AS seq, CAST(1 + event_id % 3 AS INT) AS calls FROM events"
ACCOUNTS = "SELECT event_type AS account, CAST(floor(count(*) / 2) AS BIGINT) - 7 AS left FROM events GROUP BY event_type"

query("tier_allotment", None, f"""
WITH w AS ({WAITING}),
a AS (SELECT event_type AS account, count(*) // 2 - 7 AS quota FROM events GROUP BY event_type),
s AS (SELECT *, sum(calls) OVER (PARTITION BY account ORDER BY seq, doc_id) AS total FROM w)
SELECT doc_id, account, calls FROM s JOIN a USING (account) WHERE total <= quota""")(
    lambda get: tiers.allotted(get(WAITING), get(ACCOUNTS), ["seq", "doc_id"], key=["account"]).select("doc_id", "account", "calls")
)

ATTEMPTS = """
SELECT CAST(l_orderkey AS STRING) AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'last' WHEN 1 THEN 'local' ELSE 'cloud' END AS tier,
  l_returnflag <> 'A' AS ok, CAST(l_discount * 10 AS DOUBLE) AS confidence, l_linestatus || CAST(l_partkey AS STRING) AS answer
FROM lineitem"""
TERMS = "SELECT 'local' AS tier, 0 AS rank, CAST(0.8 AS DOUBLE) AS least UNION ALL SELECT 'cloud', 1, CAST(0.5 AS DOUBLE) UNION ALL SELECT 'last', 2, CAST(0.95 AS DOUBLE)"

query("tier_choice", None, f"""
WITH a AS ({ATTEMPTS}), n AS ({TERMS}),
r AS (
  SELECT doc_id, tier, confidence, answer, row_number() OVER (
    PARTITION BY doc_id ORDER BY confidence < least, CASE WHEN confidence >= least THEN 0 ELSE -confidence END, rank, tier, confidence, answer) AS place
  FROM a JOIN n USING (tier) WHERE ok)
SELECT doc_id, tier, confidence, answer FROM r WHERE place = 1""")(lambda get: tiers.chosen(get(ATTEMPTS), get(TERMS)))

# -- workbooks ---------------------------------------------------------------------------------------

#: Tables with placeholders for names: a title, a header where there is one, lines, a repeated header and a line of placeholders.
_LINES = f"SELECT d, r + 3 AS r, a, b, 'line' AS kind FROM ({x._LINE}) l"
_EXTRAS = ((0, "title", "true"), (1, "head", "l_orderkey % 3 > 0"), (2, "waste", "l_orderkey % 2 = 0"), (99, "again", "l_orderkey % 5 < 2"))
_EXTRA = " UNION ALL ".join(f"SELECT DISTINCT l_orderkey, {r}, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '{kind}' FROM lineitem WHERE {when}" for r, kind, when in _EXTRAS)
_ROW = "array(named_struct('r', {0}, 'a', {1}, 'b', {1}, 'kind', '{2}'))"
#: The same with what a document has besides its lines beside the first of them.
_ONCE = f"""SELECT d, inline(rows) FROM (SELECT d, CASE WHEN r = 0 THEN concat(array(named_struct('r', r + 3, 'a', a, 'b', b, 'kind', 'line')), {", ".join(f"CASE WHEN {when.replace('l_orderkey', 'd')} THEN {_ROW.format(r, '0L', kind)} ELSE array() END" for r, kind, when in _EXTRAS)})
 ELSE array(named_struct('r', r + 3, 'a', a, 'b', b, 'kind', 'line')) END AS rows FROM ({x._LINE}) l) q"""
_PLACED = x.dealt("placed_rows", f"{_LINES} UNION ALL {_EXTRA}", once=_ONCE)
SHEETS = f"""
SELECT d AS doc_id, CAST(r AS INT) AS row_idx, CAST(k AS INT) AS col_idx,
  CASE WHEN d % 4 = 0 THEN CASE k WHEN 0 THEN '구분' WHEN 1 THEN '+30' WHEN 2 THEN '-1+00' ELSE '비고' END ELSE 'Col_' || CAST(k AS STRING) END AS col_name,
  CASE kind
    WHEN 'title' THEN CASE WHEN k = 0 THEN '재무제표' ELSE '' END
    WHEN 'head' THEN CASE k WHEN 0 THEN '구 분' WHEN 1 THEN '' WHEN 2 THEN '제' || CAST(d % 9 AS STRING) || '기' ELSE '+50' END
    WHEN 'again' THEN CASE k WHEN 0 THEN '구 분' WHEN 1 THEN '열2' WHEN 2 THEN '제' || CAST(d % 9 AS STRING) || '기' ELSE '+50' END
    WHEN 'waste' THEN CASE WHEN k = 2 THEN 'Col_2x' ELSE 'w' END
    ELSE CASE k
      WHEN 0 THEN CASE CAST(a AS INT) % 8 WHEN 0 THEN '합계' WHEN 1 THEN '비중(%)' WHEN 2 THEN '[자산]' WHEN 3 THEN 'ㆍ현금' WHEN 4 THEN '2025년 12월' WHEN 5 THEN '' WHEN 6 THEN '1,000' ELSE '매출액' END
      WHEN 1 THEN CASE CAST(b AS INT) % 4 WHEN 0 THEN CAST(a AS STRING) || ',000' WHEN 1 THEN CAST(b AS STRING) || '.5%' WHEN 2 THEN '₩' || CAST(a AS STRING) ELSE ' -' || CAST(a AS STRING) || '.25 ' END
      WHEN 2 THEN CASE WHEN a % 3 = 0 THEN '' ELSE CAST(b AS STRING) END
      ELSE CASE WHEN b % 7 = 0 THEN '1e30' ELSE 'note' END END END AS value
FROM ({_PLACED}) q CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)"""
ERRORS = f"SELECT doc_id, row_idx, col_idx FROM ({SHEETS}) e WHERE (row_idx + col_idx) % 5 = 3"
#: Labels and values above a table; every seventh document has none.
META = """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE '수요예측 ' || o_orderpriority END AS title, o_orderstatus AS a, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '만기' END AS b, CAST(o_custkey % 100 AS STRING) || '.5' AS c
FROM orders WHERE o_orderkey % 7 > 0"""
SPARK_META = f"""
SELECT doc_id, title, array(named_struct('label', '발행', 'value', a), named_struct('label', b, 'value', '3년')) AS info,
  array(named_struct('label', '국고', 'value', c), named_struct('label', '민평', 'value', 'n/a'), named_struct('label', 'Spread', 'value', '7')) AS market_info
FROM ({META}) q"""
DUCK_META = f"""
SELECT doc_id, title, [{{'label': '발행', 'value': a}}, {{'label': b, 'value': '3년'}}] AS info,
  [{{'label': '국고', 'value': c}}, {{'label': '민평', 'value': 'n/a'}}, {{'label': 'Spread', 'value': '7'}}] AS market_info
FROM ({META}) q"""

#: Tables with their true headers: the first of ten rows with a mark or a period names the columns of a table with placeholders; useless rows go.
PROMOTED = r"""
v AS MATERIALIZED (SELECT *, trim(value) AS tv, bool_or(starts_with(col_name, 'Col_')) OVER (PARTITION BY doc_id) AS has_open FROM t),
hd AS (SELECT doc_id, min(row_idx) AS head FROM v WHERE has_open AND row_idx < 10 AND (tv IN ('구분', '구 분', '항목') OR regexp_matches(tv, '^제[0-9]+기')) GROUP BY doc_id),
nm AS (
  SELECT DISTINCT v.doc_id, v.col_idx, CASE WHEN hd.head IS NULL THEN v.col_name ELSE coalesce(nullif(h.tv, ''), '열' || (v.col_idx + 1)) END AS col_name
  FROM v LEFT JOIN hd ON hd.doc_id = v.doc_id LEFT JOIN v h ON h.doc_id = v.doc_id AND h.row_idx = hd.head AND h.col_idx = v.col_idx),
ns AS (SELECT doc_id, list_sort(list(DISTINCT col_name)) AS names FROM nm GROUP BY doc_id),
ok AS (
  SELECT doc_id, row_idx FROM v LEFT JOIN hd USING (doc_id) JOIN ns USING (doc_id) WHERE head IS NULL OR row_idx <> head
  GROUP BY doc_id, row_idx HAVING NOT bool_or(regexp_matches(tv, '^Col_[0-9]+')) AND list_sort(list(DISTINCT tv)) <> any_value(names)),
pl AS (SELECT doc_id, row_idx, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) - 1 AS place FROM ok),
pr AS (SELECT v.doc_id, v.row_idx, pl.place, v.col_idx, nm.col_name, v.value, v.tv FROM v JOIN pl ON pl.doc_id = v.doc_id AND pl.row_idx = v.row_idx JOIN nm ON nm.doc_id = v.doc_id AND nm.col_idx = v.col_idx)"""

query("header_promoted", SHEETS, f", {PROMOTED} SELECT doc_id, row_idx, place, col_idx, col_name, value FROM pr")(lambda d: sheets.promoted(d).drop("table_no"))

ROLE = r"""CASE WHEN first = '' THEN 'normal' WHEN first IN ('구 분', '구분') THEN 'header' WHEN first IN ('비중(%)', '비중', '누적비중(%)', '누적비중') THEN 'summary' WHEN regexp_matches(first, '총계|합계|소계') THEN 'subtotal'
    WHEN regexp_matches(first, '^\[.+\]$') THEN 'category' WHEN regexp_matches(first, '^[ㆍ·•-]') THEN 'detail' WHEN contains(first, '년') AND (contains(first, '월') OR contains(first, '기')) THEN 'period' ELSE 'normal' END"""
PLAN_SQL = rf"""
WITH t AS ({SHEETS}), e AS (SELECT DISTINCT * FROM ({ERRORS}) q), m AS ({DUCK_META}),
{PROMOTED},
mt AS (SELECT doc_id, (title <> '')::INT + greatest(len(info), len(market_info)) + 1 AS h FROM m),
b AS (
  SELECT pr.doc_id, coalesce(h, 0) AS h, place, pr.col_idx, col_name, tv AS value, e.doc_id IS NOT NULL AS error, max(CASE WHEN pr.col_idx = 0 THEN tv END) OVER (PARTITION BY pr.doc_id, pr.row_idx) AS first
  FROM pr LEFT JOIN mt ON mt.doc_id = pr.doc_id LEFT JOIN e ON e.doc_id = pr.doc_id AND e.row_idx = pr.row_idx AND e.col_idx = pr.col_idx),
n AS (SELECT *, {ROLE} AS role, CASE WHEN col_idx > 0 THEN {PARSED} END AS p, {TYPE} AS k FROM b),
hx AS (SELECT DISTINCT doc_id, h, col_idx, col_name, trim(replace(col_name, '+', '')) AS bare FROM b)
SELECT doc_id, h + place + 1 AS "row", col_idx AS col, value, CASE WHEN k = 'percent' THEN p / 100 WHEN contains(value, '.') THEN p ELSE trunc(p) END AS number,
  CASE WHEN p IS NULL THEN NULL WHEN k = 'percent' THEN '0.0%' WHEN contains(value, '.') THEN '#,##0.00' ELSE '{c.NUMBER_FORMATS["demand_forecast"]}' END AS fmt,
  role || CASE WHEN col_idx = 0 THEN '-first' ELSE '' END || CASE WHEN error THEN '!' ELSE '' END AS style FROM n
UNION ALL SELECT doc_id, h, col_idx, col_name, CASE WHEN regexp_matches(bare, '^-?[0-9]+$') THEN bare::DOUBLE END, CASE WHEN regexp_matches(bare, '^-?[0-9]+$') THEN '{c.HEADER_FORMATS["demand_forecast"]}' END, 'head' FROM hx
UNION ALL SELECT doc_id, 0, 0, title, NULL, NULL, 'title' FROM m SEMI JOIN pr USING (doc_id) WHERE title <> ''
UNION ALL SELECT doc_id, (title <> '')::INT + i, o, CASE WHEN o IN (0, 4) THEN '· ' || p.label ELSE p.value END, CASE WHEN o = 6 THEN try_cast(p.value AS DOUBLE) END, CASE WHEN o = 6 AND try_cast(p.value AS DOUBLE) IS NOT NULL THEN '0.000' END,
  CASE WHEN o = 6 AND try_cast(p.value AS DOUBLE) IS NOT NULL THEN 'meta-number' ELSE 'meta' END
  FROM (SELECT m.doc_id, title, unnest(info) AS p, unnest(range(len(info))) AS i, 0 AS side FROM m SEMI JOIN pr USING (doc_id) UNION ALL SELECT m.doc_id, title, unnest(market_info), unnest(range(len(market_info))), 4 FROM m SEMI JOIN pr USING (doc_id)) s,
    LATERAL (SELECT unnest([side, side + 2]) AS o) w WHERE p.label <> ''"""


@query("sheet_plan", None, PLAN_SQL)
def sheet_plan(get) -> DataFrame:
    """Everything that stands in a workbook, from cells, errors and metadata."""
    plan = sheets.sheet_plan(get(SHEETS), get(ERRORS), get(SPARK_META), profile="demand_forecast")
    return plan.select("doc_id", "row", "col", "value", "number", "fmt", "style")


# -- changed outputs ---------------------------------------------------------------------------------

#: What workbooks held at two times, and hold now; a header stands in row 0.
_BOOKS = f"SELECT 'f' || CAST(d AS STRING) AS path, '표1' AS sheet, CAST(r + 1 AS INT) AS row, a, b FROM ({x._LINE}) l"
_CELL = """
SELECT path, CAST({time} AS BIGINT) AS modified, sheet, row, CAST(k AS INT) AS col, {value} AS value, CASE WHEN k = 1 THEN CAST({number} AS DOUBLE) END AS number, 0 AS head
FROM ({books}) b CROSS JOIN (VALUES (0), (1)) AS v(k)
UNION ALL SELECT DISTINCT path, CAST({time} AS BIGINT), sheet, 0, CAST(k AS INT), CASE WHEN k = 0 THEN '회사명' ELSE '금액' END, CAST(NULL AS DOUBLE), 0 FROM ({books}) b CROSS JOIN (VALUES (0), (1)) AS v(k)"""
OLD = _CELL.format(books=_BOOKS, time=10, value="CASE WHEN k = 0 THEN 'firm ' || CAST(a AS STRING) ELSE CAST(b AS STRING) END", number="b")
LATER = _CELL.format(books=f"SELECT * FROM ({_BOOKS}) o WHERE a % 3 = 0", time=20, value="CASE WHEN k = 0 THEN 'firm ' || CAST(a + 1 AS STRING) ELSE CAST(b AS STRING) END", number="b")
NOW = _CELL.format(books=f"SELECT * FROM ({_BOOKS}) o WHERE b % 2 = 0", time=30, value="CASE WHEN k = 0 THEN CASE WHEN b % 3 = 0 THEN ' ' WHEN b % 3 = 1 THEN ' firm ' || CAST(a AS STRING) ELSE '삼성증권' END ELSE CAST(b AS STRING) || '.0' END", number="b + CASE WHEN a % 5 = 0 THEN 1 ELSE 0 END")
BEFORE = f"{OLD} UNION ALL {LATER}"
HEADER_KIND = "CASE WHEN contains(col_name, '회사') THEN 'company' WHEN contains(col_name, '금액') THEN 'number' ELSE 'term' END"

query("output_changes", None, f"""
WITH n AS MATERIALIZED ({NOW}), b AS MATERIALIZED ({BEFORE}),
f AS (SELECT path, max(modified) AS modified FROM b WHERE modified < 30 GROUP BY path),
o AS (SELECT b.* FROM b JOIN f USING (path, modified)),
h AS (SELECT path, sheet, col, value AS col_name FROM n WHERE "row" = head)
SELECT n.path, n.sheet, n."row", n.col, h.col_name, trim(o.value) AS original, trim(n.value) AS corrected, {HEADER_KIND} AS kind
FROM n JOIN o ON o.path = n.path AND o.sheet = n.sheet AND o."row" = n."row" AND o.col = n.col JOIN h ON h.path = n.path AND h.sheet = n.sheet AND h.col = n.col
WHERE n."row" > n.head AND trim(o.value) <> '' AND trim(n.value) <> '' AND trim(o.value) <> trim(n.value) AND NOT coalesce(n.number = o.number, false)""")(
    lambda get: outputs.changes(get(NOW), get(BEFORE)).drop("modified")
)


# -- the chain from documents to cells, and what is learned from them ---------------------------------

DOCUMENTS = f"SELECT doc_id, 'h' || CAST(doc_id % 500 AS STRING) AS content_hash, CAST(1000 AS DOUBLE) AS width, height FROM ({HEIGHTS}) h"
CACHE = """
SELECT DISTINCT 'h' || CAST(l_orderkey % 500 AS STRING) AS content_hash, CAST(r AS INT) AS row_idx, CAST(k AS INT) AS col_idx, CASE WHEN k = 0 THEN '회사명' ELSE 'n' END AS col_name, CASE WHEN k = 0 THEN 'firm 5' ELSE CAST(r AS STRING) END AS value
FROM lineitem CROSS JOIN (VALUES (0), (1)) AS a(r) CROSS JOIN (VALUES (0), (1)) AS b(k) WHERE l_orderkey % 500 % 11 = 0"""
GRIDS = f"SELECT doc_id, g_r AS row, g_c AS col, gx_min, gx_max, gy_min, gy_max FROM ({x.GRID}) g WHERE doc_id % 3 > 0"
RAWS = f"SELECT * FROM ({RAW}) r WHERE doc_id % 4 = 1"
PAIRS = (("firm 3", "firm thre"),)
CHAIN = f"""
g AS MATERIALIZED ({ORACLE_SQL['grid_table']}), l AS MATERIALIZED ({ORACLE_SQL['row_group_table']}), r AS MATERIALIZED ({ORACLE_SQL['raw_table_normalize']}),
dc AS ({DOCUMENTS}), ch AS ({CACHE}), e AS ({KNOWN}), v AS ({KNOWN_VARIANTS}),
x0 AS (SELECT doc_id, row_idx, col_idx, col_name, value, 'cached' AS route FROM dc JOIN ch USING (content_hash)),
x1 AS (SELECT * FROM x0 UNION ALL SELECT doc_id, row_idx, col_idx, col_name, value, 'raw' FROM r WHERE doc_id % 4 = 1 AND doc_id NOT IN (SELECT doc_id FROM x0)),
x2 AS (SELECT * FROM x1 UNION ALL SELECT doc_id, row_idx, col_idx, col_name, value, 'ruled' FROM g WHERE doc_id % 3 > 0 AND doc_id % 4 <> 1 AND doc_id NOT IN (SELECT doc_id FROM x0)),
x3 AS MATERIALIZED (SELECT * FROM x2 UNION ALL SELECT doc_id, row_idx, col_idx, col_name, value, 'lines' FROM l WHERE doc_id % 4 <> 1 AND doc_id NOT IN (SELECT doc_id FROM x2)),
rt AS (SELECT DISTINCT doc_id, route FROM x3),
lit AS (SELECT doc_id, row_idx, col_idx, col_name, CASE WHEN col_idx < 6 THEN replace(value, 'firm 3', 'firm thre') ELSE value END AS value FROM x3),
{_FIX('lit', 1)},
fin AS MATERIALIZED (SELECT r1.*, route FROM r1 JOIN rt USING (doc_id))"""


def inputs(get) -> conversion.Inputs:
    return conversion.Inputs(get(DOCUMENTS), get(NAMED_BOXES), get(GRIDS), get(RAWS), get(CACHE), get(KNOWN), get(KNOWN_VARIANTS), PAIRS)


query("conversion_cells", None, f"WITH {CHAIN} SELECT doc_id, row_idx, col_idx, col_name, value, route FROM fin")(lambda get: conversion.corrected(inputs(get)))

#: Titles and lists of a table of its own, so that all kinds of events occur.
LEARN_META = f"SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE '수요 예측 결과' END AS title, CAST(l_orderkey % 2 AS INT) AS n FROM ({x.dealt('learn_docs', 'SELECT DISTINCT l_orderkey FROM lineitem')}) q"
LEARN_TYPES = x.dealt("learn_types", "SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN l_orderkey % 5 = 0 THEN 'demand_forecast' ELSE 'default' END AS doc_type FROM lineitem")
_WORDS = r"list_filter(regexp_split_to_array(regexp_replace({0}, '[^\p{{L}}\p{{N}}_]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2 AND w NOT IN ('으로'))"
_EMPTY = "NULL::INT, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR"
EVENTS = rf"""
t AS MATERIALIZED ({SHEETS}), m AS ({LEARN_META}), ty AS ({LEARN_TYPES}),
h AS MATERIALIZED (SELECT DISTINCT doc_id, col_idx, col_name FROM t), w AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1), hi AS (SELECT doc_id, max(row_idx) + 1 AS n FROM t GROUP BY 1),
f AS (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY min(row_idx)) AS i FROM t WHERE col_idx = 0 GROUP BY 1, 2),
ev AS (
  SELECT 'column' AS kind, doc_id, trim(col_name) AS name, col_idx AS "position", NULL::DOUBLE AS weight, NULL::DOUBLE AS number, NULL::VARCHAR AS text FROM h WHERE trim(col_name) <> '' AND NOT starts_with(trim(col_name), 'Col_')
  UNION ALL SELECT 'header', doc_id, NULL, NULL, NULL, any_value(hi.n)::DOUBLE, '[' || string_agg('"' || trim(col_name) || '"', ',' ORDER BY col_idx) || ']' FROM h JOIN hi USING (doc_id) WHERE trim(col_name) <> '' AND NOT starts_with(trim(col_name), 'Col_') GROUP BY doc_id HAVING count(*) >= 3
  UNION ALL SELECT 'keyword', doc_id, unnest({_WORDS.format('title')}), NULL, 3.0, NULL, NULL FROM m
  UNION ALL SELECT 'keyword', doc_id, unnest({_WORDS.format('col_name')}), NULL, 2.0, NULL, NULL FROM h
  UNION ALL SELECT 'keyword', doc_id, unnest({_WORDS.format('value')}), NULL, 1.0, NULL, NULL FROM f WHERE i <= 20
  UNION ALL SELECT 'number', doc_id, col_name, NULL, NULL, p, NULL FROM (SELECT *, CASE WHEN regexp_matches(replace(trim(value), ',', ''), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN replace(trim(value), ',', '')::DOUBLE END AS p FROM t) q WHERE p IS NOT NULL
  UNION ALL SELECT DISTINCT 'entity', doc_id, trim(value), NULL::INT, NULL::DOUBLE, NULL::DOUBLE, CASE col_idx WHEN 0 THEN 'company' ELSE 'department' END FROM t JOIN w USING (doc_id) WHERE col_idx < 2 AND w.n >= 4 AND length(trim(value)) >= 2 AND NOT regexp_matches(replace(replace(trim(value), ',', ''), '-', ''), '^[0-9]+$')
  UNION ALL SELECT 'metadata', doc_id, 'info_labels', NULL, NULL, NULL, '["발행"]' FROM m WHERE n = 1
  UNION ALL SELECT 'metadata', doc_id, 'title_sample', NULL, NULL, NULL, title FROM m WHERE title <> ''),
lv AS MATERIALIZED (SELECT kind, doc_type, doc_id, name, "position", weight, number, text FROM ev JOIN ty USING (doc_id))"""


def learned_events(get, kinds: tuple[str, ...] = learning.KINDS) -> DataFrame:
    pair = "named_struct('label', '발행', 'value', 'x')"
    meta = get(f"SELECT doc_id, title, CASE WHEN n = 1 THEN array({pair}) ELSE slice(array({pair}), 1, 0) END AS info, slice(array({pair}), 1, 0) AS market_info FROM ({LEARN_META}) q")
    return learning.learn(get(SHEETS), get(LEARN_TYPES), meta, kinds, dealt=True)


query("learn_events", None, f"WITH {EVENTS} SELECT * FROM lv")(lambda get: learned_events(get))

STATE_SQL = {
    "keywords": "SELECT doc_type, name, count(*) AS n, max(weight) AS weight FROM lv WHERE kind = 'keyword' GROUP BY 1, 2",
    "entities": "SELECT text, name, count(*) AS n FROM lv WHERE kind = 'entity' GROUP BY 1, 2",
    "numbers": "SELECT doc_type, name, count(*) AS n, sum(number) AS total, min(number) AS low, max(number) AS high FROM lv WHERE kind = 'number' GROUP BY 1, 2",
}


KIND_OF = {"keywords": "keyword", "entities": "entity", "numbers": "number"}


def state_query(kind: str):
    """The state of one kind after three batches, the second of them twice, with a compaction in between."""

    def run(get) -> DataFrame:
        events = learned_events(get, (KIND_OF[kind],))
        state = learning.State(events.sparkSession, new_folder(events.sparkSession, "state"), learning.AGGREGATES[kind])
        for turn, rest in enumerate((0, 1, 1, 2)):
            state.add(f"b{rest}", events.where(F.pmod("doc_id", F.lit(3)) == rest))
            if turn == 1:
                state.compact()
        return state.current()

    return run


for _kind, _sql in STATE_SQL.items():
    query(f"state_{_kind}", None, f"WITH {EVENTS} {_sql}")(state_query(_kind))
