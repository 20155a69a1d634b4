"""Queries over tables with the headers, labels and words that the operators' rules look for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as c
from ..operators import layout, learn, reshape, tables, validate
from . import fixtures as x
from .queries import PARSED, PLAIN, SPREAD, TOTAL, TYPE, query

ANY = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"
IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
NUMBER_HEADER = r"(regexp_matches(trim(header), '^[+-]*[0-9]+$') OR contains(header, '금액') OR contains(header, '합계'))"

# -- cells -------------------------------------------------------------------------------------------

MIXED = f"SELECT doc_id, value, CASE cust % 5 WHEN 0 THEN '-100' WHEN 1 THEN '회사명' WHEN 2 THEN '총참여금액' WHEN 3 THEN ' +66 ' ELSE 'Solid' END AS header FROM ({x.VALUES}) q"
query("ocr_digit_fix", MIXED, f"SELECT doc_id, CASE WHEN {NUMBER_HEADER} AND trim(value) <> '' AND translate(trim(value), 'OolISBZG', '00115826') <> trim(value) THEN translate(trim(value), 'OolISBZG', '00115826') ELSE value END AS fixed FROM t")(
    lambda d: d.select("doc_id", c.fix_numeric(F.col("header"), F.col("value")).alias("fixed"))
)
PLAN = f"""SELECT doc_id, '@profile' AS profile, CASE WHEN p IS NULL THEN NULL WHEN k = 'percent' THEN p / 100 WHEN contains(value, '.') THEN p ELSE trunc(p) END AS number, CASE WHEN p IS NULL THEN value END AS string_value,
 CASE WHEN p IS NULL THEN 'General' WHEN k = 'percent' THEN '0.0%' WHEN contains(value, '.') THEN '#,##0.00' ELSE '@format' END AS fmt FROM (SELECT *, {TYPE} AS k, {PARSED} AS p FROM t) q"""
FORMATS = c.NUMBER_FORMATS


@query("excel_cell_plan", x.VALUES, " UNION ALL ".join(PLAN.replace("@profile", k).replace("@format", v) for k, v in FORMATS.items()))
def excel_cell_plan(d: DataFrame) -> DataFrame:
    plans = [d.select("doc_id", F.lit(k).alias("profile"), c.cell_plan(F.col("value"), v).alias("p")) for k, v in FORMATS.items()]
    return plans[0].unionByName(plans[1]).select("doc_id", "profile", "p.number", "p.string_value", "p.fmt")


WIDE = r"max(length(header) + length(regexp_replace(header, '[\x00-\x7F]', '', 'g')))"
query("auto_column_width", x.HEADS, f"SELECT col_idx, greatest({WIDE} + CASE WHEN col_idx < 6 THEN 3 ELSE 2 END, CASE WHEN col_idx < 6 THEN 14 ELSE 7 END) AS demand, greatest({WIDE} + CASE WHEN col_idx = 0 THEN 4 ELSE 3 END, CASE WHEN col_idx = 0 THEN 30 ELSE 18 END) AS usual FROM t GROUP BY 1")(
    lambda d: d.groupBy("col_idx").agg(F.max(c.display_width(F.col("header"))).alias("w")).select("col_idx", c.column_width(F.col("w"), F.col("col_idx"), True).alias("demand"), c.column_width(F.col("w"), F.col("col_idx"), False).alias("usual"))
)
PATHS = "SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/a.b.png' WHEN 1 THEN '/scan' WHEN 2 THEN '/x.PDF' ELSE '.d/plain' END AS path FROM pages"
query("output_path", PATHS, r"SELECT page_id, regexp_replace(path, '\.[^./]*$', '') || '_변환결과.xlsx' AS out FROM t")(lambda d: d.select("page_id", c.output_path(F.col("path")).alias("out")))
query("image_base64", "SELECT page_id, html FROM pages", "SELECT page_id, base64(encode(html)) AS body FROM t")(lambda d: d.select("page_id", F.translate(F.base64(F.encode("html", "UTF-8")), "\r\n", "").alias("body")))
KOREAN = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '한국투자증권' WHEN 1 THEN '삼성생명 ' || p_name WHEN 2 THEN '값' || CAST(p_size AS STRING) WHEN 3 THEN '' ELSE p_name END AS a, CASE p_partkey % 3 WHEN 0 THEN '한국투자증귄' WHEN 1 THEN '삼성셍명' ELSE '갑옷' END AS b FROM part"
LETTERS = lambda s: f"""array_to_string(list_transform(CASE WHEN {s} = '' THEN [] ELSE string_split({s}, '') END, lambda ch: CASE WHEN unicode(ch) BETWEEN 44032 AND 55203 THEN substr('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ', (unicode(ch) - 44032) // 588 + 1, 1)
 || substr('ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ', (unicode(ch) - 44032) % 588 // 28 + 1, 1) || CASE WHEN (unicode(ch) - 44032) % 28 > 0 THEN substr('ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ', (unicode(ch) - 44032) % 28, 1) ELSE '' END ELSE ch END), '')"""  # noqa: E731
query("jamo_decompose", KOREAN, f"SELECT p_partkey, {LETTERS('a')} AS a, {LETTERS('b')} AS b FROM t")(lambda d: d.select("p_partkey", c.jamo(F.col("a")).alias("a"), c.jamo(F.col("b")).alias("b")))
#: DuckDB compares bytes of texts beyond ASCII, so each letter of Hangul takes a code below 97 that names of parts do not use; small letters, digits and spaces stay.
LATIN = lambda s: f"array_to_string(list_transform(CASE WHEN {s} = '' THEN [] ELSE string_split({s}, '') END, lambda ch: CASE WHEN unicode(ch) BETWEEN 12593 AND 12607 THEN chr(unicode(ch) - 12593 + 33) WHEN unicode(ch) BETWEEN 12608 AND 12643 THEN chr(unicode(ch) - 12608 + 58) ELSE ch END), '')"
query("jamo_distance", KOREAN, f"SELECT p_partkey, levenshtein({LATIN('x')}, {LATIN('y')})::BIGINT AS distance FROM (SELECT p_partkey, {LETTERS('a')} AS x, {LETTERS('b')} AS y FROM t) q")(
    lambda d: d.select("p_partkey", c.jamo_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))
)

# -- sheets with labels ------------------------------------------------------------------------------

#: One table per order: a row before the data, a row for each line with its number in some spread column, and a closing row.
_ROWS = x.dealt("sheet_rows", f"""SELECT d, r + 1 AS r, a, b, c, 'line' AS kind FROM ({x._LINE}) l UNION ALL SELECT DISTINCT l_orderkey, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'head' FROM lineitem
 UNION ALL SELECT d, CAST(count(*) + 1 AS INT), sum(a), sum(b), sum(c), 'sum' FROM ({x._LINE}) m GROUP BY d""", once=f"""SELECT d, inline(rows) FROM (SELECT d, CASE WHEN r = 0 THEN array(line, named_struct('r', 0, 'a', 0L, 'b', 0L, 'c', 0L, 'kind', 'head'), named_struct('r', n, 'a', sa, 'b', sb, 'c', sc, 'kind', 'sum')) ELSE array(line) END AS rows
 FROM (SELECT d, r, named_struct('r', r + 1, 'a', a, 'b', b, 'c', c, 'kind', 'line') AS line, CAST(count(*) OVER w + 1 AS INT) AS n, sum(a) OVER w AS sa, sum(b) OVER w AS sb, sum(c) OVER w AS sc FROM ({x._LINE}) l WINDOW w AS (PARTITION BY d)) p) q""")
SHEET = f"""SELECT d AS doc_id, r AS row_idx, k AS col_idx, CASE k WHEN 0 THEN '회사명' WHEN 1 THEN '부서명' WHEN 2 THEN '이름' WHEN 3 THEN '계정' WHEN 4 THEN '최종참여일시' WHEN 5 THEN '총참여금액' WHEN 6 THEN '-100' WHEN 9 THEN '-40' ELSE 'Col_' || CAST(k AS STRING) END AS col_name,
 CASE WHEN kind = 'head' THEN CASE WHEN k = 0 AND d % 3 = 0 THEN '전일기준 종가' WHEN k = 2 AND d % 4 = 0 THEN '기준일 스프레드' WHEN k = 2 AND d % 4 = 1 THEN '기준일 SP' WHEN k = 7 THEN '-80' WHEN k = 8 THEN CASE WHEN d % 8 = 0 THEN '-60.5' ELSE 'n/a' END ELSE '' END
 WHEN kind = 'sum' THEN CASE WHEN k = 0 AND d % 2 = 0 THEN '합계' WHEN k = 3 AND d % 2 = 1 THEN '누적합계' WHEN k = 5 THEN CAST(a + b + c AS STRING) ELSE '' END
 WHEN k = 0 THEN 'firm ' || CAST(a % 7 AS STRING) WHEN k = 1 THEN 'desk ' || CAST(b % 3 AS STRING) WHEN k = 2 THEN 'p' WHEN k = 3 THEN 'acc' WHEN k = 4 THEN '2024-01-02' WHEN k = 5 THEN CAST(a + b + c AS STRING)
 WHEN k = 6 + a % 5 AND a % 7 > 0 THEN CAST(a + b + c AS STRING) WHEN k = 6 + (a + 2) % 5 AND a % 11 = 0 THEN '1,000' ELSE '' END AS value
 FROM ({_ROWS}) q CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS v(k)"""
RANGE = f"""g AS (SELECT doc_id, row_idx, max(col_idx = 0 AND contains(value, '{tables.BEFORE_DATA}')) AS mark, max(col_idx IN (0, 3) AND trim(value) IN {IN(tables.END_LABELS)}) AS label FROM t GROUP BY 1, 2),
 e AS (SELECT doc_id, coalesce(min(CASE WHEN label AND NOT mark THEN row_idx END), max(row_idx) + 1) AS end_row FROM g GROUP BY 1), rng AS (SELECT doc_id, coalesce(max(CASE WHEN mark AND row_idx < end_row THEN row_idx + 1 END), 0) AS start_row, any_value(end_row) AS end_row FROM g JOIN e USING (doc_id) GROUP BY 1)"""
query("data_range", SHEET, f", {RANGE} SELECT * FROM rng")(tables.data_range)
KIND = r"""CASE WHEN regexp_matches(h, '회사|기관') THEN 'company' WHEN regexp_matches(h, '부서|팀') THEN 'department' WHEN regexp_matches(h, '이름|성명') THEN 'name' WHEN contains(h, '계정') THEN 'account'
 WHEN regexp_matches(h, '일시|날짜') THEN 'datetime' WHEN regexp_matches(h, '^[+-]*[0-9]+$') OR regexp_matches(h, '금액|합계') THEN 'number' WHEN n >= 3 THEN 'number' ELSE 'text' END"""
query("column_type_infer", SHEET, rf", s AS (SELECT doc_id, col_idx, trim(col_name) AS h, count(*) FILTER (WHERE row_idx < 5 AND regexp_matches(trim(replace(value, ',', '')), '^-?[0-9]+\.?[0-9]*$')) AS n FROM t GROUP BY 1, 2, 3) SELECT doc_id, col_idx, {KIND} AS kind FROM s")(tables.column_kinds)
RESTORE = rf""", f AS (SELECT doc_id, min(CASE WHEN col_idx < 6 AND contains(value, '기준일') AND (contains(value, '스프레드') OR contains(value, 'SP')) THEN row_idx END) AS ref FROM t GROUP BY 1),
 p AS (SELECT t.doc_id, col_idx, col_name, CASE WHEN regexp_matches(trim(col_name), '^Col_[0-9]+$') THEN coalesce(max(CASE WHEN row_idx = ref AND regexp_matches(replace(trim(value), ',', ''), {PLAIN}) THEN replace(trim(value), ',', '') END), col_name) ELSE col_name END AS h FROM t JOIN f USING (doc_id) GROUP BY 1, 2, 3),
 n AS (SELECT *, CASE WHEN col_idx >= 5 AND regexp_matches(replace(regexp_replace(trim(h), '^[+-]+', ''), '.', ''), '^[0-9]+$') THEN try_cast(trim(h) AS DOUBLE) END AS num FROM p),
 k AS (SELECT *, max(CASE WHEN num IS NOT NULL THEN col_idx END) OVER (PARTITION BY doc_id ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS li, min(CASE WHEN num IS NOT NULL THEN col_idx END) OVER (PARTITION BY doc_id ORDER BY col_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ri FROM n),
 v AS (SELECT k.*, l.num + (r.num - l.num) / (ri - li) * (k.col_idx - li) AS line FROM k LEFT JOIN n l ON l.doc_id = k.doc_id AND l.col_idx = li LEFT JOIN n r ON r.doc_id = k.doc_id AND r.col_idx = ri)
 SELECT doc_id, col_idx, col_name, CASE WHEN regexp_matches(trim(h), '^Col_[0-9]+$') AND line IS NOT NULL THEN CASE WHEN line = floor(line) THEN line::BIGINT::VARCHAR ELSE printf('%.1f', round_even(line, 1)) END ELSE h END AS restored FROM v"""
query("header_restore", SHEET, RESTORE)(tables.restore_headers)
RAW = f"SELECT doc_id, row_idx, col_idx, CASE WHEN row_idx = 0 THEN CASE WHEN col_idx = 2 THEN '' ELSE col_name END WHEN row_idx % 4 = 3 OR col_idx IN (4, 9) THEN ' ' ELSE ' ' || value END AS value FROM ({SHEET}) s WHERE doc_id % 5 > 0 OR row_idx = 0"
NORMAL = """, h AS (SELECT doc_id, row_idx, col_idx, trim(value) AS value, max(CASE WHEN row_idx = 0 THEN trim(value) END) OVER (PARTITION BY doc_id, col_idx) AS h, max(row_idx) OVER (PARTITION BY doc_id) AS last FROM t),
 d AS (SELECT doc_id, row_idx - 1 AS row_idx, col_idx, coalesce(nullif(h, ''), 'Col_' || col_idx) AS col_name, value FROM h WHERE last >= 1 AND row_idx > 0)
 SELECT doc_id, row_idx, col_idx, col_name, value FROM (SELECT *, max(value <> '') OVER (PARTITION BY doc_id, row_idx) AS r, max(value <> '') OVER (PARTITION BY doc_id, col_idx) AS c FROM d) q WHERE r AND c"""
query("raw_table_normalize", RAW, NORMAL)(tables.normalize_raw)
query("header_assign", x.RAW, "SELECT doc_id, row_idx - 1 AS row_idx, col_idx, coalesce(nullif(h, ''), 'Col_' || col_idx) AS col_name, value FROM (SELECT *, max(CASE WHEN row_idx = 0 THEN value END) OVER (PARTITION BY doc_id, col_idx) AS h FROM t) q WHERE row_idx > 0")(
    reshape.assign_header
)
#: What an image shows: a grid whose last five columns are narrow, and its filled cells.
PAGE_GRID = f"SELECT DISTINCT d AS doc_id, r AS row, k AS col, CAST(CASE WHEN k < 6 THEN 100 * k ELSE 600 + 40 * (k - 6) END AS DOUBLE) AS x_min, CAST(CASE WHEN k < 6 THEN 100 * k + 95 ELSE 638 + 40 * (k - 6) END AS DOUBLE) AS x_max FROM ({_ROWS}) q CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) AS v(k) WHERE d % 9 > 0 OR k < 7"
FILLED = f"SELECT d AS doc_id, r + CASE WHEN d % 3 = 0 THEN 0 ELSE 1 END AS row, k AS col FROM ({_ROWS}) q CROSS JOIN (VALUES (0), (6), (7), (8), (9), (10)) AS v(k) WHERE k = 0 OR kind = 'head' OR k = 6 + b % 5 OR (c % 4 = 0 AND k = 6 + (b + 3) % 5)"
NUMBER = lambda h: rf"""(regexp_matches(replace(regexp_replace(trim(regexp_extract(trim({h}), '\(([^(]*)\)[^()]*$', 1)), '^[+-]+', ''), '.', ''), '^[0-9]+$') OR regexp_matches(regexp_replace(regexp_replace(trim({h}), '^[+-]+', ''), '[.%]', '', 'g'), '^[0-9]+$'))"""
START = f"st AS (SELECT doc_id, coalesce(min(CASE WHEN {NUMBER('col_name')} THEN col_idx END), min(CASE WHEN {TOTAL.replace('header', 'col_name')} THEN col_idx END) + 1) AS sc, max(col_idx) + 1 AS nc FROM t GROUP BY 1)"
PLACE = f"""WITH t AS ({SHEET}), g AS ({PAGE_GRID}), o AS ({FILLED}), {START}, {RANGE.replace("g AS (SELECT doc_id, row_idx", "gg AS (SELECT doc_id, row_idx").replace("FROM g ", "FROM gg ")},
 wd AS (SELECT doc_id, col, x_max - x_min AS w FROM g WHERE "row" = 0), md AS (SELECT doc_id, list_sort(list(w))[len(list(w)) // 2 + 1] AS m FROM wd GROUP BY 1),
 gs AS (SELECT doc_id, coalesce(max(CASE WHEN w > 1.3 * m THEN col END), -1) + 1 AS gs FROM wd JOIN md USING (doc_id) GROUP BY 1), gc AS (SELECT doc_id, max(col) + 1 AS n FROM g GROUP BY 1),
 sh AS (SELECT st.doc_id, sc, nc, nc - sc AS ns, gs, start_row, end_row FROM st JOIN gs USING (doc_id) JOIN gc USING (doc_id) JOIN rng USING (doc_id) WHERE nc - sc BETWEEN 3 AND 22 AND abs(n - gs - (nc - sc)) <= 3),
 f AS (SELECT o.*, sc, nc, ns, gs FROM o JOIN sh USING (doc_id)), hc AS (SELECT doc_id, "row", count(*) AS n FROM f WHERE "row" < 5 AND col >= gs GROUP BY 1, 2), hd AS (SELECT doc_id, min_by("row", -n * 100 + "row") AS head FROM hc GROUP BY 1),
 ln AS (SELECT f.doc_id, f."row", list_sort(list(DISTINCT col - gs) FILTER (WHERE col >= gs AND col - gs < ns)) AS occ, max(col < least(gs, 3)) AS txt FROM f LEFT JOIN hd USING (doc_id) WHERE f."row" > coalesce(head, 0) GROUP BY 1, 2),
 lo AS (SELECT doc_id, coalesce(occ, []) AS occ, row_number() OVER (PARTITION BY doc_id ORDER BY "row") - 1 AS n FROM ln WHERE txt OR len(coalesce(occ, [])) > 0),
 rw AS (SELECT doc_id, row_idx, row_idx - any_value(start_row) AS n, any_value(sc) AS sc, coalesce(list({{'at': col_idx - sc, 'value': value}}) FILTER (WHERE col_idx >= sc AND regexp_matches(replace(trim(value), ',', ''), {PLAIN})), []) AS vals,
  max(CASE WHEN col_idx = (sc - 1 + nc) % nc AND trim(value) NOT IN ('', 'nan') THEN value END) AS total FROM t JOIN sh USING (doc_id) WHERE row_idx >= start_row AND row_idx < end_row GROUP BY 1, 2),
 mv AS (SELECT rw.*, occ, CASE WHEN len(vals) = 1 AND len(occ) > 0 THEN list_sort(list_transform(occ, lambda y: {{'d': abs(y - vals[1].at), 'o': y}}))[1].o WHEN len(vals) = 0 AND len(occ) = 1 AND total IS NOT NULL THEN occ[1] END AS dest FROM rw JOIN lo USING (doc_id, n)),
 m AS (SELECT doc_id, row_idx, sc + dest AS dest, CASE WHEN len(vals) = 1 THEN sc + vals[1].at END AS src, CASE WHEN len(vals) = 1 THEN vals[1].value ELSE total END AS moved FROM mv WHERE dest IS NOT NULL)
 SELECT t.doc_id, t.row_idx, t.col_idx, t.col_name, CASE WHEN t.col_idx = m.dest AND coalesce(m.src <> m.dest, true) THEN moved WHEN t.col_idx = m.src AND m.src <> m.dest THEN '' ELSE t.value END AS value FROM t LEFT JOIN m USING (doc_id, row_idx)"""
query("spread_realign", None, PLACE)(lambda get: tables.place_spreads(get(SHEET), get(PAGE_GRID), get(FILLED)))
HASHED = f"SELECT DISTINCT d AS doc_id, r AS row, k AS col, 100 * k AS x, 40 * r AS y, 90 + CAST(d % 3 AS INT) AS w, 38 AS h, 900 + 50 * CAST(d % 2 AS INT) AS img_w, 1000 AS img_h FROM ({_ROWS}) q CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)"
SHARE = lambda a, b: f"printf('%.2f', floor({a}::DOUBLE / greatest({b}, 1) * 100 + 0.5) / 100)"
HASHES = f"""SELECT doc_id, max("row") + 1 AS "rows", max(col) + 1 AS columns, substr(sha256((max("row") + 1) || 'x' || (max(col) + 1) || '|' || string_agg({SHARE('x', 'img_w')} || ',' || {SHARE('y', 'img_h')} || ',' || {SHARE('w', 'img_w')} || ',' || {SHARE('h', 'img_h')}, ',' ORDER BY "row", col)), 1, 16) AS fingerprint FROM t GROUP BY 1"""
query("layout_fingerprint", HASHED, HASHES)(tables.layout_hash)
query("template_match", HASHED, f", f AS ({HASHES}), s AS (SELECT fingerprint, count(*) AS sample_count FROM f GROUP BY 1 HAVING count(*) >= 5) SELECT doc_id, fingerprint, sample_count FROM f JOIN s USING (fingerprint)")(lambda d: tables.usable_templates(tables.layout_hash(d)))
TEMPLATES = """WITH b AS ({b}), h AS ({h}), g AS ({g}), s AS (SELECT f FROM h GROUP BY 1 HAVING count(*) >= 5),
 r AS (SELECT b.doc_id, box_id, text, g.g_r, g.g_c, row_number() OVER (PARTITION BY b.doc_id, box_id ORDER BY CASE WHEN {i} THEN 0 ELSE 1 END, CASE WHEN {i} THEN 0 ELSE {d} END, g.g_r, g.g_c) AS k FROM b JOIN h ON h.doc_id = b.doc_id JOIN s ON s.f = h.f JOIN g ON g.f = h.f)
 SELECT doc_id, g_r AS "row", g_c AS col, string_agg(text, ' ' ORDER BY box_id) AS value FROM r WHERE k = 1 GROUP BY 1, 2, 3"""
LAYOUT_OF = "SELECT l_orderkey AS doc_id, CAST(count(*) AS STRING) AS f FROM lineitem GROUP BY 1"
LEARNED = "SELECT f, g_r, g_c, CAST(160 * g_c AS DOUBLE) AS gx_min, CAST(160 * g_c + 150 AS DOUBLE) AS gx_max, CAST(100 * g_r AS DOUBLE) AS gy_min, CAST(100 * g_r + 90 AS DOUBLE) AS gy_max FROM (SELECT DISTINCT f FROM (SELECT l_orderkey, CAST(count(*) AS STRING) AS f FROM lineitem GROUP BY 1) k) m CROSS JOIN (VALUES (0), (1)) AS a(g_r) CROSS JOIN (VALUES (0), (1), (2), (3)) AS b(g_c)"
_IN = "x_center BETWEEN gx_min AND gx_max AND y_center BETWEEN gy_min AND gy_max"
_D2 = "(x_center - (gx_min + gx_max) / 2) * (x_center - (gx_min + gx_max) / 2) + (y_center - (gy_min + gy_max) / 2) * (y_center - (gy_min + gy_max) / 2)"
query("template_extract", None, TEMPLATES.format(b=x.BOXES, h=LAYOUT_OF, g=LEARNED, i=_IN, d=_D2))(
    lambda get: tables.with_template(get(x.BOXES), get(LAYOUT_OF).withColumnRenamed("f", "fingerprint"), get(LEARNED).withColumnsRenamed({"f": "fingerprint", "g_r": "row", "g_c": "col"}))
)

# -- responses ---------------------------------------------------------------------------------------

_JSON = """'{"headers":["a"' || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"b"' END || '],"rows":[["' || event_type || '","' || CAST(user_id AS STRING) || '",""],["","",""],["x"]]}'"""
ANSWERS = f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || {_JSON} || chr(10) || '```' WHEN 1 THEN {_JSON} WHEN 2 THEN substr({_JSON}, 1, length({_JSON}) - 9) WHEN 3 THEN '```' || {_JSON} || '``` done' WHEN 4 THEN 'sorry' WHEN 5 THEN '[["1"]]' ELSE '{{"headers":["a"' END AS raw FROM events"""
_TEXT = r"regexp_replace(CASE WHEN regexp_matches(raw, '```(?:json)?\s*[\s\S]*?```') THEN regexp_extract(raw, '```(?:json)?\s*([\s\S]*?)```', 1) ELSE raw END, '^\s+|\s+$', '', 'g')"
_COUNT = lambda s, ch: f"(length({s}) - length(replace({s}, '{ch}', '')))"
OBJECT = f"""a AS (SELECT event_id, {_TEXT} AS x FROM t), b AS (SELECT *, CASE WHEN length(regexp_extract(x, '^[\\s\\S]*\\]')) > 1 THEN regexp_extract(x, '^[\\s\\S]*\\]') ELSE x END AS y FROM a),
 c AS (SELECT *, y || repeat(']', greatest({_COUNT('y', '[')} - {_COUNT('y', ']')}, 0)::INT) || repeat('}}', greatest({_COUNT('y', '{')} - {_COUNT('y', '}')}, 0)::INT) AS z FROM b),
 o AS (SELECT event_id, CASE WHEN json_valid(x) THEN x WHEN json_valid(z) THEN z END AS j, json_valid(x) AS whole FROM c)"""
query("json_response_parse", ANSWERS, f", {OBJECT} SELECT event_id, CASE WHEN j LIKE '{{%' THEN j END AS found FROM o")(lambda d: d.select("event_id", tables.response_json(F.col("raw")).alias("found")))
query("json_repair", ANSWERS, f", {OBJECT} SELECT event_id, z AS repaired FROM c")(lambda d: d.select("event_id", c.repair_json(c.strip(F.when(F.col("raw").contains("```"), F.regexp_extract("raw", r"```(?:json)?\s*([\s\S]*?)```", 1)).otherwise(F.col("raw")))).alias("repaired")))
query("json_to_cells", ANSWERS, f""", {OBJECT}, p AS (SELECT event_id, from_json(j, '{{"headers":["VARCHAR"],"rows":[["VARCHAR"]]}}') AS j FROM o WHERE j LIKE '{{%'), q AS (SELECT event_id, coalesce(j.headers, []) AS hs, j.rows AS rs, greatest(len(coalesce(j.headers, [])), list_max(list_transform(j.rows, lambda r: len(r)))) AS w FROM p WHERE len(j.rows) > 0),
 e AS (SELECT event_id, i AS row_idx, k AS col_idx, coalesce(hs[k + 1], 'Col_' || k) AS col_name, coalesce(rs[i + 1][k + 1], '') AS value FROM q, LATERAL (SELECT unnest(range(len(rs))) AS i) u, LATERAL (SELECT unnest(range(w)) AS k) v)
 SELECT event_id, row_idx::INT AS row_idx, col_idx::INT AS col_idx, col_name, value FROM (SELECT *, max(value <> '') OVER (PARTITION BY event_id, row_idx) AS r, max(value <> '') OVER (PARTITION BY event_id, col_idx) AS k FROM e) z WHERE r AND k""")(lambda d: tables.response_cells(d, "event_id", "raw"))
PAGES = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN url || ' 총참여금액' WHEN 1 THEN '자산총계 ' || url WHEN 2 THEN '부채총계 모집밴드' ELSE url END AS text, 100 * CAST(page_id % 30 AS INT) AS w, 1000 * CAST(page_id % 3 AS INT) AS h FROM pages"
query("doc_type_estimate", PAGES, f"SELECT page_id, CASE WHEN {ANY('text', tables.DEMAND_WORDS)} THEN 'demand_forecast' WHEN {ANY('text', tables.BALANCE_WORDS)} THEN 'financial_statement' WHEN h > 0 AND w / h::DOUBLE > 1.8 THEN 'demand_forecast' END AS doc_type FROM t")(
    lambda d: d.select("page_id", tables.document_type(F.col("text"), F.col("w"), F.col("h")).alias("doc_type"))
)

# -- tables from boxes -------------------------------------------------------------------------------

NAMED_BOXES = f"""SELECT doc_id, box_id, confidence, x_center, y_center, x_min, x_max, y_min, y_max, CASE WHEN doc_id % 4 > 0 AND y_center < 60 AND box_id % 3 = 0 THEN '회사명' WHEN y_center < 90 THEN CASE (box_id + doc_id) % 6 WHEN 0 THEN '수요예측 결과' WHEN 1 THEN '모집금액 100' WHEN 2 THEN '국고 3년' WHEN 3 THEN 'BBB 사채만기' WHEN 4 THEN '제9회' ELSE text END ELSE text END AS text FROM ({x.BOXES}) bx"""
HEIGHTS = x.dealt("page_heights", "SELECT DISTINCT l_orderkey AS doc_id, CAST(600 + 50 * (l_orderkey % 20) AS DOUBLE) AS height FROM lineitem")
LINES = f"hb AS (SELECT doc_id, min_by(y_min, box_id) AS y FROM b WHERE {ANY('text', tables.LINE_WORDS)} GROUP BY 1), hl AS (SELECT p.doc_id, height, coalesce(y, height * 0.15) AS header_y FROM p LEFT JOIN hb USING (doc_id))"
_T, _I, _M = ANY("text", tables.TITLE_WORDS), ANY("text", tables.INFO_WORDS), ANY("text", tables.MARKET_WORDS)
query("metadata_extract", None, f"""WITH b AS ({NAMED_BOXES}), p AS ({HEIGHTS}), {LINES} SELECT b.doc_id, coalesce(max_by(text, box_id) FILTER (WHERE {_T}), '') AS title, coalesce(string_agg(text, '|' ORDER BY box_id) FILTER (WHERE NOT {_T} AND {_I}), '') AS info, coalesce(string_agg(text, '|' ORDER BY box_id) FILTER (WHERE NOT {_T} AND NOT {_I} AND {_M}), '') AS market FROM b JOIN hl USING (doc_id) WHERE y_max < header_y GROUP BY 1""")(
    lambda get: tables.metadata(get(NAMED_BOXES), tables.header_line(get(NAMED_BOXES), get(HEIGHTS))).select("doc_id", "title", F.array_join("info", "|").alias("info"), F.array_join("market_info", "|").alias("market"))
)
query("row_group_table", None, f"""WITH b AS ({NAMED_BOXES}), p AS ({HEIGHTS}), {LINES}, i AS (SELECT b.*, greatest(15, height * 0.02) AS gap FROM b JOIN hl USING (doc_id) WHERE y_min >= header_y - 10),
 r AS (SELECT *, sum(g) OVER (PARTITION BY doc_id ORDER BY y_center, box_id ROWS UNBOUNDED PRECEDING) - 1 AS row_no FROM (SELECT *, CASE WHEN y_center - lag(y_center) OVER (PARTITION BY doc_id ORDER BY y_center, box_id) < gap THEN 0 ELSE 1 END AS g FROM i) q),
 o AS (SELECT doc_id, row_no, text, row_number() OVER (PARTITION BY doc_id, row_no ORDER BY x_center, y_center, box_id) - 1 AS col_idx FROM r), f AS (SELECT DISTINCT doc_id, row_no FROM o WHERE row_no > 0)
 SELECT f.doc_id, (f.row_no - 1)::INT AS row_idx, h.col_idx, h.text AS col_name, coalesce(o.text, '') AS value FROM f JOIN o h ON h.doc_id = f.doc_id AND h.row_no = 0 LEFT JOIN o ON o.doc_id = f.doc_id AND o.row_no = f.row_no AND o.col_idx = h.col_idx""")(
    lambda get: tables.line_tables(get(NAMED_BOXES), get(HEIGHTS))
)
query("grid_table", None, f"""WITH b AS ({NAMED_BOXES}), g AS ({x.GRID}), w AS (SELECT b.doc_id, box_id, text, g_r, g_c, row_number() OVER (PARTITION BY b.doc_id, box_id ORDER BY (gx_max - gx_min) * (gy_max - gy_min), g_r, g_c) AS k FROM b JOIN g ON b.doc_id = g.doc_id AND {_IN}),
 v AS (SELECT doc_id, g_r, g_c, string_agg(text, ' ' ORDER BY box_id) AS value FROM w WHERE k = 1 GROUP BY 1, 2, 3), tp AS (SELECT doc_id, min(g_r) AS tp FROM v WHERE {ANY('value', tables.HEADER_WORDS)} GROUP BY 1),
 m AS (SELECT g.doc_id, g.g_r - tp - 1 AS r, g.g_c, v.value, max(CASE WHEN g.g_r = tp THEN trim(v.value) END) OVER (PARTITION BY g.doc_id, g.g_c) AS h FROM g JOIN tp USING (doc_id) LEFT JOIN v ON v.doc_id = g.doc_id AND v.g_r = g.g_r AND v.g_c = g.g_c WHERE g.g_r >= tp)
 SELECT doc_id, r AS row_idx, g_c AS col_idx, coalesce(nullif(h, ''), 'Col_' || g_c) AS col_name, coalesce(value, '') AS value FROM m WHERE r >= 0""")(
    lambda get: tables.grid_tables(get(NAMED_BOXES), get(x.GRID).withColumnsRenamed({"g_r": "row", "g_c": "col"}))
)
FALLBACK_GRID = f"SELECT * FROM ({x.GRID}) g WHERE doc_id % 3 > 0 OR g_c < 2"
query("layout_with_fallback", None, f"""WITH b AS ({x.BOXES}), g AS ({FALLBACK_GRID}), ru AS (SELECT doc_id FROM g GROUP BY 1 HAVING count(DISTINCT g_c) >= 3), k AS (SELECT b.doc_id, box_id, text, g_r, g_c, row_number() OVER (PARTITION BY b.doc_id, box_id ORDER BY CASE WHEN {_IN} THEN 0 ELSE 1 END, CASE WHEN {_IN} THEN 0 ELSE {_D2} END, g_r, g_c) AS k FROM b JOIN g ON b.doc_id = g.doc_id WHERE b.doc_id IN (SELECT doc_id FROM ru)),
 c AS (SELECT doc_id, box_id, text, x_center, y_center, row_number() OVER (PARTITION BY doc_id ORDER BY y_center, box_id) AS i, floor(avg(y_max - y_min) OVER (PARTITION BY doc_id) * 0.6) AS tol FROM b WHERE doc_id NOT IN (SELECT doc_id FROM ru)),
 f AS (WITH RECURSIVE z AS (SELECT doc_id, i, box_id, text, x_center, y_center AS y, 0 AS row_no FROM c WHERE i = 1 UNION ALL SELECT c.doc_id, c.i, c.box_id, c.text, c.x_center, CASE WHEN c.y_center - z.y > tol THEN c.y_center ELSE z.y END, CASE WHEN c.y_center - z.y > tol THEN z.row_no + 1 ELSE z.row_no END FROM z JOIN c ON c.doc_id = z.doc_id AND c.i = z.i + 1) SELECT * FROM z)
 SELECT doc_id, g_r AS "row", g_c AS col, string_agg(text, ' ' ORDER BY box_id) AS value, 'grid' AS by FROM k WHERE k = 1 GROUP BY 1, 2, 3 UNION ALL SELECT doc_id, row_no, (row_number() OVER (PARTITION BY doc_id, row_no ORDER BY x_center, box_id) - 1)::INT, text, 'coordinates' FROM f""")(
    lambda get: layout.with_fallback(get(x.BOXES), get(FALLBACK_GRID).withColumnsRenamed({"g_r": "row", "g_c": "col"}))
)

# -- corrections -------------------------------------------------------------------------------------

KNOWN = "SELECT 'company' AS kind, 'firm one' AS canonical_name, CAST(5 AS BIGINT) AS frequency UNION ALL SELECT 'company', 'firm 2', 3 UNION ALL SELECT 'company', 'firm three', 3 UNION ALL SELECT 'department', 'desk zero', 2 UNION ALL SELECT 'department', 'desk 1', 2 UNION ALL SELECT 'account', 'acct', 1"
KNOWN_VARIANTS = "SELECT 'company' AS kind, 'firm 5' AS variant_text, 'firm three' AS canonical_name, CAST(2 AS BIGINT) AS occurrence_count UNION ALL SELECT 'department', 'desk 2', 'desk zero', 1"
PAIRS = [("firm 3", "firm thre"), ("p", "P"), ("desk 0", "desk zer")]
_LITERAL = lambda s: f"CASE WHEN col_idx < 6 THEN replace(replace(replace({s}, 'firm 3', 'firm thre'), 'p', 'P'), 'desk 0', 'desk zer') ELSE {s} END"
_FIX = lambda src, n: f"""k{n} AS (SELECT *, CASE WHEN col_idx >= 6 THEN NULL WHEN contains(lower(col_name), '회사') OR col_idx = 0 THEN 'company' WHEN contains(lower(col_name), '부서') OR col_idx = 1 THEN 'department' WHEN contains(lower(col_name), '계정') OR col_idx = 3 THEN 'account' END AS kind FROM {src}),
 a{n} AS (SELECT DISTINCT kind, value FROM k{n} WHERE kind IS NOT NULL AND value <> ''), z{n} AS (SELECT a.kind, a.value, e.canonical_name, row_number() OVER (PARTITION BY a.kind, a.value ORDER BY CASE WHEN replace(a.value, ' ', '') = replace(e.canonical_name, ' ', '') THEN 0 ELSE levenshtein(a.value, e.canonical_name) END, frequency DESC, e.canonical_name) AS i FROM a{n} a JOIN e ON e.kind = a.kind AND length(a.value) >= 2
  AND (replace(a.value, ' ', '') = replace(e.canonical_name, ' ', '') OR abs(length(a.value) - length(e.canonical_name)) <= 3 AND levenshtein(a.value, e.canonical_name) <= CASE a.kind WHEN 'account' THEN 2 ELSE 4 END)),
 c{n} AS (SELECT a.kind, a.value, CASE WHEN e.canonical_name IS NOT NULL THEN a.value ELSE coalesce(v.canonical_name, z.canonical_name, a.value) END AS fixed FROM a{n} a LEFT JOIN e ON e.kind = a.kind AND e.canonical_name = a.value LEFT JOIN v ON v.kind = a.kind AND v.variant_text = a.value LEFT JOIN z{n} z ON z.kind = a.kind AND z.value = a.value AND z.i = 1),
 r{n} AS (SELECT doc_id, row_idx, col_idx, col_name, coalesce(fixed, k.value) AS value FROM k{n} k LEFT JOIN c{n} c ON c.kind = k.kind AND c.value = k.value)"""  # noqa: E731


@query(
    "entity_table_correct", None,
    f"WITH t AS ({SHEET}), e AS ({KNOWN}), v AS ({KNOWN_VARIANTS}), l1 AS (SELECT doc_id, row_idx, col_idx, col_name, {_LITERAL('value')} AS value FROM t), {_FIX('l1', 1)}, {_FIX('t', 2)} SELECT 'dictionary first' AS how, * FROM r1 UNION ALL SELECT 'names first', doc_id, row_idx, col_idx, col_name, {_LITERAL('value')} FROM r2",
)
def entity_table_correct(get) -> DataFrame:
    """Both orders of literal replacement and name correction."""
    columns = ["doc_id", "row_idx", "col_idx", "col_name", "value"]
    run = lambda first, name: tables.correct_table(get(SHEET), PAIRS, get(KNOWN), get(KNOWN_VARIANTS), first).select(F.lit(name).alias("how"), *columns)
    return run(True, "dictionary first").unionByName(run(False, "names first"))


query("learned_variants", None, f"WITH t AS ({SHEET}), e AS ({KNOWN}), v AS ({KNOWN_VARIANTS}), {_FIX('t', 1)} SELECT k.kind, k.value AS variant_text, c.fixed AS canonical_name, count(*) AS occurrence_count FROM k1 k JOIN c1 c ON c.kind = k.kind AND c.value = k.value LEFT JOIN v ON v.kind = k.kind AND v.variant_text = k.value WHERE v.kind IS NULL AND c.fixed <> k.value GROUP BY 1, 2, 3")(
    lambda get: tables.learned_variants(get(SHEET), get(KNOWN), get(KNOWN_VARIANTS))
)
CHUNK_IN = "SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_idx, 0 AS col_idx, o_orderpriority AS value FROM orders"
CHUNK_OUT = f"SELECT doc_id, row_idx, col_idx, lower(value) AS value FROM ({CHUNK_IN}) q WHERE NOT (doc_id % 3 = 0 AND row_idx % 10 = 4)"
query("chunk_accept", None, f"WITH a AS ({CHUNK_IN}), b AS ({CHUNK_OUT}), n AS (SELECT doc_id, row_idx // 5 AS k, count(DISTINCT row_idx) AS n FROM a GROUP BY 1, 2), m AS (SELECT doc_id, row_idx // 5 AS k, count(DISTINCT row_idx) AS n FROM b GROUP BY 1, 2) SELECT a.doc_id, a.row_idx, a.col_idx, CASE WHEN n.n = m.n THEN coalesce(b.value, '') ELSE a.value END AS value FROM a JOIN n ON n.doc_id = a.doc_id AND n.k = a.row_idx // 5 LEFT JOIN m ON m.doc_id = n.doc_id AND m.k = n.k LEFT JOIN b ON b.doc_id = a.doc_id AND b.row_idx = a.row_idx AND b.col_idx = a.col_idx")(
    lambda get: tables.accept_chunks(get(CHUNK_IN), get(CHUNK_OUT), 5)
)

# -- votes -------------------------------------------------------------------------------------------

RUNS = f"""SELECT doc_id, u AS run_id, row_idx, col_idx, CASE WHEN u = 1 AND col_idx = 2 THEN 'name' ELSE col_name END AS col_name, CASE WHEN (doc_id + row_idx + col_idx) % 7 = u THEN value || CAST(u AS STRING) WHEN (row_idx + col_idx) % 5 = 0 THEN substr(value, 1, length(value) - u) ELSE value END AS value
 FROM ({SHEET}) s CROSS JOIN (VALUES (0), (1), (2)) AS w(u) WHERE col_idx < 8 AND NOT (u = 2 AND doc_id % 3 = 0 AND row_idx > 2) AND NOT (u = 1 AND doc_id % 5 = 0 AND row_idx > 3) AND NOT (u = 0 AND doc_id % 4 = 0 AND col_idx = 7)"""
_BEST = lambda cols, src, value: f"(SELECT * FROM (SELECT {cols}, {value} AS value, count(*) AS n, sum(count(*)) OVER (PARTITION BY {cols}) AS total, row_number() OVER (PARTITION BY {cols} ORDER BY count(*) DESC, min(run_id)) AS i FROM {src} GROUP BY {cols}, {value}) q WHERE i = 1)"
query("consensus_table", RUNS, f""", s0 AS (SELECT doc_id, run_id, max(row_idx) + 1 AS nr, max(col_idx) + 1 AS nc FROM t GROUP BY 1, 2), s1 AS (SELECT s0.* FROM s0 JOIN {_BEST('doc_id', 's0', 'nr')} m ON m.doc_id = s0.doc_id AND m.value = nr), s2 AS (SELECT s1.* FROM s1 JOIN {_BEST('doc_id', 's1', 'nc')} m ON m.doc_id = s1.doc_id AND m.value = nc),
 k AS (SELECT t.doc_id, t.run_id, row_idx, col_idx, trim(col_name) AS col_name, trim(value) AS value FROM t JOIN s2 USING (doc_id, run_id)), w AS {_BEST('doc_id, row_idx, col_idx', 'k', 'value')}, h AS {_BEST('doc_id, col_idx', '(SELECT DISTINCT doc_id, run_id, col_idx, col_name FROM k) y', 'col_name')},
 l AS {_BEST('doc_id, row_idx, col_idx', 'k', 'length(value)')}, ch AS (SELECT k.doc_id, k.row_idx, k.col_idx, run_id, j, substr(k.value, j::INT, 1) AS ch FROM k JOIN l ON l.doc_id = k.doc_id AND l.row_idx = k.row_idx AND l.col_idx = k.col_idx AND l.value = length(k.value), LATERAL (SELECT unnest(range(1, length(k.value) + 1)) AS j) u),
 cw AS {_BEST('doc_id, row_idx, col_idx, j', 'ch', 'ch')}, tx AS (SELECT doc_id, row_idx, col_idx, string_agg(value, '' ORDER BY j) AS s FROM cw GROUP BY 1, 2, 3)
 SELECT w.doc_id, w.row_idx, w.col_idx, h.value AS col_name, CASE WHEN w.n > w.total // 2 OR w.col_idx >= 6 OR w.n >= 2 THEN w.value ELSE coalesce(tx.s, '') END AS value FROM w JOIN h USING (doc_id, col_idx) LEFT JOIN tx ON tx.doc_id = w.doc_id AND tx.row_idx = w.row_idx AND tx.col_idx = w.col_idx""")(tables.consensus_tables)
RUN_A = f"SELECT doc_id, row_idx, col_idx, CASE WHEN (row_idx + col_idx) % 3 = 0 THEN ' ' ELSE value END AS value FROM ({SHEET}) s WHERE col_idx < 5 + doc_id % 3"
RUN_B = f"SELECT doc_id, row_idx, col_idx, CASE WHEN (row_idx + col_idx) % 4 = 1 THEN 'nan' ELSE value || ' ' END AS value FROM ({SHEET}) s WHERE col_idx < 6 AND row_idx < 4"
_E = lambda s: f"trim({s}) IN ('', 'nan')"
query("merge_by_width", None, f"""WITH a AS ({RUN_A}), b AS ({RUN_B}), w AS (SELECT doc_id, coalesce(y.n > coalesce(z.n, -1), false) AS s FROM (SELECT doc_id, max(col_idx) AS n FROM b GROUP BY 1) y FULL JOIN (SELECT doc_id, max(col_idx) AS n FROM a GROUP BY 1) z USING (doc_id)),
 j AS (SELECT doc_id, row_idx, col_idx, CASE WHEN s THEN b.value ELSE a.value END AS base, CASE WHEN s THEN a.value ELSE b.value END AS aux FROM a FULL JOIN b USING (doc_id, row_idx, col_idx) JOIN w USING (doc_id))
 SELECT doc_id, row_idx, col_idx, CASE WHEN {_E('base')} AND aux IS NOT NULL AND NOT {_E('aux')} THEN trim(aux) ELSE base END AS value, {_E('base')} AND aux IS NOT NULL AND NOT {_E('aux')} AS filled FROM j WHERE base IS NOT NULL""")(lambda get: tables.merge_by_width(get(RUN_A), get(RUN_B)))

# -- what is learned ---------------------------------------------------------------------------------

TITLES = "SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN l_orderkey % 2 = 0 THEN 'demand' ELSE 'balance' END AS doc_type, '수요예측 결과 ' || CAST(l_orderkey % 5 AS STRING) || '회 title' AS title FROM lineitem"
_STOP = "('은', '는', '이', '가', '을', '를', '의', '에', '서', '도', '로', '와', '과', '으로')"
_WORDS = lambda s, weight, src: rf"SELECT doc_id, w AS keyword, {weight} AS weight FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace({s}, '[^\p{{L}}\p{{N}}_]', ' ', 'g'), '\s+')) AS w FROM {src}) q WHERE length(w) >= 2 AND w NOT IN {_STOP}"
query("keyword_fingerprint", None, f"""WITH t AS ({SHEET}), m AS ({TITLES}), f AS (SELECT doc_id, value FROM (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY min(row_idx)) AS i FROM t WHERE col_idx = 0 GROUP BY 1, 2) q WHERE i <= 20),
 e AS ({_WORDS('title', '3.0', 'm')} UNION ALL {_WORDS('col_name', '2.0', '(SELECT DISTINCT doc_id, col_idx, col_name FROM t) h')} UNION ALL {_WORDS('value', '1.0', 'f')}) SELECT doc_type, keyword, count(*) AS occurrence_count, max(weight)::DOUBLE AS weight FROM e JOIN m USING (doc_id) GROUP BY 1, 2""")(
    lambda get: learn.keyword_weights(tables.keyword_events(get(TITLES), get(SHEET), types=get(TITLES)))
)
LISTS = "hl AS (SELECT doc_id, list(name ORDER BY col_idx) AS headers FROM (SELECT DISTINCT doc_id, col_idx, trim(col_name) AS name FROM t WHERE trim(col_name) <> '' AND NOT starts_with(col_name, 'Col_')) q GROUP BY 1 HAVING count(*) >= 3)"
VARIED = f"SELECT doc_id, row_idx, col_idx, col_name, value FROM ({SHEET}) s WHERE col_idx <= 1 + doc_id % 9"
query("top_header_patterns", None, f"WITH t AS ({VARIED}), {LISTS}, m AS ({TITLES}), n AS (SELECT doc_type, array_to_string(headers, '|') AS headers, count(*) AS frequency FROM hl JOIN m USING (doc_id) GROUP BY 1, 2) SELECT doc_type, headers, frequency FROM (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY frequency DESC, headers) AS i FROM n) q WHERE i <= 3")(
    lambda get: learn.top_patterns(tables.header_lists(get(VARIED)).join(get(TITLES), "doc_id").select("doc_type", F.array_join("headers", "|").alias("headers")), "doc_type", "headers", 3)
)
query("header_overlap_share", VARIED, "SELECT doc_id, max(len(list_intersect(own, k)) / len(k)::DOUBLE) AS overlap FROM (SELECT doc_id, list(DISTINCT trim(col_name)) AS own FROM t GROUP BY 1) q, (SELECT unnest([['회사명', '부서명', '이름', '계정'], ['회사명', '총참여금액', '-100'], ['항목']]) AS k) p GROUP BY 1")(
    lambda d: tables.header_overlap(d, d.sparkSession.createDataFrame([(["회사명", "부서명", "이름", "계정"],), (["회사명", "총참여금액", "-100"],), (["항목"],)], "headers array<string>"))
)
query("feature_text", None, f"WITH t AS ({SHEET}), m AS ({TITLES}), h AS (SELECT doc_id, string_agg(col_name, ' ' ORDER BY col_idx) AS h FROM t WHERE row_idx = 0 GROUP BY 1), f AS (SELECT doc_id, string_agg(value, ' ' ORDER BY row_idx) AS f FROM t WHERE col_idx = 0 AND row_idx < 5 GROUP BY 1) SELECT doc_id, title || ' ' || doc_type || ' ' || h || ' ' || f AS text FROM m JOIN h USING (doc_id) JOIN f USING (doc_id)")(
    lambda get: tables.feature_text(get(TITLES).withColumn("info", F.array("doc_type")), get(SHEET))
)

# -- scores ------------------------------------------------------------------------------------------

EXPECTED = "SELECT CAST(o_custkey % 3 AS STRING) AS kase, CAST(o_orderkey AS INT) AS row_idx, 'L, ' || CAST(o_orderkey AS STRING) AS label, o_orderstatus AS v1, o_orderpriority AS v2, CAST(o_custkey AS STRING) AS v3 FROM orders"
ACTUAL = "SELECT CAST(o_custkey % 3 AS STRING) AS kase, CAST(o_orderkey AS INT) AS row_idx, 'L' || CAST(o_orderkey AS STRING) AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v1, o_orderpriority AS v2, CAST(o_custkey AS STRING) AS v3 FROM orders WHERE o_orderkey % 4 > 0"
_JOINED = f"""e AS ({EXPECTED}), a AS ({ACTUAL}), j AS (SELECT e.*, a.row_idx IS NOT NULL AS hit, CASE WHEN a.row_idx IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN e.v1 = a.v1 THEN 1 ELSE 0 END + CASE WHEN e.v2 = a.v2 THEN 1 ELSE 0 END + CASE WHEN e.v3 = a.v3 THEN 1 ELSE 0 END AS good FROM e LEFT JOIN a ON e.kase = a.kase AND replace(replace(e.label, ',', ''), ' ', '') = a.label)"""
_COLUMNS = ["label", "v1", "v2", "v3"]
query("eval_mismatches", None, f"""WITH {_JOINED}, m AS (SELECT *, count(*) OVER (PARTITION BY kase ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j WHERE good < 4)
 SELECT kase AS "case", label, CASE WHEN hit THEN 'differs' ELSE 'row_not_found' END AS reason FROM m WHERE NOT hit OR before < 10""")(
    lambda get: validate.mismatches(get(EXPECTED).withColumnRenamed("kase", "case"), get(ACTUAL).withColumnRenamed("kase", "case"), _COLUMNS).select("case", "label", "reason")
)
query("eval_report", None, f"""WITH {_JOINED}, c AS (SELECT kase, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS rr, round(avg(CASE WHEN good = 4 THEN 1.0 ELSE 0.0 END), 4) AS ea, round(sum(good) / (count(*) * 4.0::DOUBLE), 4) AS ca FROM j GROUP BY 1)
 SELECT count(*) AS cases, round(avg(rr), 4) AS avg_row_recall, round(avg(ea), 4) AS avg_exact_row_accuracy, round(avg(ca), 4) AS avg_cell_accuracy FROM c""")(
    lambda get: validate.averages(validate.evaluate(get(EXPECTED).withColumnRenamed("kase", "case"), get(ACTUAL).withColumnRenamed("kase", "case"), _COLUMNS))
)

query("eval_report_json", None, f"""WITH {_JOINED}, c AS (SELECT kase, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS rr, round(avg(CASE WHEN good = 4 THEN 1.0 ELSE 0.0 END), 4) AS ea, round(sum(good) / (count(*) * 4.0::DOUBLE), 4) AS ca FROM j GROUP BY 1)
 SELECT '{{"cases":' || count(*) || ',"avg_row_recall":' || round(avg(rr), 4) || ',"avg_exact_row_accuracy":' || round(avg(ea), 4) || ',"avg_cell_accuracy":' || round(avg(ca), 4) || '}}' AS report FROM c""")(
    lambda get: validate.averages(validate.evaluate(get(EXPECTED).withColumnRenamed("kase", "case"), get(ACTUAL).withColumnRenamed("kase", "case"), _COLUMNS)).select(F.to_json(F.struct("*")).alias("report"))
)
_OVERLAP = "SELECT doc_id, max(len(list_intersect(own, k)) / len(k)::DOUBLE) AS overlap FROM (SELECT doc_id, list(DISTINCT trim(col_name)) AS own FROM t GROUP BY 1) q, (SELECT unnest([['회사명', '부서명', '이름', '계정'], ['회사명', '총참여금액', '-100']]) AS k) p GROUP BY 1"
query("confidence_by_headers", None, f"""WITH t AS ({VARIED}), o AS ({_OVERLAP}), b AS (SELECT doc_id, avg(confidence) AS box FROM ({x.BOXES}) q GROUP BY 1), c AS (SELECT doc_id, avg(CASE WHEN value <> '' THEN 1.0 ELSE 0.0 END) AS fill, avg(CASE WHEN col_idx = 0 AND trim(value) <> '' THEN CASE WHEN trim(value) IN ('firm 1', 'firm 2') THEN 1.0 ELSE 0.0 END END) AS names FROM t GROUP BY 1)
 SELECT doc_id, list_sum(list_filter([box, least(fill * 1.5, 1.0), names, overlap], lambda s: s IS NOT NULL)) / len(list_filter([box, fill, names, overlap], lambda s: s IS NOT NULL)) AS confidence FROM c FULL JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)""")(
    lambda get: validate.confidence(get(x.BOXES), get(VARIED), get("SELECT 'firm 1' AS canonical_name UNION ALL SELECT 'firm 2'"), tables.header_overlap(get(VARIED), get("SELECT array('회사명', '부서명', '이름', '계정') AS headers UNION ALL SELECT array('회사명', '총참여금액', '-100')")))
)

# -- positions ---------------------------------------------------------------------------------------

PLACES = "SELECT l_orderkey AS doc_id, CAST(l_partkey % 997 AS DOUBLE) AS pos FROM lineitem"
WANTED = "SELECT DISTINCT l_orderkey AS doc_id, CAST(2 + l_orderkey % 4 AS INT) AS k FROM lineitem"
CLUSTER = """q AS (SELECT DISTINCT t.doc_id, pos, k FROM {src} t JOIN k ON k.doc_id = t.doc_id), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS m, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos AS gap FROM q),
 u AS (SELECT *, CASE WHEN gap IS NOT NULL AND row_number() OVER (PARTITION BY doc_id ORDER BY gap DESC NULLS LAST, i DESC) <= k - 1 THEN 1 ELSE 0 END AS cut FROM a WHERE m > k), v AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS idx FROM u),
 cl AS (SELECT doc_id, (i - 1)::INT AS idx, pos AS center FROM a WHERE m <= k UNION ALL SELECT doc_id, (m + n - 1)::INT, last + 100 * n FROM (SELECT doc_id, max(pos) AS last, any_value(m) AS m, any_value(k) AS k FROM a WHERE m <= k GROUP BY 1) z, LATERAL (SELECT unnest(range(1, k - m + 1)) AS n) y UNION ALL SELECT doc_id, idx, avg(pos) FROM v GROUP BY 1, 2)"""
query("cluster_positions", None, f"WITH p AS ({PLACES}), k AS ({WANTED}), {CLUSTER.format(src='p')} SELECT doc_id, idx, round(center, 6) AS center FROM cl")(lambda get: layout.cluster_positions(get(PLACES), get(WANTED)).withColumn("center", F.round("center", 6)))
CROWDED = "SELECT l_suppkey AS doc_id, CAST(100 * (l_linenumber % 5) + l_partkey % 13 AS DOUBLE) AS x_center, CAST(100 * (l_linenumber % 5) + l_partkey % 13 - 20 AS DOUBLE) AS x_min, CAST(100 * (l_linenumber % 5) + l_partkey % 13 + 20 AS DOUBLE) AS x_max FROM lineitem"
COUNTS = "SELECT DISTINCT l_suppkey AS doc_id, CAST(3 + l_suppkey % 3 AS INT) AS k FROM lineitem"
query("column_places", None, f"""WITH b AS ({CROWDED}), k AS ({COUNTS}), e AS (SELECT b.doc_id, k, min(x_center) AS lo, max(x_center) AS hi, greatest(floor((max(x_center) - min(x_center)) / greatest(avg(x_max - x_min) * 0.3, 5)), 2 * k)::INT AS nb FROM b JOIN k ON k.doc_id = b.doc_id GROUP BY 1, 2 HAVING count(*) >= k AND max(x_center) > min(x_center)),
 s AS (SELECT *, (hi - lo) / nb AS step FROM e), n AS (SELECT doc_id, floor((x_center - lo) / step)::INT AS bin, count(*) AS n FROM b JOIN s USING (doc_id) GROUP BY 1, 2), h AS (SELECT s.doc_id, k, lo, step, bins.bin, coalesce(n.n, 0) AS n FROM s, LATERAL (SELECT unnest(range(nb))::INT AS bin) bins LEFT JOIN n ON n.doc_id = s.doc_id AND n.bin = bins.bin),
 pk AS (SELECT * FROM (SELECT *, lag(n) OVER w AS l, lead(n) OVER w AS r FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY bin)) y WHERE n > 0 AND n >= l AND n >= r), tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, bin DESC) AS rk, count(*) OVER (PARTITION BY doc_id) AS f FROM pk),
 bp AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY bin) - 1)::INT AS idx, lo + bin * step + step / 2 AS center FROM tp WHERE f >= k AND rk <= k), rs AS (SELECT doc_id, x_center AS pos FROM b WHERE doc_id NOT IN (SELECT doc_id FROM bp)), {CLUSTER.format(src='rs')}
 SELECT doc_id, idx, round(center, 6) AS center FROM bp UNION ALL SELECT doc_id, idx, round(center, 6) FROM cl""")(lambda get: layout.column_places(get(CROWDED), get(COUNTS)).withColumn("center", F.round("center", 6)))
NARROW = "SELECT l_orderkey AS doc_id, l_linenumber AS idx, max(CASE WHEN l_linenumber < 3 THEN 100 + l_quantity ELSE 40 + l_quantity % 3 END) AS w FROM lineitem GROUP BY 1, 2"
query("narrow_columns_start", None, f"""WITH w AS ({NARROW}), k AS ({WANTED}), l AS (SELECT doc_id, list(w ORDER BY idx) AS w FROM w GROUP BY 1 HAVING count(*) >= 2), h AS (SELECT *, list_sort(w[len(w) // 2 + 1:]) AS r FROM l), m AS (SELECT *, r[len(r) // 2 + 1] AS med FROM h),
 s AS (SELECT m.doc_id, len(w) AS n, k, coalesce(list_max(list_filter(range(len(w)), lambda i: w[i + 1] > 1.3 * med)) + 1, 0) AS st FROM m JOIN k ON k.doc_id = m.doc_id) SELECT doc_id, CASE WHEN abs(n - st - k) > 3 THEN greatest(n - k, 0) ELSE st END::BIGINT AS start_idx FROM s""")(lambda get: layout.narrow_start(get(NARROW), get(WANTED)))
query("grid_dimensions", x.GRID, "SELECT doc_id, max(g_r) + 1 AS \"rows\", max(g_c) + 1 AS columns FROM t GROUP BY 1")(lambda d: d.groupBy("doc_id").agg((F.max("g_r") + 1).alias("rows"), (F.max("g_c") + 1).alias("columns")))

# -- what was learned and how it is used --------------------------------------------------------------

CONFIRMED = f"SELECT seq, doc_type, CASE WHEN amount % 5 = 0 THEN name END AS confirmed_type FROM ({x.LOG}) q"
query("confirmed_documents", CONFIRMED, "SELECT * FROM t WHERE confirmed_type IS NOT NULL ORDER BY seq DESC")(learn.confirmed)
FIXED = f"SELECT doc_id, row_idx, col_idx, CASE WHEN col_idx = 0 AND value = 'firm 3' THEN '한국증권' WHEN col_idx = 5 THEN value || '0' WHEN col_idx = 2 THEN ' q ' ELSE value END AS value FROM ({SHEET}) s WHERE doc_id % 4 > 0 OR row_idx > 0"
KIND_OF = r"CASE WHEN regexp_matches(b, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' WHEN regexp_matches(b, '^[0-9]+\.?[0-9]*$') THEN 'number' WHEN regexp_matches(b, '운용|증권|보험|은행|투자|자산') THEN 'company' WHEN length(a) <= 4 AND length(b) <= 4 THEN 'name' ELSE 'term' END"
query("correction_events", None, f"""WITH t AS ({SHEET}), f AS ({FIXED}), s AS (SELECT doc_id FROM (SELECT doc_id, max(row_idx) AS r, max(col_idx) AS c FROM t GROUP BY 1) x1 JOIN (SELECT doc_id, max(row_idx) AS r, max(col_idx) AS c FROM f GROUP BY 1) x2 USING (doc_id, r, c)), j AS (SELECT doc_id, trim(t.value) AS a, trim(f.value) AS b FROM t JOIN f USING (doc_id, row_idx, col_idx) JOIN s USING (doc_id))
 SELECT doc_id, a AS wrong, b AS correct, {KIND_OF} AS kind, 0.9::DOUBLE AS confidence FROM j WHERE a <> '' AND b <> '' AND a <> b AND length(a) < 50""")(lambda get: learn.correction_events(get(SHEET), get(FIXED)))
TRUTH = f"SELECT doc_id, row_idx, col_idx, CASE WHEN col_idx = 0 AND row_idx = 1 THEN 'firm one' WHEN col_idx = 3 THEN value || '!' ELSE value END AS value FROM ({SHEET}) s WHERE NOT (row_idx = 0 AND doc_id % 5 = 0)"
_DATA = lambda src, skip: f"(SELECT s.doc_id, r.row, s.col_idx, trim(s.value) AS v FROM {src} s JOIN (SELECT doc_id, row_idx, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) - 1 AS row FROM {src} WHERE col_idx = 0 AND trim(value) NOT IN {skip}) r USING (doc_id, row_idx) WHERE s.col_idx < 4)"
query("truth_corrections", None, f"WITH t AS MATERIALIZED ({SHEET}), g AS MATERIALIZED ({TRUTH}) SELECT a.doc_id, a.row::INT AS \"row\", a.col_idx, a.v AS wrong, b.v AS correct, ['company', 'department', 'name', 'account'][a.col_idx + 1] AS kind FROM {_DATA('t', IN(['', *tables.END_LABELS]))} a JOIN {_DATA('g', IN(['']))} b ON a.doc_id = b.doc_id AND a.row = b.row AND a.col_idx = b.col_idx WHERE a.v <> '' AND b.v <> '' AND a.v <> b.v")(
    lambda get: learn.against_truth(get(SHEET), get(TRUTH), tables.END_LABELS).select("doc_id", "row", "col_idx", "wrong", "correct", "kind")
)
SEEN = f"SELECT doc_type, name AS wrong, 'k' || CAST(amount % 50 AS STRING) AS correct, CASE WHEN amount % 3 = 0 THEN 'company' ELSE 'term' END AS kind FROM ({x.LOG}) q"
NAMES = "SELECT 'company' AS kind, 'k' || CAST(p_size AS STRING) AS canonical_name FROM part WHERE p_size < 30"
_LEARN = f"s AS ({SEEN}), n AS (SELECT DISTINCT kind, canonical_name AS c FROM ({NAMES}) q), l AS (SELECT s.* FROM s LEFT JOIN n a ON a.kind = s.kind AND a.c = s.wrong LEFT JOIN n b ON b.kind = s.kind AND b.c = s.correct WHERE a.c IS NULL OR b.c IS NULL)"
query("learnable_corrections", None, f"WITH {_LEARN} SELECT doc_type, wrong, correct, kind, count(*) AS n FROM l GROUP BY 1, 2, 3, 4")(lambda get: learn.learnable(get(SEEN), get(NAMES)).groupBy("doc_type", "wrong", "correct", "kind").agg(F.count(F.lit(1)).alias("n")))
CACHE = f"SELECT seq, doc_type, amount % 2 = 0 AS verified FROM ({x.LOG}) q"
query("cache_after_learning", None, f"WITH c AS ({CACHE}) SELECT seq, doc_type, verified FROM c WHERE verified OR doc_type NOT IN (SELECT doc_type FROM ({SEEN}) s WHERE wrong = 'k7' AND correct = 'k9')")(lambda get: learn.still_cached(get(CACHE), get(SEEN).where("wrong = 'k7' AND correct = 'k9'")))
DICTIONARY = f"SELECT CASE WHEN amount % 4 = 0 THEN 'default' ELSE doc_type END AS doc_type, wrong, correct, count(*) AS n, max(confidence) AS confidence FROM (SELECT doc_type, name AS wrong, 'c' || CAST(position AS STRING) AS correct, amount, confidence FROM ({x.LOG}) q) r GROUP BY 1, 2, 3"
query("correction_map", DICTIONARY, "SELECT wrong, correct FROM (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY CASE WHEN doc_type = 'default' THEN 0 ELSE 1 END, n, correct DESC) AS i FROM t WHERE confidence >= 0.5 AND doc_type IN ('click', 'default')) q WHERE i = 1")(lambda d: learn.correction_map(d, "click"))
HEAD = "## corrections"
query("correction_hints", DICTIONARY, f"""SELECT doc_type, '{HEAD}' || chr(10) || string_agg(line, chr(10) ORDER BY rn) || chr(10) AS prompt FROM (SELECT *, {len(HEAD)} + sum(length(line)) OVER (PARTITION BY doc_type ORDER BY rn) AS chars FROM (SELECT *, '- "' || wrong || '" → "' || correct || '"' AS line, row_number() OVER (PARTITION BY doc_type ORDER BY n DESC, wrong, correct) AS rn FROM t) q WHERE rn <= 20) z WHERE chars <= 300 GROUP BY 1""")(
    lambda d: learn.correction_hints(d, "doc_type", HEAD, chars=300)
)
query("header_hint", VARIED, f", {LISTS} SELECT doc_id, array_to_string(headers[1:4], ', ') || CASE WHEN len(headers) > 4 THEN ' ... (+' || (len(headers) - 4) || ')' ELSE '' END AS hint FROM hl")(lambda d: tables.header_lists(d).select("doc_id", learn.header_hint(F.col("headers"), 4).alias("hint")))
