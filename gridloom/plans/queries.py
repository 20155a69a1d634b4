"""One query per operator, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as c
from ..operators import classify, entities, layout, learn, reshape, validate, votes
from . import fixtures as x

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


#: Settings of Spark under which the queries run.  HotSpot never compiles a method of more than 8000 bytes, so Spark shall cut what a fixture makes of a row into smaller ones;
#: and what is dealt by document shall not be moved again by joins of (document, row, column).  Lists are collected from sorted rows, which stay sorted for what follows, and are not made a second time to
#: ask whether they are empty before they become rows.  Shuffles start with as many partitions as the tables call for (``fixtures.frame``), of which only small ones are put together.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
            "spark.sql.execution.useObjectHashAggregateExec": "false", "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"}


def query(name: str, source: str | None = None, sql: str | None = None):
    """Register ``f(frame_of_source)`` or, without a source, ``f(get)`` with ``get(sql) -> DataFrame``."""

    def put(f):
        def run(spark, sf_dir: str) -> DataFrame:
            global v, h
            v, h = F.col("value"), F.col("header")
            for setting, value in SETTINGS.items():
                spark.conf.set(setting, value)
            spark.conf.set(x.PARTITIONS, spark.conf.get("spark.sql.shuffle.partitions"))
            return f(x.frame(spark, sf_dir, source)) if source else f(lambda s: x.frame(spark, sf_dir, s))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = f"WITH t AS ({source}) {sql}" if source else sql
        return f

    return put


v = h = None  # the columns "value" and "header"; columns need a session, so they are made at the first query
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SV, SH = STRIP.format("value"), STRIP.format("header")
PLAIN = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
TYPE = rf"""CASE WHEN {SV} = '' THEN 'text' WHEN regexp_matches({SV}, '^(₩\s*[0-9,]+|[0-9,]+\s*원)$') THEN 'currency' WHEN regexp_matches({SV}, '^[+-]?[0-9]+\.?[0-9]*\s*%$') THEN 'percent'
 WHEN regexp_matches({SV}, '^[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}$') THEN 'date' WHEN regexp_matches({SV}, '^[+-]?[0-9,]+\.?[0-9]*$') THEN 'number' ELSE 'text' END"""
BARE = r"replace(regexp_replace(regexp_replace(value, '[₩원\s]', '', 'g'), '%+$', ''), ',', '')"
PARSED = f"CASE WHEN regexp_matches({BARE}, {PLAIN}) THEN try_cast({BARE} AS DOUBLE) END"
LENIENT = f"replace({SV}, ',', '')"
SAFE = f"CASE WHEN regexp_matches({LENIENT}, {PLAIN}) THEN try_cast({LENIENT} AS DOUBLE) END"

# -- cells -------------------------------------------------------------------------------------------

query("cell_type_detect", x.VALUES, f"SELECT doc_id, {TYPE} AS cell_type FROM t")(lambda d: d.select("doc_id", c.cell_type(v).alias("cell_type")))
query("numeric_parse", x.VALUES, f"SELECT doc_id, {PARSED} AS parsed FROM t")(lambda d: d.select("doc_id", c.parse_numeric(v).alias("parsed")))
query("safe_float", x.VALUES, f"SELECT doc_id, {SAFE} AS parsed FROM t")(lambda d: d.select("doc_id", c.safe_float(v).alias("parsed")))
query("validate_cells", x.VALUES, f"SELECT doc_id, value FROM t WHERE {TYPE} IN ('currency', 'percent', 'number') AND {PARSED} IS NULL")(lambda d: validate.invalid_cells(d).select("doc_id", "value"))
SPREAD = rf"""(regexp_matches({SH}, '^Col_[0-9]+$') OR (col_idx >= 5 AND regexp_matches(regexp_replace(regexp_replace({SH}, '^[+-]+', ''), '[.%]', '', 'g'), '^[0-9]+$'))
 OR regexp_matches(regexp_replace(trim(regexp_extract({SH}, '.*\(([^)]*)\)[^()]*$', 1)), '^[+-]+|[.]', '', 'g'), '^[0-9]+$'))"""
TOTAL = "(contains(header, '총참여') OR contains(header, '참여금액'))"
query("spread_columns", x.HEADS, f"SELECT doc_id, {SPREAD} AS spread FROM t")(lambda d: d.select("doc_id", c.spread_header(h, F.col("col_idx")).alias("spread")))
query("anchor_locate", x.CELLS, "SELECT doc_id, min(CASE WHEN contains(col_name, '총참여') OR contains(col_name, '참여금액') THEN col_idx END) AS total_col, min(CASE WHEN trim(value) = '합계' AND col_idx < 6 THEN row_idx END) AS sum_row FROM t GROUP BY 1")(
    lambda d: d.groupBy("doc_id").agg(F.min(F.when(c.total_header(F.col("col_name")), F.col("col_idx"))).alias("total_col"), F.min(F.when((c.strip(v) == "합계") & (F.col("col_idx") < 6), F.col("row_idx"))).alias("sum_row"))
)
query("row_type_detect", x.FIRSTS, rf"""SELECT doc_id, CASE WHEN {SV} = '' THEN 'normal' WHEN {SV} IN ('구 분', '구분') THEN 'header' WHEN {SV} IN ('비중(%)', '비중', '누적비중(%)', '누적비중') THEN 'summary' WHEN regexp_matches({SV}, '총계|합계|소계') THEN 'subtotal'
 WHEN regexp_matches({SV}, '^\[.+\]$') THEN 'category' WHEN regexp_matches({SV}, '^[ㆍ·•-]') THEN 'detail' WHEN contains({SV}, '년') AND (contains({SV}, '월') OR contains({SV}, '기')) THEN 'period' ELSE 'normal' END AS row_type FROM t""")(
    lambda d: d.select("doc_id", c.row_type(v).alias("row_type"))
)
query("correction_type_by_header", x.HEADS, r"""SELECT doc_id, CASE WHEN regexp_matches(lower(header), '회사|기관') THEN 'company' WHEN regexp_matches(lower(header), '부서|팀') THEN 'department' WHEN regexp_matches(lower(header), '이름|성명') THEN 'name'
 WHEN regexp_matches(lower(header), '날짜|일시|참여일') THEN 'date' WHEN regexp_matches(lower(header), '금액|합계') THEN 'number' WHEN regexp_matches(regexp_replace(header, '[,-]', '', 'g'), '^[0-9]+$') THEN 'number' ELSE 'term' END AS kind FROM t""")(
    lambda d: d.select("doc_id", c.correction_kind_by_header(h, h).alias("kind"))
)
query("correction_type_by_value", x.VALUES, r"""SELECT doc_id, CASE WHEN regexp_matches(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' WHEN regexp_matches(value, '^[0-9]+\.?[0-9]*$') THEN 'number' WHEN regexp_matches(value, '운용|증권|보험|은행|투자|자산') THEN 'company'
 WHEN length(value) <= 4 THEN 'name' ELSE 'term' END AS kind FROM t""")(lambda d: d.select("doc_id", c.correction_kind_by_value(v, v).alias("kind")))
query("tokenize", "SELECT doc_id, text FROM documents", r"""SELECT doc_id, len(list_filter(w, lambda s: length(s) >= 2 AND s NOT IN ('으로')))::BIGINT AS n, list_filter(w, lambda s: length(s) >= 2)[1] AS first_token FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}_]', ' ', 'g'), '\s+') AS w FROM t) q""")(
    lambda d: d.select("doc_id", c.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.try_element_at("w", F.lit(1)).alias("first_token"))
)
query("edit_distance", "SELECT p_partkey, p_name, p_type FROM part", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance FROM t")(lambda d: d.select("p_partkey", c.jamo_distance(F.col("p_name"), F.col("p_type")).cast("long").alias("distance")))
query("content_hash", "SELECT doc_id, text FROM documents", "SELECT doc_id, sha256(text) AS content_hash FROM t")(lambda d: d.select("doc_id", F.sha2("text", 256).alias("content_hash")))
BITS = "(SELECT vec_id, embedding AS e, (list_sort(embedding)[32]::DOUBLE + list_sort(embedding)[33]::DOUBLE) / 2 AS m FROM embeddings)"


def median_bits(get) -> DataFrame:
    d = get("SELECT vec_id, embedding FROM embeddings").withColumn("s", F.sort_array("embedding"))
    m = (F.element_at("s", 32).cast("double") + F.element_at("s", 33).cast("double")) / 2
    return d.withColumn("m", m).select("vec_id", F.array_join(F.transform("embedding", lambda e: F.when(e.cast("double") > F.col("m"), "1").otherwise("0")), "").alias("bits"))


query("median_bit_hash", None, f"SELECT vec_id, array_to_string(list_transform(e, lambda y: CASE WHEN y::DOUBLE > m THEN '1' ELSE '0' END), '') AS bits FROM {BITS}")(median_bits)
FLIPPED = "SELECT vec_id + 1000000 AS id, substr(bits, 1, CAST(vec_id % 64 AS INT)) || CASE WHEN vec_id % 3 = 0 THEN '0' ELSE '1' END || substr(bits, CAST(vec_id % 64 AS INT) + 2) AS bits FROM b"
NEAR = f"""WITH b AS (SELECT vec_id, array_to_string(list_transform(e, lambda y: CASE WHEN y::DOUBLE > m THEN '1' ELSE '0' END), '') AS bits FROM {BITS}), h AS (SELECT vec_id AS id, bits::BIT AS b FROM b UNION ALL SELECT id, bits::BIT FROM ({FLIPPED}) f)
 SELECT id, nearest, distance FROM (SELECT a.id, c.id AS nearest, bit_count(xor(a.b, c.b))::BIGINT AS distance, row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.b, c.b)), c.id) AS i FROM h a JOIN h c ON a.id <> c.id WHERE bit_count(xor(a.b, c.b)) <= 5) q WHERE i = 1"""


def near_hashes(get) -> DataFrame:
    b = median_bits(get)
    b.createOrReplaceTempView("b")
    both = b.withColumnRenamed("vec_id", "id").unionByName(b.sparkSession.sql(FLIPPED))
    return entities.hamming_neighbours(both.select("id", F.expr("cast(conv(bits, 2, -10) as bigint)").alias("h")), 5)


query("hamming_similar", None, NEAR)(near_hashes)
PAGES = "SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.pdf' WHEN 3 THEN '.webp' WHEN 4 THEN '.tif' ELSE '' END AS path FROM pages"
EXT = r"lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))"
query("route_by_extension", PAGES, f"SELECT page_id, CASE WHEN {EXT} IN ('png', 'jpg', 'jpeg', 'bmp', 'tiff', 'tif', 'webp') THEN 'image' WHEN {EXT} = 'pdf' THEN 'pdf' ELSE 'unsupported' END AS route FROM t")(lambda d: d.select("page_id", c.route(F.col("path")).alias("route")))
query("mime_detect", PAGES, f"SELECT page_id, CASE WHEN {EXT} IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN {EXT} IN ('png', 'bmp', 'webp', 'gif') THEN 'image/' || {EXT} WHEN {EXT} IN ('tif', 'tiff') THEN 'image/tiff' ELSE 'image/png' END AS mime FROM t")(
    lambda d: d.select("page_id", c.mime_type(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).alias("mime"))
)
query("text_density_class", "SELECT doc_id, text FROM documents", r"SELECT doc_id, CASE WHEN avg(length(regexp_replace(p, '^\s+|\s+$', '', 'g'))) >= 50 THEN 'text' ELSE 'scan' END AS class, count(*) AS pages FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM t) q GROUP BY 1")(
    lambda d: d.select("doc_id", F.explode(F.split("text", "\n")).alias("p")).groupBy("doc_id").agg(F.when(F.avg(F.length(c.strip(F.col("p")))) >= 50, "text").otherwise("scan").alias("class"), F.count(F.lit(1)).alias("pages"))
)


# -- reshaping ---------------------------------------------------------------------------------------

query("melt_cells", "SELECT * FROM customer", """SELECT c_custkey, 'c_name' AS col_name, c_name AS value, 0 AS col_idx FROM t UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR), 1 FROM t UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, 2 FROM t""")(
    lambda d: reshape.melt(d, ["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"])
)
DROP = "(SELECT * FROM (SELECT *, max(CASE WHEN value <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, col_idx) AS ck FROM (SELECT * FROM (SELECT *, max(CASE WHEN value <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, row_idx) AS rk FROM t) a WHERE rk = 1) b) e WHERE ck = 1)"
query("drop_empty", x.RAW, f"SELECT doc_id, row_idx, col_idx, value FROM {DROP} z")(reshape.drop_empty)
query("pad_rows", "SELECT doc_id, text FROM documents", r"SELECT doc_id, array_to_string(list_transform(range(1, 5 + doc_id % 3), lambda i: coalesce(w[i], '')), '|') AS row FROM (SELECT doc_id, string_split(l, ' ') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) p) q")(
    lambda d: reshape.pad_rows(d.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).withColumn("values", F.split("l", " ")), 4 + F.col("doc_id") % 3).select("doc_id", F.array_join("values", "|").alias("row"))
)
query("header_promote", x.RAW, r"SELECT doc_id, min(row_idx) AS header_row FROM t WHERE row_idx < 10 AND (value IN ('구분', '구 분', '항목') OR regexp_matches(value, '^제[0-9]+기')) GROUP BY 1")(reshape.promote_header)
query("drop_repeated_header", x.RAW, """, h AS (SELECT doc_id, list_sort(list_distinct(list(value))) AS s FROM t WHERE row_idx = 1 GROUP BY 1), r AS (SELECT doc_id, row_idx, list_sort(list_distinct(list(value))) AS s FROM t GROUP BY 1, 2)
 SELECT t.* FROM t JOIN r USING (doc_id, row_idx) LEFT JOIN h ON h.doc_id = t.doc_id WHERE h.s IS NULL OR h.s <> r.s""")(lambda d: reshape.drop_repeated_header(d, d.where("row_idx = 1").select("doc_id", F.col("value").alias("name"))))
query("header_interpolate", "SELECT user_id AS doc_id, CAST(event_id AS INT) AS col_idx, CASE WHEN event_id % 3 = 0 THEN value END AS num FROM events", """, k AS (SELECT *, max(CASE WHEN num IS NOT NULL THEN col_idx END) OVER (PARTITION BY doc_id ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS li, min(CASE WHEN num IS NOT NULL THEN col_idx END) OVER (PARTITION BY doc_id ORDER BY col_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ri FROM t)
 SELECT k.doc_id, k.col_idx, round(coalesce(k.num, l.num + (r.num - l.num) * (k.col_idx - k.li) / (k.ri - k.li)), 6) AS num FROM k LEFT JOIN t l ON l.doc_id = k.doc_id AND l.col_idx = k.li LEFT JOIN t r ON r.doc_id = k.doc_id AND r.col_idx = k.ri""")(
    lambda d: reshape.interpolate_headers(d).withColumn("num", F.round("num", 6))
)
query("split_merge_join", None, "SELECT o_orderkey, o_orderstatus, coalesce(c_name, '') AS c_name, coalesce(c_mktsegment, '') AS c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 2000")(
    lambda get: get("SELECT o_orderkey, o_custkey AS k, o_orderstatus FROM orders").join(get("SELECT c_custkey AS k, c_name, c_mktsegment FROM customer WHERE c_acctbal > 2000"), "k", "left").fillna("", ["c_name", "c_mktsegment"]).drop("k")
)
query("chunk_rows", x.RAW, "SELECT doc_id % 50 AS grp, CAST(floor(doc_id / 30) AS BIGINT) AS chunk, count(*) AS n FROM t GROUP BY 1, 2")(lambda d: d.groupBy((F.col("doc_id") % 50).alias("grp"), reshape.chunk_of(F.col("doc_id")).alias("chunk")).agg(F.count(F.lit(1)).alias("n")))
query("chunk_serialize", x.RAW, "SELECT doc_id, row_idx, string_agg(value, chr(9) ORDER BY col_idx) AS line FROM t GROUP BY 1, 2")(
    lambda d: d.groupBy("doc_id", "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda s: s["value"]), "\t").alias("line"))
)
query("head_tail_sample", "SELECT o_custkey, o_orderkey FROM orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM t) q WHERE n <= 5 OR n > c - 2")(
    lambda d: reshape.head_tail(d, ["o_custkey"], ["o_orderkey"], 5, 2)
)

# -- geometry ----------------------------------------------------------------------------------------

query("row_group_chained", x.BOXES, """SELECT doc_id, box_id, CAST(sum(g) OVER (PARTITION BY doc_id ORDER BY y_center, box_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS row_no FROM (SELECT *, CASE WHEN y_center - lag(y_center) OVER (PARTITION BY doc_id ORDER BY y_center, box_id) < 20 THEN 0 ELSE 1 END AS g FROM t) q""")(
    lambda d: layout.rows_chained(d, 20).select("doc_id", "box_id", "row_no")
)
query("row_group_anchored", x.BOXES, """, s AS (SELECT doc_id, box_id, y_center, row_number() OVER (PARTITION BY doc_id ORDER BY y_center, box_id) AS i FROM t),
 f AS (WITH RECURSIVE z AS (SELECT doc_id, i, box_id, y_center AS y, 0 AS row_no FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, s.box_id, CASE WHEN s.y_center - z.y > 15 THEN s.y_center ELSE z.y END, CASE WHEN s.y_center - z.y > 15 THEN z.row_no + 1 ELSE z.row_no END FROM z JOIN s ON s.doc_id = z.doc_id AND s.i = z.i + 1) SELECT * FROM z)
 SELECT doc_id, box_id, row_no FROM f""")(lambda d: layout.rows_anchored(d, 15))
POS = "SELECT DISTINCT l_suppkey % 50 AS doc_id, CAST(l_partkey % 997 AS DOUBLE) AS pos FROM lineitem"
query("gap_cluster", POS, """, a AS (SELECT *, row_number() OVER w AS i, lead(pos) OVER w - pos AS gap FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), b AS (SELECT *, CASE WHEN gap IS NOT NULL AND row_number() OVER (PARTITION BY doc_id ORDER BY gap DESC NULLS LAST, i DESC) <= 4 THEN 1 ELSE 0 END AS cut FROM a),
 e AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cluster FROM b) SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, round(avg(pos), 6) AS center, count(*) AS n FROM e GROUP BY 1, 2""")(
    lambda d: layout.gap_clusters(d, 5).withColumn("center", F.round("center", 6)).withColumn("cluster", F.col("cluster").cast("long"))
)
XPOS = "SELECT l_suppkey % 50 AS doc_id, CAST(l_partkey % 997 AS DOUBLE) AS pos FROM lineitem"
query("histogram_peaks", XPOS, """, e AS (SELECT doc_id, min(pos) AS lo, max(pos) AS hi, (max(pos) - min(pos)) / 16 AS step FROM t GROUP BY 1 HAVING max(pos) > min(pos)), s AS (SELECT e.*, b FROM e, (SELECT unnest(range(16))::INT AS b) r),
 n AS (SELECT doc_id, floor((pos - lo) / step)::INT AS b, count(*) AS n FROM t JOIN e USING (doc_id) GROUP BY 1, 2), g AS (SELECT s.doc_id, s.b, lo, step, coalesce(n.n, 0) AS n FROM s LEFT JOIN n ON s.doc_id = n.doc_id AND s.b = n.b),
 p AS (SELECT *, lag(n) OVER w AS l, lead(n) OVER w AS r FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY b)), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, b DESC) AS rk FROM p WHERE n > 0 AND n >= l AND n >= r) SELECT doc_id, b AS bin, n, round(lo + step * (b + 0.5), 6) AS center FROM k WHERE rk <= 3""")(
    lambda d: layout.histogram_peaks(d, 16, 3).withColumn("center", F.round("center", 6))
)
CENTERS = "SELECT DISTINCT l_orderkey AS doc_id, CAST(100 * l_linenumber + 25 AS DOUBLE) AS center FROM lineitem"
query("column_assign", None, f"WITH t AS ({x.BOXES}), c AS ({CENTERS}), m AS (SELECT doc_id, (center + lead(center) OVER (PARTITION BY doc_id ORDER BY center)) / 2 AS m FROM c) SELECT t.doc_id, t.box_id, count(CASE WHEN x_center > m.m THEN 1 END)::INT AS col_no FROM t LEFT JOIN m ON t.doc_id = m.doc_id GROUP BY 1, 2")(
    lambda get: layout.assign_columns(get(x.BOXES), get(CENTERS)).select("doc_id", "box_id", "col_no")
)
query("merge_close", "SELECT l_orderkey AS doc_id, CAST(l_partkey % 200 AS INT) AS pos FROM lineitem", """, s AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM t),
 f AS (WITH RECURSIVE z AS (SELECT doc_id, i, pos, 0 AS idx FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, CASE WHEN s.pos - z.pos > 30 THEN s.pos ELSE (z.pos + s.pos) // 2 END, CASE WHEN s.pos - z.pos > 30 THEN z.idx + 1 ELSE z.idx END FROM z JOIN s ON s.doc_id = z.doc_id AND s.i = z.i + 1) SELECT * FROM z)
 SELECT doc_id, idx, max_by(pos, i) AS pos FROM f GROUP BY 1, 2""")(lambda d: layout.merge_close(d, 30))
query("projection_threshold", x.BOXES, ", p AS (SELECT doc_id, x_center AS line, sum(box_id + 1) AS dark FROM t GROUP BY 1, 2) SELECT doc_id, line, CAST(dark AS BIGINT) AS dark FROM p WHERE dark > 0.3 * (SELECT max(q.dark) FROM p q WHERE q.doc_id = p.doc_id)")(
    lambda d: layout.over_share_of_max(d.groupBy("doc_id", F.col("x_center").alias("line")).agg(F.sum(F.col("box_id") + 1).alias("dark")), "dark", 0.3, "doc_id")
)
query("uniform_width_suffix", "SELECT l_orderkey AS doc_id, l_linenumber AS idx, max(l_quantity) AS w FROM lineitem GROUP BY l_orderkey, l_linenumber", ", m AS (SELECT doc_id, list_sort(list(w))[len(list(w)) // 2 + 1] AS median FROM t GROUP BY 1) SELECT m.doc_id, m.median, CAST(coalesce(max(CASE WHEN w > 1.3 * median THEN idx END), -1) + 1 AS BIGINT) AS start_idx FROM m JOIN t USING (doc_id) GROUP BY 1, 2")(
    layout.uniform_suffix
)


def grid(get) -> DataFrame:
    return get(x.GRID).withColumnsRenamed({"g_r": "row", "g_c": "col"})


BG = f"WITH b AS ({x.BOXES}), g AS ({x.GRID}), "
IN = "x_center BETWEEN gx_min AND gx_max AND y_center BETWEEN gy_min AND gy_max"
D2 = "(x_center - (gx_min + gx_max) / 2) * (x_center - (gx_min + gx_max) / 2) + (y_center - (gy_min + gy_max) / 2) * (y_center - (gy_min + gy_max) / 2)"
query("box_cell_assign", None, BG + f"""r AS (SELECT b.doc_id, box_id, text, g_r, g_c, row_number() OVER (PARTITION BY b.doc_id, box_id ORDER BY CASE WHEN {IN} THEN 0 ELSE 1 END, CASE WHEN {IN} THEN 0 ELSE {D2} END, g_r, g_c) AS k FROM b JOIN g ON b.doc_id = g.doc_id)
 SELECT doc_id, g_r AS "row", g_c AS col, string_agg(text, ' ' ORDER BY box_id) AS value FROM r WHERE k = 1 GROUP BY 1, 2, 3""")(lambda get: layout.boxes_to_cells(get(x.BOXES), grid(get)))
query("box_cell_smallest", None, BG + f'r AS (SELECT b.doc_id, box_id, g_r, g_c, row_number() OVER (PARTITION BY b.doc_id, box_id ORDER BY (gx_max - gx_min) * (gy_max - gy_min), g_r, g_c) AS k FROM b JOIN g ON b.doc_id = g.doc_id AND {IN}) SELECT doc_id, box_id, g_r AS "row", g_c AS col FROM r WHERE k = 1')(
    lambda get: layout.boxes_to_smallest(get(x.BOXES), grid(get))
)
query("box_cell_overlap", None, BG + """r AS (SELECT b.doc_id, box_id, text, g_r, g_c, (least(x_max, gx_max) - greatest(x_min, gx_min)) AS dx, (least(y_max, gy_max) - greatest(y_min, gy_min)) AS dy FROM b JOIN g ON b.doc_id = g.doc_id), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g_r, g_c ORDER BY dx * dy DESC, box_id) AS n FROM r WHERE dx > 0 AND dy > 0)
 SELECT doc_id, g_r AS "row", g_c AS col, box_id, text AS value FROM k WHERE n = 1""")(lambda get: layout.cells_by_overlap(get(x.BOXES), grid(get)))
query("box_standardize", x.BOXES, "SELECT doc_id, box_id, x_min, x_max, y_min, y_max, (x_min + x_max) / 2 AS x_center, (y_min + y_max) / 2 AS y_center FROM t WHERE confidence >= 0.55")(lambda d: standard_boxes(d))


def standard_boxes(d: DataFrame) -> DataFrame:
    """Polygons to boxes; those of low confidence are dropped."""
    corners = d.withColumn("p", F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))])).where("confidence >= 0.55")
    xs, ys = F.transform("p", lambda s: s["x"]), F.transform("p", lambda s: s["y"])
    e = corners.select("doc_id", "box_id", F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"))
    return e.withColumn("x_center", (F.col("x_min") + F.col("x_max")) / 2).withColumn("y_center", (F.col("y_min") + F.col("y_max")) / 2)

# -- names -------------------------------------------------------------------------------------------

query("variant_lookup_join", None, f"WITH a AS ({x.VARIANTS}), l AS ({x.VARIANT_LOG}), b AS (SELECT variant_text, canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY variant_text ORDER BY occurrence_count DESC, canonical_name) AS n FROM l) q WHERE n = 1) SELECT a.value, b.canonical_name FROM a LEFT JOIN b ON a.value = b.variant_text")(
    lambda get: entities.lookup_variants(get(x.VARIANTS), get(x.VARIANT_LOG)).select("value", "canonical_name")
)
FUZZY = "p AS (SELECT value, canonical_name, frequency, CASE WHEN replace(value, ' ', '') = replace(canonical_name, ' ', '') THEN 0 ELSE levenshtein(value, canonical_name) END AS d FROM a JOIN e ON length(value) >= 2 AND (replace(value, ' ', '') = replace(canonical_name, ' ', '') OR abs(length(value) - length(canonical_name)) <= 3)), w AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY d, frequency DESC, canonical_name) AS n FROM p WHERE d <= 2)"
query("fuzzy_entity_match", None, f"WITH a AS ({x.VARIANTS}), e AS ({x.ENTITIES}), {FUZZY} SELECT value, canonical_name, d::BIGINT AS distance FROM w WHERE n = 1")(lambda get: entities.fuzzy_match(get(x.VARIANTS), get(x.ENTITIES), 2, lambda x: x))
query("entity_correct", None, f"""WITH v AS ({x.VARIANTS}), e AS ({x.ENTITIES}), l AS ({x.VARIANT_LOG}), b AS (SELECT variant_text, canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY variant_text ORDER BY occurrence_count DESC, canonical_name) AS n FROM l) q WHERE n = 1),
 a AS (SELECT v.value FROM v LEFT JOIN e ON v.value = e.canonical_name LEFT JOIN b ON v.value = b.variant_text WHERE e.canonical_name IS NULL AND b.variant_text IS NULL), {FUZZY}
 SELECT v.value, CASE WHEN e.canonical_name IS NOT NULL THEN v.value ELSE coalesce(b.canonical_name, w.canonical_name, v.value) END AS corrected, CASE WHEN e.canonical_name IS NOT NULL THEN 'known' WHEN b.canonical_name IS NOT NULL THEN 'variant' WHEN w.canonical_name IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS tier
 FROM v LEFT JOIN e ON v.value = e.canonical_name LEFT JOIN b ON v.value = b.variant_text LEFT JOIN w ON w.value = v.value AND w.n = 1""")(lambda get: entities.correct(get(x.VARIANTS), get(x.ENTITIES), get(x.VARIANT_LOG), 2, lambda x: x))
query("dictionary_replace", "SELECT p_partkey, p_type FROM part", "SELECT p_partkey, replace(replace(replace(p_type, 'STEEL', 'IRON'), 'IRON', 'Fe'), 'BRASS', 'CuZn') AS fixed FROM t")(lambda d: d.select("p_partkey", entities.replace_all(F.col("p_type"), [("STEEL", "IRON"), ("IRON", "Fe"), ("BRASS", "CuZn")]).alias("fixed")))
BEFORE = "SELECT o_orderkey AS r, o_orderstatus AS value FROM orders"
AFTER = "SELECT o_orderkey AS r, CASE o_orderkey % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 9 > 0"
DIFF = f"SELECT b.r, b.value AS original, a.value AS corrected FROM ({BEFORE}) b JOIN ({AFTER}) a ON a.r = b.r WHERE b.value <> '' AND a.value <> '' AND a.value <> b.value"
query("cell_diff", None, DIFF)(lambda get: entities.cell_diff(get(BEFORE), get(AFTER), ["r"]))
query("learn_corrections", None, f"SELECT original, corrected, count(*) AS n FROM ({DIFF}) q WHERE NOT (original IN ('F') AND corrected IN ('Z')) GROUP BY 1, 2")(
    lambda get: entities.cell_diff(get(BEFORE), get(AFTER), ["r"]).where("NOT (original IN ('F') AND corrected IN ('Z'))").groupBy("original", "corrected").agg(F.count(F.lit(1)).alias("n"))
)
query("groundtruth_diff", None, "WITH g AS (SELECT c_nationkey AS k, c_name AS value, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer WHERE c_mktsegment <> 'MACHINERY'), o AS (SELECT c_nationkey AS k, c_mktsegment AS value, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) SELECT g.k, g.n, o.value AS original, g.value AS corrected FROM g JOIN o ON g.k = o.k AND g.n = o.n WHERE g.value <> o.value")(
    lambda get: entities.cell_diff(*(get(f"SELECT c_nationkey AS k, {col} AS value, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer WHERE {cond}") for col, cond in (("c_mktsegment", "true"), ("c_name", "c_mktsegment <> 'MACHINERY'"))), ["k", "n"])
)
query("corrections_anti_join", x.LOG, "SELECT doc_type, name, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.name = t.name AND u.position = 16 AND u.confidence >= 0.9 AND u.amount > 25000) GROUP BY 1, 2")(
    lambda d: d.join(d.where("position = 16 AND confidence >= 0.9 AND amount > 25000").select("name").distinct(), "name", "left_anti").groupBy("doc_type", "name").agg(F.count(F.lit(1)).alias("n"))
)
query("cache_lookup", None, "SELECT d.doc_id, min(e.doc_id) AS cached_by, count(e.doc_id) AS hits FROM documents d LEFT JOIN documents e ON sha256(d.text) = sha256(e.text) AND e.doc_id < d.doc_id GROUP BY 1")(lambda get: cached(get("SELECT doc_id, text FROM documents")))


def cached(d: DataFrame) -> DataFrame:
    """For each document the earlier ones of equal content: counted by a window over hashes, so texts do not move."""
    from pyspark.sql import Window as W

    k = d.select("doc_id", F.sha2("text", 256).alias("k"))
    n = (F.row_number().over(W.partitionBy("k").orderBy("doc_id")) - 1).cast("long")
    return k.withColumn("hits", n).withColumn("first", F.min("doc_id").over(W.partitionBy("k"))).select("doc_id", F.when(F.col("hits") > 0, F.col("first")).alias("cached_by"), "hits")


query("cache_upsert", x.LOG, "SELECT name, max_by(amount, seq) AS amount, count(*) AS n FROM t GROUP BY 1")(lambda d: entities.latest(d, ["name"], "seq", "amount"))


# -- votes and merges --------------------------------------------------------------------------------

VOTE = "n AS (SELECT cell, value, count(*) AS n, min(pos) AS p FROM t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, p) AS r, sum(n) OVER (PARTITION BY cell) AS total FROM n)"
query("consensus_vote", x.RUNS, f", {VOTE} SELECT cell, value, n AS votes, CAST(total AS BIGINT) AS total, n > floor(total / 2) AS majority FROM k WHERE r = 1")(lambda d: votes.vote(d, ["cell"]))
FEW = "SELECT event_id % 4000 AS cell, event_id AS pos, substr(event_type, 1, CAST(3 + event_id % 3 AS INT)) || CAST(user_id % 10 AS STRING) AS value FROM events"
query("char_vote", FEW, f""", {VOTE}, l AS (SELECT cell, length(value) AS len, count(*) AS n, min(pos) AS p FROM t GROUP BY 1, 2), b AS (SELECT cell, len FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, p) AS r FROM l) q WHERE r = 1),
 ch AS (SELECT t.cell, t.pos, i AS idx, substr(value, i::INT, 1) AS value FROM t JOIN b ON t.cell = b.cell AND length(value) = len, LATERAL (SELECT unnest(range(1, len + 1)) AS i) u), cn AS (SELECT cell, idx, value, count(*) AS n, min(pos) AS p FROM ch GROUP BY 1, 2, 3),
 cw AS (SELECT *, row_number() OVER (PARTITION BY cell, idx ORDER BY n DESC, p) AS r FROM cn), s AS (SELECT cell, string_agg(value, '' ORDER BY idx) AS s FROM cw WHERE r = 1 GROUP BY 1) SELECT k.cell, CASE WHEN k.n >= 2 THEN k.value ELSE s.s END AS value FROM k JOIN s USING (cell) WHERE r = 1""")(lambda d: votes.vote_characters(d, ["cell"]))


BASE = "SELECT o_orderkey AS r, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS value FROM orders"
AUX = "SELECT o_orderkey AS r, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS value FROM orders WHERE o_orderkey % 7 > 0"
query("merge_fill_empty", None, f"SELECT b.r, CASE WHEN b.value = '' AND coalesce(a.value, '') <> '' THEN a.value ELSE b.value END AS value, b.value = '' AND coalesce(a.value, '') <> '' AS filled FROM ({BASE}) b LEFT JOIN ({AUX}) a ON a.r = b.r")(lambda get: votes.fill_empty(get(BASE), get(AUX), ["r"]))
API = "SELECT p_partkey AS r, CAST(p_size % 6 AS INT) AS ci, CASE p_partkey % 3 WHEN 0 THEN '금액' ELSE '회사' END AS col_name, CASE p_partkey % 4 WHEN 0 THEN p_name ELSE p_name || '!' END AS value FROM part"
LOCAL = "SELECT p_partkey AS r, CASE p_partkey % 6 WHEN 0 THEN '1,234' WHEN 3 THEN 'n/a' ELSE p_name END AS value FROM part"
query("merge_arbitrate", None, f"""WITH a AS ({API}), l AS ({LOCAL}), e AS (SELECT DISTINCT canonical_name FROM ({x.ENTITIES}) q) SELECT a.r, CASE WHEN col_name = '금액' THEN CASE WHEN regexp_matches(regexp_replace(l.value, '[,.-]', '', 'g'), '^[0-9]+$') THEN l.value ELSE a.value END
 WHEN ci < 4 AND l.value IN (SELECT canonical_name FROM e) AND a.value NOT IN (SELECT canonical_name FROM e) THEN l.value ELSE a.value END AS value FROM a LEFT JOIN l ON a.r = l.r""")(
    lambda get: votes.arbitrate(get(API), get(LOCAL), get(x.ENTITIES), ["r"], F.col("col_name"), F.col("ci"))
)
ENGINES = "SELECT user_id AS doc_id, CAST(event_id % 4 AS INT) AS rank, event_id, CAST((event_id % 100) / 100.0 AS DOUBLE) AS confidence FROM events"
query("engine_fallback_select", ENGINES, ", u AS (SELECT doc_id, rank, max_by(event_id, event_id) AS event_id, max_by(confidence, event_id) AS confidence FROM t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN confidence >= 0.8 THEN 0 ELSE 1 END, CASE WHEN confidence >= 0.8 THEN rank ELSE -rank END) AS n FROM u) SELECT doc_id, rank, event_id, confidence FROM k WHERE n = 1")(
    lambda d: votes.first_confident(d.groupBy("doc_id", "rank").agg(F.max_by("event_id", "event_id").alias("event_id"), F.max_by("confidence", "event_id").alias("confidence")), ["doc_id"], "rank", "confidence", 0.8)
)

# -- checks and learned state ------------------------------------------------------------------------

NUMS = f"n AS (SELECT doc_id, row_idx, col_idx, CASE WHEN regexp_matches(replace(trim(value), ',', ''), {PLAIN}) THEN try_cast(replace(trim(value), ',', '') AS DOUBLE) END AS num, col_idx >= 6 AS spread, col_idx = 5 AS total, trim(value) = '합계' AS lab FROM t)"
query("control_totals", x.CELLS, f""", {NUMS}, s AS (SELECT doc_id, min(CASE WHEN lab THEN row_idx END) AS sr FROM n GROUP BY 1), d AS (SELECT n.*, sr FROM n JOIN s USING (doc_id)),
 w AS (SELECT doc_id, row_idx, max(CASE WHEN total THEN num END) AS want, coalesce(sum(CASE WHEN spread THEN num END), 0) AS got FROM d WHERE row_idx < sr GROUP BY 1, 2),
 c AS (SELECT doc_id, col_idx, any_value(sr) AS row_idx, max(CASE WHEN row_idx = sr THEN num END) AS want, coalesce(sum(CASE WHEN row_idx < sr THEN num END), 0) AS got FROM d WHERE spread GROUP BY 1, 2)
 SELECT d.doc_id, d.row_idx, d.col_idx, 'row' AS rule FROM d JOIN w USING (doc_id, row_idx) WHERE d.spread AND d.num <> 0 AND want <> 0 AND abs(got - want) > 0.01 UNION ALL SELECT doc_id, row_idx, col_idx, 'column' FROM c WHERE abs(got - want) > 0.01""")(validate.control_totals)
query("processing_stats", x.LOG, "SELECT doc_type, count(*) AS total, count(*) FILTER (WHERE confidence >= 0.8) AS confident, CAST(sum(amount) AS BIGINT) AS amount FROM t GROUP BY 1")(
    lambda d: d.groupBy("doc_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("confidence") >= 0.8).alias("confident"), F.sum("amount").alias("amount"))
)
query("column_stats", x.LOG, "SELECT doc_type, name, min(amount) AS min_val, max(amount) AS max_val, round(avg(amount), 6) AS mean_val, count(amount) AS n FROM t GROUP BY 1, 2")(lambda d: learn.column_stats(d, ["doc_type", "name"], "amount").withColumn("mean_val", F.round("mean_val", 6)))
query("column_template", x.LOG, """, s AS (SELECT doc_type, name, position, row_number() OVER (PARTITION BY doc_type, name ORDER BY seq) AS i FROM t), f AS (WITH RECURSIVE z AS (SELECT doc_type, name, i, position::BIGINT AS p FROM s WHERE i = 1 UNION ALL SELECT s.doc_type, s.name, s.i, (z.p + s.position) // 2 FROM z JOIN s ON s.doc_type = z.doc_type AND s.name = z.name AND s.i = z.i + 1) SELECT * FROM z)
 SELECT doc_type, name, max(i) AS frequency, max_by(p, i) AS position FROM f GROUP BY 1, 2""")(lambda d: learn.column_positions(d, ["doc_type", "name"]))
query("metadata_latest", x.LOG, "SELECT doc_type, name, max_by(amount, seq) AS amount, count(*) AS n FROM t GROUP BY 1, 2")(lambda d: entities.latest(d, ["doc_type", "name"], "seq", "amount"))
CORR = "SELECT doc_type, name AS wrong, 'c' || CAST(position AS STRING) AS correct, CAST(position AS STRING) AS kind, confidence, seq FROM (" + x.LOG + ") q"
query("correction_dictionary", CORR, "SELECT doc_type, wrong, correct, count(*) AS n, max(confidence) AS confidence, min_by(kind, seq) AS kind FROM t GROUP BY 1, 2, 3 HAVING max(confidence) >= 0.5")(learn.corrections)
query("entity_frequency", x.LOG, "SELECT name, count(*) AS frequency FROM t GROUP BY 1")(lambda d: d.groupBy("name").agg(F.count(F.lit(1)).alias("frequency")))
query("daily_quota", "SELECT ts FROM events", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, count(*) < 20 - 5 AS allowed FROM t GROUP BY 1")(lambda d: learn.daily_quota(d, "ts", 20, 5).withColumn("day", F.col("day").cast("string")))
query("extraction_confidence", None, f"""WITH b AS (SELECT doc_id, avg(confidence) AS box FROM ({x.BOXES}) q GROUP BY 1), c AS (SELECT doc_id, avg(CASE WHEN value <> '' THEN 1.0 ELSE 0.0 END) AS fill, avg(CASE WHEN col_idx = 0 AND trim(value) <> '' THEN CASE WHEN value IN ('name 0', 'name 1') THEN 1.0 ELSE 0.0 END END) AS names, max(col_idx) + 1 AS cols FROM ({x.CELLS}) q GROUP BY 1)
 SELECT doc_id, list_sum(list_filter([box, least(fill * 1.5, 1.0), names, CASE WHEN cols < 5 THEN 0.1 WHEN cols < 8 THEN 0.4 WHEN cols > 15 THEN 0.5 END], lambda s: s IS NOT NULL)) / len(list_filter([box, fill, names, CASE WHEN cols < 8 OR cols > 15 THEN 1.0 END], lambda s: s IS NOT NULL)) AS confidence FROM c FULL JOIN b USING (doc_id)""")(
    lambda get: validate.confidence(get(x.BOXES), get(x.CELLS), get("SELECT 'name 0' AS canonical_name UNION ALL SELECT 'name 1'"))
)
query("recent_documents", x.LOG, "SELECT doc_type, name, seq FROM t ORDER BY seq DESC LIMIT 20")(lambda d: d.select("doc_type", "name", "seq").orderBy(F.desc("seq")).limit(20))
query("budgeted_topk", x.LOG, ", c AS (SELECT doc_type, name, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY n DESC, name) AS rn FROM c), s AS (SELECT *, 20 + sum(length(name) + 6) OVER (PARTITION BY doc_type ORDER BY rn) AS chars FROM r WHERE rn <= 20) SELECT doc_type, name, n, rn, CAST(chars AS BIGINT) AS chars FROM s WHERE chars <= 120")(
    lambda d: learn.within_budget(d.groupBy("doc_type", "name").agg(F.count(F.lit(1)).alias("n")), "doc_type", [F.desc("n"), F.col("name")], F.concat(F.col("name"), F.lit(" -> ok")), 20, 120, 20)
)
query("prompt_hints", x.LOG, ", c AS (SELECT doc_type, name, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY n DESC, name) AS rn FROM c) SELECT doc_type, '## ' || doc_type || chr(10) || string_agg('- ' || name, chr(10) ORDER BY rn) AS prompt FROM r WHERE rn <= 5 GROUP BY 1")(
    lambda d: learn.top_patterns(d, "doc_type", "name", 5).groupBy("doc_type").agg(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "name"))).alias("l")).select("doc_type", F.concat(F.lit("## "), "doc_type", F.lit("\n"), F.array_join(F.transform("l", lambda s: F.concat(F.lit("- "), s["name"])), "\n")).alias("prompt"))
)
query("header_overlap", None, "SELECT s_suppkey, len(list_intersect(string_split(s_name, '#'), ['Supplier', '000000001'])) / 2.0::DOUBLE AS overlap FROM supplier")(
    lambda get: get("SELECT s_suppkey, s_name FROM supplier").select("s_suppkey", (F.size(F.array_intersect(F.split("s_name", "#"), F.array(F.lit("Supplier"), F.lit("000000001")))) / 2).alias("overlap"))
)
query("keyword_rule_class", "SELECT doc_id, text FROM documents", "SELECT doc_id, CASE WHEN contains(text, 'thing') OR contains(text, 'that') THEN 'a' WHEN contains(text, 'que') THEN 'b' ELSE 'c' END AS doc_type, CASE WHEN contains(text, 'thing') OR contains(text, 'that') OR contains(text, 'que') THEN 0.8 ELSE 0.3 END AS confidence FROM t")(
    lambda d: d.select("doc_id", classify.by_rule(F.col("text"), [("a", ["thing", "that"]), ("b", ["que"])], "c").alias("k")).select("doc_id", "k.doc_type", "k.confidence")
)
query("keyword_score_class", "SELECT doc_id, text FROM documents", """, s AS (SELECT doc_id, CASE WHEN contains(text, 'thing') THEN 3.0 ELSE 0 END + CASE WHEN contains(text, 'that') THEN 1.5 ELSE 0 END AS a, CASE WHEN contains(text, 'que') THEN 2.0 ELSE 0 END + CASE WHEN contains(text, 'eau') THEN 1.5 ELSE 0 END AS b FROM t)
 SELECT doc_id, CASE WHEN a + b = 0 THEN 'a' WHEN a >= b THEN 'a' ELSE 'b' END AS doc_type, CASE WHEN a + b = 0 THEN 0.3 ELSE least((greatest(a, b) / (a + b))::DOUBLE, 0.99) END AS confidence FROM s""")(
    lambda d: classify.by_score(d, [("a", "thing", 3.0), ("a", "that", 1.5), ("b", "que", 2.0), ("b", "eau", 1.5)], ["a", "b"], "a")
)
query("tfidf_ngrams", "SELECT p_partkey AS doc_id, p_name AS text FROM part", """, w AS (SELECT doc_id, ' ' || w || ' ' AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM t) q WHERE w <> ''), g AS (SELECT doc_id, substr(w, i::INT, n::INT) AS gram FROM w, (SELECT unnest([2, 3, 4]) AS n) k, LATERAL (SELECT unnest(range(1, length(w) - n + 2)) AS i) u),
 c AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY 1, 2), d AS (SELECT gram, sum(tf) AS total, count(*) AS df FROM c GROUP BY 1 ORDER BY total DESC, gram LIMIT 3000) SELECT doc_id, gram, round((1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM t)) / (1.0 + df)) + 1), 6) AS weight FROM c JOIN d USING (gram)""")(lambda d: classify.tfidf(d).withColumn("weight", F.round("weight", 6)))
query("classifier_model")(lambda get: trained(get("SELECT p_partkey AS doc_id, p_type AS text, substr(p_type, 1, 3) AS label, p_size <= 35 AS learned FROM part")))


def trained(d: DataFrame) -> DataFrame:
    """Learned from the smaller parts; all are classified, so the larger ones show what it does with documents it has not seen."""
    model = classify.Classifier.fit(d.where("learned"), "label")
    return d.select("doc_id", "label", "learned").join(model.predict(d), "doc_id").withColumn("confidence", F.round("confidence", 3))


EXPECTED = "SELECT CAST(o_custkey % 3 AS STRING) AS case, CAST(o_orderkey AS INT) AS row_idx, 'L, ' || CAST(o_orderkey AS STRING) AS label, o_orderstatus AS v1, o_orderpriority AS v2 FROM orders"
ACTUAL = "SELECT CAST(o_custkey % 3 AS STRING) AS case, CAST(o_orderkey AS INT) AS row_idx, 'L' || CAST(o_orderkey AS STRING) AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v1, o_orderpriority AS v2 FROM orders WHERE o_orderkey % 4 > 0"
query("table_eval", None, f"""WITH e AS ({EXPECTED.replace(" AS case", ' AS "case"')}), a AS ({ACTUAL.replace(" AS case", ' AS "case"')}), j AS (SELECT e."case", a.row_idx IS NOT NULL AS hit, CASE WHEN a.row_idx IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN e.v1 = a.v1 THEN 1 ELSE 0 END + CASE WHEN e.v2 = a.v2 THEN 1 ELSE 0 END AS good
 FROM e LEFT JOIN a ON e."case" = a."case" AND replace(replace(e.label, ',', ''), ' ', '') = a.label) SELECT "case", round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS row_recall, round(avg(CASE WHEN good = 3 THEN 1.0 ELSE 0.0 END), 4) AS exact_row_accuracy, round(sum(good) / (count(*) * 3.0::DOUBLE), 4) AS cell_accuracy FROM j GROUP BY 1""")(
    lambda get: validate.evaluate(get(EXPECTED.replace(" AS case", " AS `case`")), get(ACTUAL.replace(" AS case", " AS `case`")), ["label", "v1", "v2"])
)


# -- compositions ------------------------------------------------------------------------------------

META = "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS title, c_mktsegment AS a, CAST(c_nationkey AS STRING) AS b FROM customer"
query("metadata_block", META, """SELECT doc_id, 0 AS "row", 0 AS col, title AS value FROM t WHERE title IS NOT NULL UNION ALL SELECT doc_id, CASE WHEN title IS NULL THEN 0 ELSE 1 END, 0, 'segment' FROM t UNION ALL SELECT doc_id, CASE WHEN title IS NULL THEN 0 ELSE 1 END, 1, a FROM t
 UNION ALL SELECT doc_id, CASE WHEN title IS NULL THEN 1 ELSE 2 END, 0, 'nation' FROM t UNION ALL SELECT doc_id, CASE WHEN title IS NULL THEN 1 ELSE 2 END, 1, b FROM t UNION ALL SELECT doc_id, CASE WHEN title IS NULL THEN 0 ELSE 1 END, 4, 'key' FROM t UNION ALL SELECT doc_id, CASE WHEN title IS NULL THEN 0 ELSE 1 END, 5, b FROM t""")(
    lambda d: reshape.metadata_block(d.select("doc_id", "title", F.array(*[F.struct(F.lit(n).alias("label"), F.col(k).alias("value")) for n, k in (("segment", "a"), ("nation", "b"))]).alias("info"), F.array(F.struct(F.lit("key").alias("label"), F.col("b").alias("value"))).alias("market")))
)
query("split_merge_positional", None, "WITH l AS (SELECT o_custkey AS k, o_orderkey AS r, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), q AS (SELECT o_custkey AS k, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 4 > 0) SELECT l.k, l.r, o_orderstatus, o_orderpriority FROM l JOIN q ON l.k = q.k AND l.n = q.n")(
    lambda get: reshape.join_by_position(get("SELECT o_custkey AS k, o_orderkey AS r, o_orderstatus FROM orders"), get("SELECT o_custkey AS k, o_orderkey AS r, o_orderpriority FROM orders WHERE o_orderkey % 4 > 0"), "k", ["r"])
)
