"""KPI, table and health checks over whole spec tables."""

from pyspark.sql import functions as F

from tallymark.plans import checks
from workloads.derive import ctes
from workloads.registry import query

# One KPI per customer: the sum of their orders, shown as text that is off for some.
_SPENT = """
SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total
FROM {orders} WHERE o_custkey % 30 <> 4 GROUP BY o_custkey
"""
_KPI_SPECS = """
SELECT c_custkey AS spec_id, CASE c_custkey % 8 WHEN 3 THEN '' WHEN 6 THEN CAST(NULL AS STRING)
    ELSE 'N' || CAST(c_nationkey AS STRING) END AS page, c_name AS visual_title,
  c_custkey % 5 = 0 AS has_sql, c_custkey % 5 <= 1 AS has_file,
  CASE c_custkey % 5 WHEN 2 THEN '1000' WHEN 3 THEN (CASE WHEN c_custkey % 2 = 0 THEN 'HOUSE' ELSE '9e' END) END
    AS expected_value,
  c_custkey % 5 = 3 AND c_custkey % 2 = 0 AS is_text, CAST(0.01 AS DOUBLE) AS tolerance
FROM {customer}
"""
_KPI_SHOWN = """
SELECT 'N' || CAST(c_nationkey AS STRING) AS page, c_name AS visual_title, 1 AS ordinal,
  CASE c_custkey % 5 WHEN 2 THEN '1K' WHEN 3 THEN 'the ' || lower(c_mktsegment) || ' segment'
    WHEN 4 THEN (CASE WHEN c_custkey % 2 = 0 THEN 'n/a' ELSE '88.1%' END)
    ELSE '$' || CAST(total * (CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END) AS STRING) END AS raw
FROM {customer} c JOIN (""" + _SPENT + """) s ON c_custkey = o_custkey
UNION ALL SELECT 'N' || CAST(c_nationkey AS STRING), c_name, 2, 'seen again'
FROM {customer} d JOIN (""" + _SPENT + """) s ON c_custkey = o_custkey WHERE c_custkey % 4 = 2
"""


@query("kpi_validate", ctes(spent=_SPENT, spec=_KPI_SPECS, shown=_KPI_SHOWN) + """
, j AS (SELECT spec.*, c_mktsegment, shown.raw, spent.total,
     CASE spec_id % 5 WHEN 0 THEN 'sql' WHEN 1 THEN 'file' WHEN 2 THEN 'expected_value'
       WHEN 3 THEN CASE WHEN spec_id % 2 = 0 THEN 'expected_text' ELSE 'expected_value' END
       ELSE 'extraction_only' END AS mode
   FROM spec JOIN customer ON c_custkey = spec_id LEFT JOIN spent ON o_custkey = spec_id
   LEFT JOIN shown ON shown.visual_title = spec.visual_title AND shown.ordinal = 1
     AND (shown.page = spec.page OR coalesce(spec.page, '') = '')),
  k AS (SELECT *, CASE WHEN raw IS NULL THEN 'not_captured'
     WHEN mode = 'expected_text' THEN CASE WHEN c_mktsegment LIKE 'HOUSE%' THEN 'match' ELSE 'mismatch' END
     WHEN spec_id % 5 = 3 THEN 'bad_expected_value'
     WHEN mode = 'extraction_only' THEN CASE WHEN spec_id % 2 = 0 THEN 'not_parsed' ELSE 'extracted' END
     WHEN mode = 'expected_value' THEN 'match'
     WHEN mode = 'file' AND spec_id % 7 = 0 THEN 'source_null'
     WHEN spec_id % 3 = 0 THEN 'mismatch' ELSE 'match' END AS status FROM j)
SELECT spec_id, mode, raw, status, status IN ('match', 'extracted') AS passed FROM k""")
def kpi_validate(t):
    spent = t.sql(_SPENT).select(F.col("o_custkey").alias("spec_id"), F.col("total").cast("double"))
    values = spent.select(
        "spec_id", F.col("total").alias("sql_value"),
        F.when(F.col("spec_id") % 7 != 0, F.col("total")).alias("file_value"))
    out = checks.validate_kpis(t.sql(_KPI_SPECS), t.sql(_KPI_SHOWN), values)
    return out.select("spec_id", "mode", "raw", "status", "passed")


# One table visual per customer; rows are orders, cells are floored prices.
_ORDER_CELLS = """
SELECT o_custkey AS visual_id, CAST(o_orderkey AS STRING) AS row_key, 0 AS col_no, 'price' AS col_name,
       CAST(floor(o_totalprice) AS BIGINT) AS n, o_orderkey
FROM {orders}
"""
_TABLE_SPECS = """
SELECT c_custkey AS visual_id,
  CASE c_custkey % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'dom' WHEN 2 THEN 'api' WHEN 3 THEN 'source'
    WHEN 4 THEN '' ELSE 'other' END AS tier,
  c_custkey % 4 <> 1 AS has_api, c_custkey % 10 <> 9 AS has_source, c_custkey % 7 <> 0 AS has_columns,
  CAST(CASE WHEN c_custkey % 11 = 0 THEN 0.5 ELSE 0.01 END AS DOUBLE) AS tolerance
FROM {customer}
"""


@query("tiered_check", ctes(c=_ORDER_CELLS, spec=_TABLE_SPECS) + """
, d AS (SELECT * FROM c WHERE visual_id % 3 <> 0 AND NOT (visual_id % 13 = 0 AND o_orderkey % 3 = 0)),
  a AS (SELECT * FROM c WHERE visual_id % 5 <> 0),
  s AS (SELECT *, CASE WHEN visual_id % 4 = 2 AND o_orderkey % 5 = 0 THEN n * 1.2 ELSE n END AS v FROM c
        WHERE visual_id % 10 <> 9 AND visual_id % 17 <> 0),
  r AS (SELECT spec.*, (SELECT count(*) FROM d WHERE d.visual_id = spec.visual_id) AS dr,
     (SELECT count(*) FROM a WHERE a.visual_id = spec.visual_id) AS ar,
     (SELECT count(*) FROM s WHERE s.visual_id = spec.visual_id) AS src_rows FROM spec),
  u AS (SELECT *, CASE
     WHEN tier IN ('auto', '', 'dom') AND dr > 0 THEN 'dom' WHEN tier = 'dom' THEN 'dom_failed'
     WHEN tier IN ('auto', '', 'api') AND has_api AND ar > 0 THEN 'api'
     WHEN tier = 'api' AND NOT has_api THEN 'api_unavailable' WHEN tier = 'api' THEN 'api_failed'
     WHEN tier IN ('auto', '', 'source') THEN CASE WHEN has_source THEN 'source' ELSE 'source_unavailable' END
     ELSE 'unknown' END AS tier_used FROM r),
  p AS (SELECT visual_id, row_key, n, 'dom' AS side FROM d UNION ALL
        SELECT visual_id, row_key, n, 'api' AS side FROM a),
  x AS (SELECT u.visual_id, p.n, s.v, p.row_key IS NOT NULL AS hp, s.row_key IS NOT NULL AS hs, u.tolerance
     FROM u JOIN c ON c.visual_id = u.visual_id
     LEFT JOIN p ON p.visual_id = c.visual_id AND p.row_key = c.row_key AND p.side = u.tier_used
     LEFT JOIN s ON s.visual_id = c.visual_id AND s.row_key = c.row_key
     WHERE u.tier_used IN ('dom', 'api') AND u.has_columns AND u.has_source),
  f AS (SELECT visual_id, count(*) FILTER (hp OR hs) AS cells, count(*) FILTER ((hp OR hs) AND NOT (hp AND hs AND
     abs(n - v) / greatest(abs(n), abs(v), 1.0) <= tolerance)) AS failed_cells FROM x GROUP BY visual_id)
SELECT u.visual_id, tier_used, CASE tier_used WHEN 'dom' THEN dr WHEN 'api' THEN ar END AS published_rows,
  src_rows, coalesce(cells, 0) AS cells, coalesce(failed_cells, 0) AS failed_cells,
  CASE WHEN tier_used = 'source' THEN src_rows > 0 WHEN tier_used NOT IN ('dom', 'api') OR NOT has_source THEN false
    ELSE CASE tier_used WHEN 'dom' THEN dr ELSE ar END = src_rows AND (NOT has_columns OR coalesce(failed_cells, 0) = 0)
  END AS passed
FROM u LEFT JOIN f ON f.visual_id = u.visual_id""")
def tiered_check(t):
    cells = t.sql(_ORDER_CELLS)
    visual = F.col("visual_id")
    shown = cells.withColumn("raw", F.concat(F.lit("$"), F.col("n").cast("string")))
    dom = shown.where((visual % 3 != 0) & ~((visual % 13 == 0) & (F.col("o_orderkey") % 3 == 0)))
    api = shown.where(visual % 5 != 0)
    source = cells.where((visual % 10 != 9) & (visual % 17 != 0)).withColumn("value", F.when(
        (visual % 4 == 2) & (F.col("o_orderkey") % 5 == 0), F.col("n") * F.lit(1.2)).otherwise(
        F.col("n").cast("double")))
    return checks.validate_tables(t.sql(_TABLE_SPECS), dom, api, source)


_PAGES = """
SELECT DISTINCT 'C' || CAST(o_custkey AS STRING) AS page, o_orderpriority AS title FROM {orders}
WHERE o_custkey % 21 <> 0
"""
_SPECS = """
SELECT c_custkey AS spec_id,
  CASE WHEN c_custkey % 10 = 7 THEN '' ELSE (CASE WHEN c_custkey % 10 = 3 THEN 'c' ELSE 'C' END) ||
    CAST(c_custkey AS STRING) END AS page,
  CASE c_custkey % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN 'Nowhere' WHEN 3 THEN ' '
    WHEN 4 THEN '5-LOW' ELSE '5-low' END AS visual_title,
  CASE WHEN c_custkey % 2 = 0 THEN 'KPI' ELSE 'Table' END AS kind
FROM {customer}
"""


@query("missing_pages", ctes(v=_PAGES, s=_SPECS) + """
SELECT DISTINCT page FROM s WHERE trim(page) <> '' AND page NOT IN (SELECT page FROM v)""")
def missing_pages(t):
    return checks.missing_pages(t.sql(_SPECS), t.sql(_PAGES))


@query("missing_visuals", ctes(v=_PAGES, s=_SPECS) + """
, w AS (SELECT spec_id, kind, CASE WHEN page = '' THEN 'C1' ELSE page END AS page, visual_title FROM s
        WHERE trim(visual_title) <> ''),
  n AS (SELECT page, count(DISTINCT title) AS available FROM v GROUP BY page)
SELECT spec_id, kind, w.page, visual_title,
  CASE WHEN n.page IS NULL THEN 'page_not_found' ELSE 'visual_not_found' END AS reason,
  coalesce(available, 0) AS available
FROM w LEFT JOIN n ON n.page = w.page
WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.page = w.page AND v.title = w.visual_title)""")
def missing_visuals(t):
    return checks.missing_visuals(t.sql(_SPECS), t.sql(_PAGES), current_page="C1")


_SLICERS = """
SELECT 'U' || CAST(user_id AS STRING) AS page, event_id AS ordinal, event_type AS slicer_title,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '2024' WHEN 2 THEN '2023|2024' ELSE 'All' END AS picked
FROM {events}
"""
_FILTERS = """
SELECT c_custkey, CASE c_custkey % 9 WHEN 4 THEN '' WHEN 7 THEN CAST(NULL AS STRING)
    ELSE 'U' || CAST(c_custkey % 180 AS STRING) END AS page,
  CASE c_custkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' WHEN 3 THEN 'error'
    ELSE '' END AS slicer_title,
  CASE c_custkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN '2024 ' WHEN 2 THEN '2023, 2024' ELSE '2022' END AS expected_value
FROM {customer}
"""
_FILTER_SQL = """
, f AS (SELECT page, slicer_title, arg_min(picked, ordinal) AS picked FROM sl GROUP BY ALL
        UNION ALL SELECT '', slicer_title, arg_min(picked, ordinal) FROM sl GROUP BY ALL),
  m AS (SELECT fi.page, fi.slicer_title, fi.expected_value, CASE WHEN f.picked IS NULL THEN NULL
      WHEN f.picked = '' THEN 'All' ELSE f.picked END AS picked
    FROM fi LEFT JOIN f ON f.page = coalesce(fi.page, '') AND f.slicer_title = fi.slicer_title WHERE fi.slicer_title <> ''),
  st AS (SELECT *, CASE WHEN picked IS NULL THEN 'not_found'
      WHEN list_contains(string_split(picked, '|'), trim(expected_value)) OR (lower(expected_value) = 'all' AND picked = 'All')
        OR replace(picked, '|', ', ') = trim(expected_value) THEN 'match' ELSE 'mismatch' END AS status FROM m)
"""


def _slicers(t):
    picked = F.when(F.col("picked") == "", F.array(F.lit("All"))).otherwise(
        F.split("picked", r"\|"))
    return t.sql(_SLICERS).withColumn("values", picked)


@query("filter_state", ctes(sl=_SLICERS, fi=_FILTERS) + _FILTER_SQL + """
SELECT page, slicer_title, expected_value, coalesce(replace(picked, '|', ', '), '') AS current, status,
       status = 'match' AS passed FROM st""")
def filter_state(t):
    return checks.filter_state(t.sql(_FILTERS), _slicers(t))


_BANNERS = """
SELECT 'D' || CAST(doc_id AS STRING) AS page, text || CASE doc_id % 9
  WHEN 0 THEN ' Access denied' WHEN 1 THEN ' Something went wrong; Access denied'
  WHEN 2 THEN ' You do not have permission. Something went wrong' WHEN 3 THEN ' access denied'
  WHEN 4 THEN ' This content is not available' ELSE '' END AS text
FROM {documents}
UNION ALL
SELECT 'H' || CAST(page_id AS STRING) AS page, html || CASE WHEN page_id % 6 = 0 THEN '<p>Something went wrong</p>'
  ELSE '' END AS text
FROM {pages}
"""
_BANNER_SQL = """
SELECT page, CASE WHEN contains(text, 'You do not have permission') THEN 'You do not have permission'
  WHEN contains(text, 'This content is not available') THEN 'This content is not available'
  WHEN contains(text, 'Access denied') THEN 'Access denied' ELSE 'Something went wrong' END AS phrase
FROM b WHERE contains(text, 'You do not have permission') OR contains(text, 'This content is not available')
  OR contains(text, 'Access denied') OR contains(text, 'Something went wrong')
"""


@query("error_banner_scan", ctes(b=_BANNERS) + _BANNER_SQL)
def error_banner_scan(t):
    return checks.error_banners(t.sql(_BANNERS))


@query("health_suite", ctes(b=_BANNERS, v=_PAGES, s=_SPECS, sl=_SLICERS, fi=_FILTERS) + _FILTER_SQL + f"""
, e AS ({_BANNER_SQL}),
  w AS (SELECT page, visual_title FROM s WHERE trim(visual_title) <> '')
SELECT 'load' AS "check", page, '' AS label, phrase AS detail FROM e
UNION ALL SELECT DISTINCT 'page', page, '', 'page_not_found' FROM s WHERE page <> '' AND page NOT IN (SELECT page FROM v)
UNION ALL SELECT 'visual', page, visual_title, CASE WHEN page = '' OR page IN (SELECT page FROM v) THEN 'visual_not_found'
  ELSE 'page_not_found' END FROM w
  WHERE NOT EXISTS (SELECT 1 FROM v WHERE (v.page = w.page OR w.page = '') AND v.title = w.visual_title)
UNION ALL SELECT 'filter', page, slicer_title, status FROM st WHERE status <> 'match'""")
def health_suite(t):
    specs = t.sql(_SPECS)
    return checks.health_suite(
        t.sql(_BANNERS), specs, specs, t.sql(_PAGES), t.sql(_FILTERS), _slicers(t))


@query("verdict_summary", """
SELECT o_orderpriority AS page, count(*) AS total, count(*) FILTER (o_orderkey % 9 <> 0) AS passed,
       count(*) FILTER (o_orderkey % 9 = 0) AS failed
FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def verdict_summary(t):
    return checks.verdict_summary(t.orders.select(
        F.col("o_orderpriority").alias("page"), (F.col("o_orderkey") % 9 != 0).alias("passed")))
