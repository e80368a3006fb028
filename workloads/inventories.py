"""Captured visuals: titles, categories, headings, cards, slicers."""

from pyspark.sql import functions as F

from tallymark.functions.classify import CHART_TYPES, is_skipped, is_testable
from tallymark.operators import visuals
from tallymark.plans import inventory
from workloads.derive import CARDS, VISUALS, ctes
from workloads.registry import query


# The types of the derived visuals by role, as the SQL sees them.
_KPIS = "('Card', 'Multi-row card', 'KPI')"
_CHARTS = "('Clustered column chart', 'Stacked area chart', 'Line chart', 'Donut chart', 'Map', 'Table')"
_SKIPPED = "('Text box', 'img', 'Slicer')"
_LABELLED = "('Clustered column chart', 'Line chart', 'Donut chart')"
_TABULAR = "('Table', 'Map')"
_HEADER_LINES = "('row selection', 'rank', 'agent id', 'agent name')"


def _noisy(c):
    return f"""({c} = '' OR regexp_matches({c}, '^[$(]') OR regexp_matches({c}, '^[\\d,.\\s%]+$')
      OR (length({c}) <= 2 AND regexp_matches({c}, '^[⇗⇘⇒⇑⇓→↑↓▲▼]'))
      OR regexp_matches({c}, '^[$(]?[\\d,.]+[KMBkmbTt%]?\\)?$')
      OR regexp_matches({c}, '^Scroll (up|down|left|right)$', 'i'))"""


# Visuals with cards taken apart, titles, noise and type index.
_EXPANDED = f""", ty AS (
  SELECT page, ordinal, x, y, width, height, trim(full_text, ' ' || chr(10) || chr(9)) AS full_text,
    [trim(l) for l in string_split(full_text, chr(10)) if trim(l) <> ''] AS lines,
    CASE WHEN type = '' AND (regexp_matches(trim(full_text), '^Scroll (up|down|left|right)', 'i') OR
           len([1 for l in string_split(full_text, chr(10))
             if lower(trim(l)) IN {_HEADER_LINES}]) > 0) THEN 'Table' ELSE type END AS type
  FROM v),
pr AS (
  SELECT ty.*, k AS sub_index, lines[2*k+1] AS label, lines[2*k+2] AS value,
    regexp_matches(lines[2*k+1], '[a-zA-Z_]') AND length(lines[2*k+1]) > 2 AND NOT {_noisy("lines[2*k+1]")}
      AND length(lines[2*k+2]) <= 50 AS good
  FROM ty, (SELECT unnest(range(0, (SELECT max(len(lines)) FROM ty) // 2 + 1)) AS k) r
  WHERE type IN ('Card', 'Multi-row card') AND len(lines) >= 4 AND k < len(lines) // 2),
ok AS (SELECT * FROM pr a WHERE good AND NOT EXISTS (SELECT 1 FROM pr b WHERE b.ordinal = a.ordinal
       AND b.sub_index < a.sub_index AND NOT b.good)),
mu AS (SELECT ordinal FROM ok GROUP BY ordinal HAVING count(*) >= 2),
ex AS (
  SELECT page, ordinal, CAST(NULL AS INT) AS sub_index, type, coalesce(lines[1], '') AS title, full_text,
    NULL AS value, x, y, width, height FROM ty WHERE ordinal NOT IN (SELECT ordinal FROM mu)
  UNION ALL SELECT page, ordinal, CAST(sub_index AS INT), type, label, label || chr(10) || value, value, x, y, width, height
  FROM ok WHERE ordinal IN (SELECT ordinal FROM mu)),
vi AS (SELECT *, {_noisy("title")} AS noisy,
  row_number() OVER (PARTITION BY page, type ORDER BY ordinal, sub_index) - 1 AS type_index FROM ex)"""

_CATEGORY = f"""CASE WHEN (type IN {_KPIS} AND (regexp_matches(title, 'TopN|BottomN|Top N|Bottom N|Parameter')
    OR (NOT regexp_matches(full_text, '[%$]|Target:|vs PM|vs PQTD|vs PTD')
        AND regexp_matches(full_text, 'TopN|BottomN|Field')))) OR contains(lower(type), 'slicer') THEN 'slicer'
  WHEN type IN {_KPIS} THEN 'kpi' WHEN type IN {_CHARTS} THEN 'chart' ELSE 'other' END"""

_HEADINGS = f""", hd AS (
  SELECT c.page, c.ordinal, arg_min(b.title, (c.y - b.y - b.height) * 1000000000 + b.ordinal) AS heading
  FROM vi c JOIN vi b ON b.page = c.page AND b.type = 'Text box' AND b.title <> ''
    AND c.y - (b.y + b.height) BETWEEN 0 AND 80
    AND greatest(0, least(c.x + c.width, b.x + b.width) - greatest(c.x, b.x)) / least(c.width, b.width) >= 0.3
  WHERE c.noisy AND c.type IN {_CHARTS} GROUP BY c.page, c.ordinal)"""


@query("visual_inventory", ctes(v=VISUALS) + _EXPANDED + _HEADINGS + f"""
SELECT vi.page, vi.ordinal, sub_index, type, title, noisy, type_index, value, heading, {_CATEGORY} AS category,
  CASE WHEN noisy OR trim(title) = '' THEN 'type_index' ELSE 'title' END AS strategy
FROM vi LEFT JOIN hd ON hd.page = vi.page AND hd.ordinal = vi.ordinal""")
def visual_inventory(t):
    return inventory.visual_inventory(t.sql(VISUALS)).select(
        "page", "ordinal", "sub_index", "type", "title", "noisy", "type_index", "value", "heading",
        "category", "strategy")


@query("heading_association", ctes(v=VISUALS) + _EXPANDED + _HEADINGS + """
SELECT page, ordinal, heading FROM hd""")
def heading_association(t):
    return visuals.headings(visuals.expand_visuals(t.sql(VISUALS)))


_BIG_CARDS = """
SELECT c_custkey, CASE c_custkey % 5
  WHEN 0 THEN c_name || chr(10) || '5' || chr(10) || c_mktsegment || chr(10) || '7' || chr(10) || 'Third' || chr(10) || '9'
  WHEN 1 THEN c_name || chr(10) || '5' || chr(10) || '77%' || chr(10) || '7' || chr(10) || 'Third' || chr(10) || '9'
  WHEN 2 THEN c_name || chr(10) || '5' || chr(10) || chr(10) || c_mktsegment || chr(10) || ' 7 ' || chr(10) || 'ab' || chr(10) || '9'
  WHEN 3 THEN c_name || chr(10) || c_mktsegment || chr(10) || 'Label' || chr(10) || lpad('9', 51, '0') || chr(10) || 'Fourth' || chr(10) || '1'
  ELSE c_name || chr(10) || '5' || chr(10) || 'tail' END AS full_text
FROM {customer}
"""


@query("card_decompose", ctes(c=_BIG_CARDS) + """
SELECT c.c_custkey, 0 AS sub_index, c_name AS label, '5' AS value FROM c JOIN customer USING (c_custkey)
  WHERE c.c_custkey % 5 IN (0, 2)
UNION ALL SELECT c.c_custkey, 1, c_mktsegment, '7' FROM c JOIN customer USING (c_custkey) WHERE c.c_custkey % 5 IN (0, 2)
UNION ALL SELECT c_custkey, 2, 'Third', '9' FROM c WHERE c_custkey % 5 = 0""")
def card_decompose(t):
    lines = visuals.lines_of(F.col("full_text"))
    return t.sql(_BIG_CARDS).select("c_custkey", F.inline(visuals.card_pairs(lines)))


_CARD_SPECS = """
SELECT DISTINCT 'N' || CAST(c_nationkey AS STRING) AS page, prefix || c_mktsegment AS visual_title
FROM {customer}, (SELECT '' AS prefix UNION ALL SELECT 'Sub ' UNION ALL SELECT 'Tab ' UNION ALL SELECT 'Last '
     UNION ALL SELECT 'Dates ') p
"""


@query("card_value", ctes(v=CARDS, s=_CARD_SPECS) + """
, k AS (SELECT 'N' || c_nationkey AS page, c_custkey, c_mktsegment AS seg, CAST(c_custkey AS VARCHAR) AS k FROM customer),
  f AS (SELECT page, CASE WHEN c_custkey % 7 IN (0, 1) THEN seg WHEN c_custkey % 7 = 2 THEN 'Sub ' || seg
       WHEN c_custkey % 7 = 3 THEN 'Tab ' || seg WHEN c_custkey % 7 = 4 THEN 'Last ' || seg ELSE 'Dates ' || seg END
         AS visual_title, c_custkey,
       CASE c_custkey % 7 WHEN 0 THEN k WHEN 1 THEN '$' || k || 'M' WHEN 2 THEN k || '%' WHEN 3 THEN k
         WHEN 4 THEN 'Last ' || seg ELSE 'March ' || k END AS raw
     FROM k WHERE c_custkey % 7 < 6)
SELECT s.page, s.visual_title, (SELECT arg_min(raw, c_custkey) FROM f WHERE f.page = s.page
   AND f.visual_title = s.visual_title) AS raw FROM s""")
def card_value(t):
    prefixes = F.array(*[F.lit(p) for p in ("", "Sub ", "Tab ", "Last ", "Dates ")])
    specs = t.customer.select(
        F.concat(F.lit("N"), "c_nationkey").alias("page"), "c_mktsegment"
    ).distinct().select("page", F.explode(F.transform(
        prefixes, lambda p: F.concat(p, "c_mktsegment"))).alias("visual_title"))
    return visuals.card_values(specs, t.sql(CARDS))


_LOCATE = """
SELECT c_custkey AS spec_id, 'P' || CAST(c_custkey % 160 AS STRING) AS page,
  CASE c_custkey % 4 WHEN 0 THEN 'Region' WHEN 1 THEN '' WHEN 2 THEN 'Sales ' || CAST(c_custkey AS STRING) ELSE ' ' END AS visual_title,
  CASE c_custkey % 3 WHEN 0 THEN 'Table' WHEN 1 THEN 'Map' ELSE '' END AS visual_type,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 13 END AS visual_index
FROM {customer}
"""


@query("locate_visual", ctes(v=VISUALS, s=_LOCATE) + _EXPANDED + """
, l AS (SELECT s.*, CASE WHEN trim(visual_title) = '' AND visual_type <> '' THEN 'type_index' ELSE 'title' END AS strategy FROM s),
  o AS (SELECT l.*, CASE WHEN strategy = 'title' THEN (SELECT min(ordinal) FROM vi WHERE vi.page = l.page AND vi.title = l.visual_title)
     ELSE (SELECT min(ordinal) FROM vi WHERE vi.page = l.page AND vi.type = l.visual_type
           AND vi.type_index = coalesce(visual_index, 0)) END AS ordinal FROM l)
SELECT spec_id, page, strategy, ordinal, ordinal IS NOT NULL AS found,
  (SELECT count(*) FROM vi WHERE vi.page = o.page AND vi.type = o.visual_type) AS available_of_type FROM o""")
def locate_visual(t):
    placed = visuals.expand_visuals(t.sql(VISUALS), indexed=True)
    return visuals.locate(t.sql(_LOCATE), placed)


@query("page_slicers", ctes(v=VISUALS) + _EXPANDED + """
SELECT page, ordinal, title AS slicer_title, CASE ordinal % 3 WHEN 0 THEN 'All' WHEN 1 THEN '2024' ELSE '2023, 2024' END
  AS selection FROM vi WHERE contains(lower(type), 'slicer') AND title <> ''""")
def page_slicers(t):
    picked = F.when(F.col("ordinal") % 3 == 1, F.array(F.lit("2024"))).when(
        F.col("ordinal") % 3 == 2, F.array(F.lit("2023"), F.lit("2024")))
    shown = visuals.expand_visuals(t.sql(VISUALS)).withColumn("selected", picked)
    return visuals.page_slicers(shown).select(
        "page", "ordinal", "slicer_title", F.array_join("values", ", ").alias("selection"))


@query("type_lists", ctes(v=VISUALS) + f"""
SELECT type, count(*) AS visuals, count(*) FILTER (type IN {_KPIS} OR type IN {_CHARTS}) AS testable,
  count(*) FILTER (type NOT IN {_SKIPPED}) AS kept,
  count(*) FILTER (type IN {_CHARTS}) AS charts FROM v GROUP BY type""")
def type_lists(t):
    kind = F.col("type")
    return t.sql(VISUALS).groupBy("type").agg(
        F.count(F.lit(1)).alias("visuals"), F.count_if(is_testable(kind)).alias("testable"),
        F.count_if(~is_skipped(kind)).alias("kept"),
        F.count_if(kind.isin(CHART_TYPES)).alias("charts"))


@query("page_titles", ctes(v=VISUALS) + _EXPANDED + """
SELECT page, ordinal, title FROM vi WHERE title <> ''""")
def page_titles(t):
    return visuals.page_titles(visuals.expand_visuals(t.sql(VISUALS)))


@query("inventory_counts", ctes(v=VISUALS) + _EXPANDED + f"""
, ca AS (SELECT page, {_CATEGORY} AS category FROM vi)
SELECT page, count(*) FILTER (category = 'kpi') AS kpis, count(*) FILTER (category = 'chart') AS charts,
  count(*) FILTER (category = 'slicer') AS slicers, count(*) AS visuals FROM ca GROUP BY ROLLUP (page)""")
def inventory_counts(t):
    return inventory.page_counts(inventory.classified(t.sql(VISUALS)))


_METHOD = f"""CASE WHEN type IN {_LABELLED} THEN 'aria'
  WHEN type IN {_TABULAR} THEN 'show_as_table' ELSE 'unknown' END"""


@query("extraction_coverage", ctes(v=VISUALS) + _EXPANDED + f"""
, ca AS (SELECT {_METHOD} AS method FROM vi WHERE {_CATEGORY} = 'chart'),
  me AS (SELECT unnest(['aria', 'show_as_table', 'unknown']) AS method)
SELECT me.method, count(ca.method) AS charts FROM me LEFT JOIN ca ON ca.method = me.method GROUP BY ALL""")
def extraction_coverage(t):
    return inventory.extraction_coverage(inventory.classified(t.sql(VISUALS)))


@query("charts_by_method", ctes(v=VISUALS) + _EXPANDED + f"""
SELECT {_METHOD} AS method, page, ordinal, CASE WHEN title = '' THEN type ELSE title END AS title
FROM vi WHERE {_CATEGORY} = 'chart'""")
def charts_by_method(t):
    return inventory.charts_by_method(inventory.classified(t.sql(VISUALS)))
