"""Captures and specs derived from the given tables by whole-number arithmetic.

Each text is plain SQL that Spark and the checking engine evaluate alike; only input is
shared in this way, never the operator under test.
"""

from workloads.registry import plain

# Display text of an order's price, ten forms.
ORDER_TEXT = """
SELECT o_orderkey, n, CASE o_orderkey % 10
  WHEN 0 THEN '$' || CAST(n AS STRING)
  WHEN 1 THEN CAST(n AS STRING) || 'K'
  WHEN 2 THEN CAST(n AS STRING) || 'M'
  WHEN 3 THEN '(' || CAST(n AS STRING) || ')'
  WHEN 4 THEN '-' || CAST(n AS STRING)
  WHEN 5 THEN CAST(n AS STRING) || '%'
  WHEN 6 THEN CAST(n AS STRING) || '% ▲'
  WHEN 7 THEN CAST(CAST(floor(n / 1000) AS BIGINT) AS STRING) || ',' ||
              lpad(CAST(n % 1000 AS STRING), 3, '0')
  WHEN 8 THEN '–'
  ELSE 'bad ' || CAST(n AS STRING) END AS raw
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM {orders}) o
"""

# Awkward tokens around a customer number.
CUSTOMER_TEXT = """
SELECT c_custkey, k, CASE c_custkey % 18
  WHEN 0 THEN '' WHEN 1 THEN '–' WHEN 2 THEN '-' WHEN 3 THEN 'N/A' WHEN 4 THEN 'n/a'
  WHEN 5 THEN 'null' WHEN 6 THEN 'Null' WHEN 7 THEN 'bad ' || k
  WHEN 8 THEN '$(' || k || ')' WHEN 9 THEN '(-' || k || ')' WHEN 10 THEN '(' || k || '%)'
  WHEN 11 THEN k || 'K%' WHEN 12 THEN k || 'bn' WHEN 13 THEN k || ' , 3'
  WHEN 14 THEN '  ' || k || ' ' WHEN 15 THEN k || 'd' WHEN 16 THEN '€' || k || 'b'
  ELSE '(£' || k || '.5m) ' END AS raw
FROM (SELECT c_custkey, CAST(c_custkey AS STRING) AS k FROM {customer}) c
"""

# Revenue by priority and year with a published copy that is off in known places.
REVENUE = """
SELECT o_orderpriority AS priority, year(o_orderdate) AS yr,
       sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
FROM {orders} GROUP BY o_orderpriority, year(o_orderdate)
"""
PUBLISHED_REVENUE = f"""
SELECT priority, yr, CASE WHEN g = 0 THEN '$' || CAST(CAST(floor(cents * 103 / 10000) AS BIGINT) AS STRING)
            WHEN g = 2 THEN '–'
            ELSE '$' || CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING) END AS revenue
FROM (SELECT r.*, (yr + CAST(substr(priority, 1, 1) AS INT)) % 7 AS g FROM ({REVENUE}) r) p
WHERE g <> 1
"""

# Order lines as a captured grid: one visual per order, one row per line.
LINE_ROWS = """
SELECT l_orderkey AS visual_id, CAST(l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS BIGINT) AS row_no,
       CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) AS qty,
       CASE WHEN l_partkey % 9 = 0 THEN '' ELSE
            CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END AS price
FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, max(l_quantity) AS l_quantity,
             max(l_extendedprice) AS l_extendedprice
      FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber) l
"""
LINE_CELLS = f"""
SELECT visual_id, row_no, 0 AS col_no, 'Qty' AS col_name, qty AS raw FROM ({LINE_ROWS}) a
UNION ALL
SELECT visual_id, row_no, 1 AS col_no, ' Price' AS col_name, price AS raw FROM ({LINE_ROWS}) b
WHERE visual_id % 3 <> 0
"""



def line_cells(t):
    """`LINE_CELLS` without a second pass over the lines."""
    from pyspark.sql import functions as F

    price = F.when(F.col("visual_id") % 3 != 0, F.struct(
        F.lit(1).alias("col_no"), F.lit(" Price").alias("col_name"), F.col("price").alias("raw")))
    qty = F.struct(F.lit(0).alias("col_no"), F.lit("Qty").alias("col_name"),
                   F.col("qty").alias("raw"))
    return t.sql(LINE_ROWS).select(
        "visual_id", "row_no", F.inline(F.array_compact(F.array(qty, price))))


# Visuals: one per event, pages are users.
VISUALS = """
SELECT 'P' || CAST(user_id AS STRING) AS page, event_id AS ordinal,
  CASE WHEN event_type = 'signup' THEN (CASE event_id % 3 WHEN 0 THEN 'Card'
                                        WHEN 1 THEN 'Multi-row card' ELSE 'KPI' END)
       WHEN event_type = 'click' THEN 'Text box'
       WHEN event_type = 'view' THEN (CASE event_id % 4 WHEN 0 THEN 'Clustered column chart'
                WHEN 1 THEN 'Table' WHEN 2 THEN 'Stacked area chart' ELSE 'Line chart' END)
       WHEN event_type = 'purchase' THEN (CASE event_id % 3 WHEN 0 THEN 'Slicer'
                WHEN 1 THEN '' ELSE 'Map' END)
       ELSE (CASE event_id % 3 WHEN 0 THEN 'img' WHEN 1 THEN 'Donut chart' ELSE '' END) END AS type,
  CASE event_id % 11
    WHEN 0 THEN 'Sales ' || e || chr(10) || '$' || e
    WHEN 1 THEN '$' || e || chr(10) || 'axis'
    WHEN 2 THEN 'Scroll up' || chr(10) || e || chr(10) || 'Rank'
    WHEN 3 THEN 'Orders' || chr(10) || e || chr(10) || 'Margin_' || e || chr(10) || '12%'
    WHEN 4 THEN 'Orders' || chr(10) || e || chr(10) || 'Margin' || chr(10) || '12%' || chr(10) || '77' || chr(10) || '78'
    WHEN 5 THEN '▲'
    WHEN 6 THEN e || '%'
    WHEN 7 THEN 'TopN Field ' || e
    WHEN 8 THEN 'Region' || chr(10) || 'Agent Name'
    WHEN 9 THEN '  Head "' || e || '"  ' || chr(10) || chr(10) || 'body of a visual'
    ELSE '' END AS full_text,
  CAST((event_id % 8) * 200 AS DOUBLE) AS x, CAST((event_id % 23) * 40 AS DOUBLE) AS y,
  CAST(100 + (event_id % 5) * 40 AS DOUBLE) AS width, CAST(30 AS DOUBLE) AS height
FROM (SELECT user_id, event_id, event_type, CAST(event_id AS STRING) AS e FROM {events}) v
"""

# Cards: title, value and sub-figures; one visual per customer, pages are nations.
CARDS = """
SELECT 'N' || CAST(c_nationkey AS STRING) AS page, c_custkey AS ordinal,
  CASE c_custkey % 7
    WHEN 0 THEN c_mktsegment || chr(10) || k
    WHEN 1 THEN c_mktsegment || chr(10) || 'Monday, May 5' || chr(10) || 'Sum of x' || chr(10) || '$' || k || 'M'
    WHEN 2 THEN 'Overview' || chr(10) || 'Sub ' || c_mktsegment || chr(10) || k || '%'
    WHEN 3 THEN 'Overview' || chr(10) || 'Tab ' || c_mktsegment || chr(9) || k
    WHEN 4 THEN 'Last ' || c_mktsegment
    WHEN 5 THEN 'Dates ' || c_mktsegment || chr(10) || 'March ' || k || chr(10) || 'YoY up'
    ELSE 'Noise' || chr(10) || 'Sub ' || c_mktsegment END AS full_text
FROM (SELECT c_custkey, c_nationkey, c_mktsegment, CAST(c_custkey AS STRING) AS k
      FROM {customer}) c
"""

# Log lines: tests are users, markers and failures come from the event type.
LOG = """
SELECT 'T' || CAST(user_id AS STRING) AS test_id, event_id AS seq,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE WHEN event_type = 'signup' THEN 'STEP' || CAST(event_id % 9 AS STRING) || '_START|Title ' || CAST(event_id AS STRING)
       WHEN event_type = 'error' THEN 'STEP' || CAST(event_id % 9 AS STRING) || '_END'
       WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'FAIL row'
       WHEN event_type = 'click' AND event_id % 11 = 0 THEN 'E   AssertionError: x'
       ELSE 'line ' || CAST(event_id AS STRING) END AS msg
FROM {events}
"""

# Catalog: tables are part types, columns are part names; headers come from order lines.
CATALOG = """
SELECT (CASE WHEN p_type = 'PROMO' THEN 'fact_' ELSE '' END) || lower(p_type) AS "table",
       CAST(length(p_type) * 100 + ascii(p_type) AS INT) AS table_no,
       replace(p_name, ' ', '_') AS "column",
       CAST(min(p_partkey) AS INT) AS column_no,
       CASE min(p_size) % 4 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'VARCHAR(20)' WHEN 2 THEN 'DATE'
            ELSE 'DECIMAL(10,2)' END AS type
FROM {part} GROUP BY p_type, p_name
"""
HEADERS = """
SELECT l_orderkey AS visual_id, l_linenumber AS col_no,
  CASE (l_orderkey + l_partkey) % 9
    WHEN 0 THEN p_name
    WHEN 1 THEN upper(p_name)
    WHEN 2 THEN 'Total ' || p_name || ' (USD)'
    WHEN 3 THEN substr(p_name, 1, 4)
    WHEN 4 THEN substr(p_name, length(p_name) - 2, 3)
    WHEN 5 THEN 'x' || substr(p_name, length(p_name) - 3, 4) || 'zz'
    WHEN 6 THEN '%'
    WHEN 7 THEN 'q' || CAST(l_orderkey AS STRING)
    ELSE 'Average ' || p_name || ' count' END AS header
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""


def ctes(**parts: str) -> str:
    """`WITH` list of derivations for the checking engine."""
    return "WITH " + ", ".join(f"{name} AS ({plain(text)})" for name, text in parts.items())
