"""KPI checks from spec rows that name a source, a column and an aggregate, slicers, or a query."""

from pyspark.sql import functions as F

from tallymark.plans import kpis
from workloads.derive import ctes
from workloads.registry import query

_FIGURES = """
SELECT 0 AS k, 'customer' AS source, ' C_CustKey' AS col, 'sum' AS agg,
  (SELECT CAST(sum(c_custkey) AS BIGINT) FROM {customer}) AS v
UNION ALL SELECT 1, 'Orders', 'o_orderkey', 'COUNT', (SELECT count(o_orderkey) FROM {orders})
UNION ALL SELECT 2, 'orders', 'o_custkey', 'max', (SELECT CAST(max(o_custkey) AS BIGINT) FROM {orders})
UNION ALL SELECT 3, 'orders', 'o_orderpriority', 'count_distinct', (SELECT count(DISTINCT o_orderpriority) FROM {orders})
"""
_SPECS = """
SELECT p_partkey AS spec_id, CASE WHEN p_partkey % 6 = 1 THEN '' ELSE 'P' END AS page,
  'part ' || CAST(p_partkey AS STRING) AS visual_title, CASE WHEN p_partkey % 5 = 0 THEN 'file' ELSE 'SQL' END AS origin,
  source, CASE WHEN p_partkey % 7 = 0 THEN 'nope' ELSE col END AS `column`, agg, CAST(NULL AS STRING) AS expected_value,
  false AS is_text, CAST(0.01 AS DOUBLE) AS tolerance, v
FROM {part} JOIN (""" + _FIGURES + """) f ON p_partkey % 4 = k
"""
_SHOWN = """
SELECT 'P' AS page, visual_title, n AS ordinal, CASE n WHEN 1 THEN '$' || CAST(v * (CASE WHEN spec_id % 3 = 0 THEN 2 ELSE 1 END)
  AS STRING) ELSE '0' END AS raw
FROM (""" + _SPECS + """) s JOIN (SELECT 1 AS n UNION ALL SELECT 2) t ON n <= spec_id % 2 + 1 WHERE spec_id % 11 <> 0
"""


@query("kpi_spec_check", ctes(s=_SPECS.replace("`column`", '"column"')) + """
SELECT spec_id, lower(origin) AS mode, CASE WHEN spec_id % 11 = 0 THEN 'not_captured' WHEN spec_id % 7 = 0 THEN 'source_null'
  WHEN spec_id % 3 = 0 AND v > 0 THEN 'mismatch' ELSE 'match' END AS status,
  spec_id % 11 <> 0 AND spec_id % 7 <> 0 AND NOT (spec_id % 3 = 0 AND v > 0) AS passed,
  CASE WHEN spec_id % 7 <> 0 THEN CAST(v AS DOUBLE) END AS source
FROM s""")
def kpi_spec_check(t):
    frames = {"orders": t.orders, "customer": t.customer}
    return kpis.check_kpis(t.sql(_SPECS).drop("v"), t.sql(_SHOWN), {"sql": frames, "file": frames}).select(
        "spec_id", "mode", "status", "passed", "source")


# Slicers by spec: none, one status, two statuses, a year, two years and a status, one customer, nothing that is there.
_SLICED = """
SELECT p_partkey AS spec_id, 'P' AS page, 'part ' || CAST(p_partkey AS STRING) AS visual_title,
  CASE p_partkey % 6 WHEN 1 THEN 'o_orderkey' WHEN 4 THEN 'o_orderpriority' ELSE 'o_custkey' END AS col,
  CASE p_partkey % 6 WHEN 0 THEN 'sum' WHEN 1 THEN 'count' WHEN 2 THEN 'max' WHEN 3 THEN 'avg' ELSE 'count_distinct' END AS agg,
  CASE p_partkey % 7 WHEN 1 THEN 'F' WHEN 2 THEN 'F,O' WHEN 4 THEN 'O' WHEN 6 THEN 'none' END AS statuses,
  CASE p_partkey % 7 WHEN 3 THEN '1997' WHEN 4 THEN '1996,1998' END AS years,
  CASE p_partkey % 7 WHEN 5 THEN CAST(p_partkey AS STRING) END AS customer
FROM {part}
"""


@query("kpi_slicer_check", ctes(s=_SLICED) + """
, c AS (SELECT DISTINCT col, agg, statuses, years, customer FROM s),
  m AS (SELECT c.*, o.* FROM c LEFT JOIN orders o
    ON (statuses IS NULL OR list_contains(string_split(statuses, ','), o_orderstatus))
    AND (years IS NULL OR list_contains(string_split(years, ','), CAST(year(o_orderdate) AS VARCHAR)))
    AND (customer IS NULL OR CAST(customer AS BIGINT) = o_custkey)),
  v AS (SELECT col, agg, statuses, years, customer, CASE agg
    WHEN 'sum' THEN coalesce(CAST(sum(o_custkey) AS DOUBLE), 0) WHEN 'count' THEN CAST(count(o_orderkey) AS DOUBLE)
    WHEN 'max' THEN CAST(max(o_custkey) AS DOUBLE) WHEN 'avg' THEN CAST(sum(o_custkey) AS DOUBLE) / nullif(count(o_custkey), 0)
    WHEN 'count_distinct' THEN CAST(CASE col WHEN 'o_custkey' THEN count(DISTINCT o_custkey)
      ELSE count(DISTINCT o_orderpriority) END AS DOUBLE) END AS value FROM m GROUP BY col, agg, statuses, years, customer)
SELECT spec_id, 'sql' AS mode, CASE WHEN value IS NULL THEN 'source_null' WHEN spec_id % 5 <> 0 OR value = 0 THEN 'match'
  ELSE 'mismatch' END AS status, value IS NOT NULL AND (spec_id % 5 <> 0 OR value = 0) AS passed, round(value, 6) AS source
FROM s LEFT JOIN v ON s.col = v.col AND s.agg = v.agg AND s.statuses IS NOT DISTINCT FROM v.statuses
  AND s.years IS NOT DISTINCT FROM v.years AND s.customer IS NOT DISTINCT FROM v.customer""")
def kpi_slicer_check(t):
    asked = t.sql(_SLICED)
    specs = asked.select(
        "spec_id", "page", "visual_title", F.lit("sql").alias("origin"), F.lit("orders").alias("source"),
        F.col("col").alias("column"), "agg", F.lit(None).cast("string").alias("expected_value"),
        F.lit(False).alias("is_text"), F.lit(0.01).alias("tolerance"))
    slicers = asked.select("spec_id", F.inline(F.array(*[
        F.struct(F.lit(title).alias("title"), F.split(c, ",").alias("values"))
        for title, c in (("Order Status", "statuses"), ("Order date", "years"), ("CustKey", "customer"))
    ]))).where("values IS NOT NULL").unionByName(asked.select(
        "spec_id", F.lit("Priority").alias("title"), F.array(F.lit("All")).alias("values")))
    sources = {"sql": {"orders": t.orders}}
    # What is shown is the value itself, doubled for every fifth spec.
    shown = kpis.spec_values(specs, sources, slicers).select(
        F.lit("P").alias("page"), F.concat(F.lit("part "), F.col("spec_id").cast("string")).alias("visual_title"),
        F.lit(1).alias("ordinal"), F.format_string("%.6f", F.coalesce("sql_value", F.lit(1.0)) * F.when(
            F.col("spec_id") % 5 == 0, 2).otherwise(1)).alias("raw"))
    return kpis.check_kpis(specs, shown, sources, filters=slicers).select(
        "spec_id", "mode", "status", "passed", F.round("source", 6).alias("source"))


_TEXTS = """
SELECT p_partkey AS spec_id, 'P' AS page, 'part ' || CAST(p_partkey AS STRING) AS visual_title, CASE p_partkey % 12
  WHEN 0 THEN 'SELECT sum(o_custkey) FROM orders_src WHERE o_orderkey > 99'
  WHEN 1 THEN 'select SUM(o_custkey) from orders_src where o_orderkey > 99;'
  WHEN 2 THEN 'SELECT count(DISTINCT o_custkey) AS n FROM orders_src WHERE extract(year FROM o_orderdate) = 1997'
  WHEN 3 THEN 'SELECT o_custkey FROM orders_src WHERE o_orderkey < 0'
  WHEN 4 THEN 'SELECT max(o_custkey) FROM orders_src WHERE o_orderkey < 0'
  WHEN 5 THEN 'SELECT o_custkey, o_orderkey FROM orders_src'
  WHEN 6 THEN 'SELEC 1' WHEN 7 THEN 'SELECT count(*) FROM no_such_table'
  WHEN 8 THEN 'SELECT count(*) / (count(*) - count(o_orderkey)) FROM orders_src'
  WHEN 9 THEN 'SELECT max(o_orderstatus) FROM orders_src' WHEN 10 THEN 'DROP VIEW orders_src' ELSE ' ' END AS sql_query
FROM {part}
"""


@query("kpi_query_check", ctes(s=_TEXTS) + """
, v AS (SELECT CAST(sum(o_custkey) FILTER (o_orderkey > 99) AS DOUBLE) AS f,
    CAST(count(DISTINCT o_custkey) FILTER (year(o_orderdate) = 1997) AS DOUBLE) AS n,
    CAST(max(o_custkey) AS DOUBLE) AS m FROM orders)
SELECT spec_id, CASE WHEN spec_id % 12 = 11 THEN 'file' ELSE 'sql' END AS mode,
  CASE WHEN spec_id % 12 IN (0, 1, 2) THEN CASE WHEN spec_id % 5 = 0 THEN 'mismatch' ELSE 'match' END
    WHEN spec_id % 12 IN (3, 4) THEN 'source_null' WHEN spec_id % 12 = 11 THEN CASE WHEN m = 7 THEN 'match' ELSE 'mismatch' END
    ELSE 'query_failed' END AS status,
  CASE spec_id % 12 WHEN 0 THEN f WHEN 1 THEN f WHEN 2 THEN n WHEN 11 THEN m END AS source,
  CASE spec_id % 12 WHEN 5 THEN 'NOT_ONE_COLUMN' WHEN 6 THEN 'PARSE_SYNTAX_ERROR' WHEN 7 THEN 'TABLE_OR_VIEW_NOT_FOUND'
    WHEN 8 THEN 'DIVIDE_BY_ZERO' WHEN 9 THEN 'CAST_INVALID_INPUT' WHEN 10 THEN 'PARSE_SYNTAX_ERROR' END AS error
FROM s, v""")
def kpi_query_check(t):
    specs = t.sql(_TEXTS).withColumns({
        "origin": F.lit("file"), "source": F.lit("orders"), "column": F.lit("o_custkey"), "agg": F.lit("max"),
        "expected_value": F.lit(None).cast("string"), "is_text": F.lit(False), "tolerance": F.lit(0.01)})
    figures = t.sql("SELECT CAST(sum(o_custkey) FILTER (WHERE o_orderkey > 99) AS STRING) AS f, CAST(count(DISTINCT "
                    "o_custkey) FILTER (WHERE year(o_orderdate) = 1997) AS STRING) AS n FROM {orders}")
    kind = F.col("spec_id") % 12
    shown = specs.select("page", "visual_title", F.lit(1).alias("ordinal"), "spec_id").join(figures).select(
        "page", "visual_title", "ordinal", F.when((F.col("spec_id") % 5 == 0) & (kind < 3), "3").when(
            kind < 2, F.col("f")).when(kind == 2, F.col("n")).otherwise("7").alias("raw"))
    found = kpis.check_kpis(specs, shown, {"file": {"orders": t.orders}}, views={"orders_src": t.orders})
    return found.select("spec_id", "mode", "status", "source", F.when(
        F.col("status") == "query_failed", F.col("detail")).alias("error"))
