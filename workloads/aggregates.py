"""Source aggregates and KPI batches."""

from pyspark.sql import functions as F

from tallymark.operators.aggregate import (
    Kpi, Slicer, batch_kpis, column_aggregates, group_measures, slicer_predicate, top_k,
)
from tallymark.plans.checks import source_health
from workloads.derive import ctes
from workloads.registry import query

_PRICE_TEXT = """
SELECT CASE o_orderkey % 7 WHEN 0 THEN '1,234' WHEN 1 THEN 'n/a' ELSE CAST(n AS STRING) END AS price,
       'text ' || CAST(n AS STRING) AS words, n
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM {orders}) o
"""
_SCALARS = ["sum", "count", "avg", "min", "max"]


@query("kpi_scalar_aggs", ctes(t=_PRICE_TEXT) + """
, s AS (SELECT CAST(sum(n) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS c, CAST(min(n) AS DOUBLE) AS lo,
        CAST(max(n) AS DOUBLE) AS hi FROM t WHERE price = CAST(n AS VARCHAR))
SELECT 'price_sum' AS kpi, s AS value FROM s UNION ALL SELECT 'price_count', c FROM s
UNION ALL SELECT 'price_avg', round(s / c, 4) FROM s UNION ALL SELECT 'price_min', lo FROM s
UNION ALL SELECT 'price_max', hi FROM s UNION ALL SELECT 'words_sum', 0.0 FROM s
UNION ALL SELECT 'words_count', 0.0 FROM s UNION ALL SELECT 'words_avg', NULL FROM s
UNION ALL SELECT 'words_min', NULL FROM s UNION ALL SELECT 'words_max', NULL FROM s""")
def kpi_scalar_aggs(t):
    wide = column_aggregates(t.sql(_PRICE_TEXT), {"price": _SCALARS, "words": _SCALARS})
    return wide.unpivot([], wide.columns, "kpi", "value").withColumn("value", F.round("value", 4))


@query("kpi_batch", """
WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, year(o_orderdate) AS yr FROM orders),
     a AS (SELECT sum(cents) FILTER (yr = 1997) AS revenue_1997, sum(cents) AS revenue,
             count(DISTINCT o_custkey) FILTER (yr = 1997) AS customers_1997,
             count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities,
             round(avg(cents) FILTER (yr = 1998 AND o_orderstatus = 'F'), 3) AS average_1998_f FROM o),
     l AS (SELECT sum(l_quantity) FILTER (year(l_shipdate) = 1997) AS quantity_1997,
             max(l_discount) AS top_discount FROM lineitem)
SELECT kpi, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'revenue_1997' AS kpi, CAST(revenue_1997 AS DOUBLE) AS value FROM a UNION ALL
  SELECT 'revenue', revenue FROM a UNION ALL SELECT 'customers_1997', customers_1997 FROM a UNION ALL
  SELECT 'customers', customers FROM a UNION ALL SELECT 'priorities', priorities FROM a UNION ALL
  SELECT 'average_1998_f', average_1998_f FROM a UNION ALL
  SELECT 'quantity_1997', quantity_1997 FROM l UNION ALL SELECT 'top_discount', top_discount FROM l)""")
def kpi_batch(t):
    orders = t.orders
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    year = F.year("o_orderdate")
    selected = slicer_predicate(orders, [
        Slicer("Order date", ["1998"]), Slicer("o orderstatus", ["F"]), Slicer("Region", ["All"])])
    by_order = batch_kpis(orders, [
        Kpi("revenue_1997", "sum", cents, year == 1997),
        Kpi("revenue", "sum", cents),
        Kpi("customers_1997", "count_distinct", F.col("o_custkey"), year == 1997),
        Kpi("customers", "count_distinct", F.col("o_custkey")),
        Kpi("priorities", "count_distinct", F.col("o_orderpriority")),
        Kpi("average_1998_f", "avg", cents, selected),
    ])
    by_line = batch_kpis(t.lineitem, [
        Kpi("quantity_1997", "sum", F.col("l_quantity"), F.year("l_shipdate") == 1997),
        Kpi("top_discount", "max", F.col("l_discount")),
    ])
    return by_order.unionByName(by_line).withColumn("value", F.round("value", 3))


@query("group_measures", """
SELECT l_returnflag AS returnflag, l_linestatus AS linestatus,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS line_count
FROM lineitem GROUP BY ALL""")
def grouped(t):
    lines = t.lineitem.withColumnsRenamed(
        {"l_returnflag": "returnflag", "l_linestatus": "linestatus"})
    return group_measures(lines, ["returnflag", "linestatus"], {
        "cents": F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")),
        "quantity": F.sum(F.col("l_quantity").cast("bigint")),
        "line_count": F.count(F.lit(1)),
    })


@query("topk_products", """
SELECT p_name AS product, p_brand AS brand,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
ORDER BY cents DESC, product, brand LIMIT 10""")
def topk_products(t):
    # Lines are summed per part before the join, so a hot part joins as one row.
    by_part = t.lineitem.groupBy("l_partkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    named = by_part.join(t.part, by_part.l_partkey == F.col("p_partkey"))
    revenue = group_measures(
        named.withColumnsRenamed({"p_name": "product", "p_brand": "brand"}),
        ["product", "brand"], {"cents": F.sum("cents")})
    return top_k(revenue, "cents", ["product", "brand"], 10)


@query("slicer_filter", """
SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS order_count FROM orders
WHERE year(o_orderdate) IN (1996, 1998) AND o_orderstatus = 'F'
  AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL""")
def slicer_filter(t):
    orders = t.orders
    kept = orders.where(slicer_predicate(orders, [
        Slicer("O OrderDate", ["1996", "1998"]), Slicer("o_orderstatus", ["F"]),
        Slicer("O-OrderPriority", ["1-URGENT", "5-LOW"]), Slicer("Nothing", ["x"]),
        Slicer("o_custkey", ["All"]),
    ]))
    return kept.groupBy(F.col("o_orderpriority").alias("priority"),
                        F.year("o_orderdate").alias("yr")).agg(
        F.count(F.lit(1)).alias("order_count"))


@query("source_health", """
SELECT 'orders' AS source, count(*) > 0 AS has_rows FROM orders UNION ALL
SELECT 'late_orders', count(*) > 0 FROM orders WHERE o_orderdate > TIMESTAMP '2030-01-01' UNION ALL
SELECT 'big_lines', count(*) > 0 FROM lineitem WHERE l_quantity >= 50""")
def health_of_sources(t):
    return source_health({
        "orders": t.orders,
        "late_orders": t.orders.where(F.col("o_orderdate") > F.lit("2030-01-01").cast("timestamp_ntz")),
        "big_lines": t.lineitem.where(F.col("l_quantity") >= 50),
    })
