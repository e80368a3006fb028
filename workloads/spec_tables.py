"""Spec tables: clean-up, order, lint."""

from pyspark.sql import functions as F

from tallymark.plans import specs
from workloads.derive import ctes
from workloads.registry import query

_KPIS = """
SELECT c_custkey AS spec_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'N' || CAST(c_nationkey AS STRING) END AS page,
  CASE WHEN c_custkey % 6 = 0 THEN '  ' ELSE c_name END AS visual_title,
  CASE WHEN c_custkey % 3 = 0 THEN 'SELECT 1' ELSE ' ' END AS sql_query,
  CASE WHEN c_custkey % 5 = 0 THEN 'sales' END AS file_column,
  CASE WHEN c_custkey % 7 = 0 THEN '5' END AS expected_value
FROM {customer}
"""
_TABLES = """
SELECT s_suppkey + 1000000 AS spec_id, 'S' || CAST(s_nationkey AS STRING) AS page,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_name END AS visual_title, s_suppkey
FROM {supplier}
"""


def _table_specs(t):
    none = F.array().cast("array<string>")
    key = F.col("s_suppkey")
    return t.sql(_TABLES).select(
        "spec_id", "page", "visual_title",
        F.when(key % 3 == 0, none).otherwise(F.array(F.lit("region"))).alias("join_keys"),
        F.when(key % 4 == 0, F.lit(None).cast("array<string>"))
        .otherwise(F.array(F.lit("sales"))).alias("compare_cols"))


@query("spec_lint", ctes(k=_KPIS, t=_TABLES) + """
SELECT spec_id, 'kpi' AS kind, 'visual_title is empty' AS issue FROM k WHERE spec_id % 6 = 0 UNION ALL
SELECT spec_id, 'kpi', 'no source to compare with' FROM k
  WHERE spec_id % 3 <> 0 AND spec_id % 5 <> 0 AND spec_id % 7 <> 0 UNION ALL
SELECT spec_id, 'table', 'visual_title is empty' FROM t WHERE s_suppkey % 6 = 0 UNION ALL
SELECT spec_id, 'table', 'no join_keys' FROM t WHERE s_suppkey % 3 = 0 UNION ALL
SELECT spec_id, 'table', 'no compare_cols' FROM t WHERE s_suppkey % 4 = 0 UNION ALL
SELECT n_nationkey, 'dashboard', 'url is empty' FROM nation WHERE n_nationkey % 5 = 0""")
def spec_lint(t):
    dashboards = t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("spec_id"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit(" ")).otherwise(F.col("n_name")).alias("url"))
    return specs.lint(t.sql(_KPIS), _table_specs(t)).unionByName(specs.lint_dashboards(dashboards))


@query("spec_order", ctes(k=_KPIS, t=_TABLES) + """
SELECT spec_id, page, visual_title, 'KPI' AS kind FROM k WHERE trim(visual_title) <> '' UNION ALL
SELECT spec_id, page, visual_title, 'Table' FROM t WHERE visual_title IS NOT NULL""")
def spec_order(t):
    return specs.in_page_order(specs.all_specs(t.sql(_KPIS), _table_specs(t)))
