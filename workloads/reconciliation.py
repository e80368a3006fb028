"""Datasets against their sources: by key, by position, by count."""

from pyspark.sql import functions as F

from tallymark.functions.numbers import comparison_detail
from tallymark.operators import align
from workloads.derive import LINE_CELLS, PUBLISHED_REVENUE, REVENUE, ctes, line_cells
from workloads.registry import query

_STATUS = """
CASE WHEN NOT p THEN 'missing_in_published' WHEN NOT s THEN 'missing_in_source'
     WHEN published IS NULL AND source IS NULL THEN 'both_null'
     WHEN published IS NULL THEN 'published_null' WHEN source IS NULL THEN 'source_null'
     WHEN abs(published - source) / greatest(abs(published), abs(source), 1.0) <= 0.01 THEN 'match'
     ELSE 'mismatch' END
"""


@query("reconcile_keyed", ctes(src=REVENUE, pub=PUBLISHED_REVENUE) + f"""
, j AS (SELECT coalesce(pub.priority, src.priority) AS priority, coalesce(pub.yr, src.yr) AS yr,
     pub.priority IS NOT NULL AS p, src.priority IS NOT NULL AS s,
     CASE WHEN revenue = '–' THEN NULL ELSE CAST(substr(revenue, 2) AS DOUBLE) END AS published,
     floor(cents / 100) AS source
   FROM pub FULL JOIN src ON pub.priority = src.priority AND pub.yr = src.yr)
SELECT priority, CAST(yr AS INT) AS yr, 'revenue' AS measure, published, source, {_STATUS} AS status,
       {_STATUS} IN ('match', 'both_null') AS passed
FROM j""")
def reconcile_keyed(t):
    source = t.sql(REVENUE).select(
        "priority", "yr", F.floor(F.col("cents") / 100).alias("Revenue "))
    cells = align.reconcile(t.sql(PUBLISHED_REVENUE), source, ["Priority", "Yr"], ["Revenue"],
                            0.01, duplicates="flag")
    return cells.drop("occurrence", "rel_diff")


_LINES = """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, l_partkey FROM {lineitem}
"""
_PUBLISHED_LINES = f"""
SELECT l_orderkey, l_linenumber, quantity FROM (
  SELECT l_orderkey, l_linenumber, quantity + CASE WHEN l_partkey % 13 = 0 THEN 10 ELSE 0 END AS quantity
  FROM ({_LINES}) l WHERE l_partkey % 17 <> 0) p
"""


@query("reconcile_duplicates", ctes(src=_LINES, pub=_PUBLISHED_LINES) + f"""
, a AS (SELECT l_orderkey, l_linenumber, quantity, row_number() OVER (
          PARTITION BY l_orderkey, l_linenumber ORDER BY quantity) AS occurrence FROM pub),
  b AS (SELECT l_orderkey, l_linenumber, quantity, row_number() OVER (
          PARTITION BY l_orderkey, l_linenumber ORDER BY quantity) AS occurrence FROM src),
  j AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS ok, coalesce(a.l_linenumber, b.l_linenumber) AS ln,
     coalesce(a.occurrence, b.occurrence) AS occurrence, a.l_orderkey IS NOT NULL AS p,
     b.l_orderkey IS NOT NULL AS s, CAST(a.quantity AS DOUBLE) AS published, CAST(b.quantity AS DOUBLE) AS source
   FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
     AND a.occurrence = b.occurrence)
SELECT ok AS l_orderkey, ln AS l_linenumber, occurrence, published,
       source, {_STATUS} AS status, {_STATUS} IN ('match', 'both_null') AS passed FROM j""")
def reconcile_duplicates(t):
    published = t.sql(_PUBLISHED_LINES).select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("$"), F.col("quantity").cast("string")).alias("quantity"))
    cells = align.reconcile(published, t.sql(_LINES), ["l_orderkey", "l_linenumber"], ["quantity"])
    return cells.drop("measure", "rel_diff")


_ACCOUNTS = """
SELECT 'N' || CAST(c_nationkey AS STRING) AS nation, c_name AS name, c_custkey,
       CAST(floor(c_acctbal) AS BIGINT) AS balance
FROM {customer}
"""
_PUBLISHED_ACCOUNTS = f"""
SELECT nation, name, CAST(CASE WHEN c_custkey % 10 = 3 THEN balance + 500 ELSE balance END AS STRING) AS balance
FROM ({_ACCOUNTS}) a WHERE NOT (nation IN ('N3', 'N7') AND c_custkey % 8 = 1)
"""


@query("reconcile_positional", ctes(src=_ACCOUNTS, pub=_PUBLISHED_ACCOUNTS) + f"""
, a AS (SELECT nation, name, CAST(balance AS DOUBLE) AS published, row_number() OVER (
          PARTITION BY nation ORDER BY name, balance) AS position FROM pub),
  b AS (SELECT nation, CAST(balance AS DOUBLE) AS source, row_number() OVER (
          PARTITION BY nation ORDER BY name, balance) AS position FROM src),
  j AS (SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.position, b.position) AS position, name,
     a.nation IS NOT NULL AS p, b.nation IS NOT NULL AS s, published, source
   FROM a FULL JOIN b ON a.nation = b.nation AND a.position = b.position)
SELECT nation, position, name, published, source, {_STATUS} AS status,
       {_STATUS} IN ('match', 'both_null') AS passed FROM j""")
def reconcile_positional(t):
    cells = align.reconcile(
        t.sql(_PUBLISHED_ACCOUNTS), t.sql(_ACCOUNTS).drop("c_custkey"), ["name"], ["balance"],
        visual=["nation"], align="positional")
    return cells.drop("measure", "rel_diff")


_SPEND = """
SELECT o_orderpriority AS priority, o_custkey AS custkey,
       sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
FROM {orders} GROUP BY o_orderpriority, o_custkey
"""
_PUBLISHED_SPEND = f"""
SELECT priority, custkey, CASE WHEN custkey % 97 = 5 THEN cents * 2 ELSE cents END AS cents
FROM ({_SPEND}) s WHERE custkey % 89 <> 7
"""


_SPEND_SQL = """
, j AS (SELECT src.priority, src.custkey, pub.cents AS published, src.cents AS source,
     CASE WHEN pub.cents IS NULL THEN 'missing_in_published' WHEN pub.cents = src.cents THEN 'match'
          ELSE 'mismatch' END AS status
   FROM src LEFT JOIN pub ON src.priority = pub.priority AND src.custkey = pub.custkey)
"""


def _spend_cells(t):
    published = t.sql(_PUBLISHED_SPEND).withColumn("cents", F.col("cents").cast("string"))
    return align.reconcile(published, t.sql(_SPEND), ["custkey"], ["cents"],
                           visual=["priority"], duplicates="flag")


@query("reconcile_summary", ctes(src=_SPEND, pub=_PUBLISHED_SPEND) + _SPEND_SQL + """
SELECT priority, count(*) AS cells, count(*) FILTER (status <> 'match') AS failed_cells,
   count(*) FILTER (status <> 'match') = 0 AS passed
FROM j GROUP BY priority""")
def reconcile_summary(t):
    return align.summarise_cells(_spend_cells(t), ["priority"])


@query("failure_details", ctes(src=_SPEND, pub=_PUBLISHED_SPEND) + _SPEND_SQL + """
SELECT priority, custkey, CASE WHEN published IS NULL
  THEN '[' || custkey || '] failed: nothing shown, expected ' || source || '.0000'
  ELSE '[' || custkey || '] failed: shown ' || published || ', read as ' || published || '.0000, expected ' || source ||
    '.0000, off by 50.0000% of at most 1.00%' END AS detail
FROM j WHERE status <> 'match'""")
def failure_details(t):
    line = comparison_detail(
        F.col("custkey").cast("string"), F.col("published").cast("bigint").cast("string"), F.col("published"),
        F.col("source"), F.col("rel_diff"), F.lit(0.01), F.col("passed"))
    return align.failure_lines(_spend_cells(t), ["priority", "custkey"], line)


@query("row_counts", """
WITH a AS (SELECT o_custkey AS custkey, count(*) AS n FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY ALL),
     b AS (SELECT c_custkey AS custkey, count(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey
           WHERE c_custkey % 40 <> 1 GROUP BY ALL)
SELECT coalesce(a.custkey, b.custkey) AS custkey, coalesce(a.n, 0) AS published_rows,
       coalesce(b.n, 0) AS source_rows, coalesce(a.n, 0) = coalesce(b.n, 0) AS passed
FROM a FULL JOIN b ON a.custkey = b.custkey""")
def row_counts(t):
    orders = t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    return align.row_counts(orders.where(F.col("o_orderkey") % 50 != 0),
                            orders.where(F.col("custkey") % 40 != 1), ["custkey"])


@query("missing_columns", ctes(c=LINE_CELLS) + """
, v AS (SELECT DISTINCT visual_id FROM c),
  r AS (SELECT visual_id, unnest(['qty', 'price', 'tax']) AS required_col FROM v),
  p AS (SELECT DISTINCT visual_id, lower(trim(col_name)) AS required_col FROM c)
SELECT visual_id, required_col,
  (SELECT string_agg(required_col, ', ' ORDER BY required_col) FROM p WHERE p.visual_id = r.visual_id) AS available
FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.visual_id = r.visual_id AND p.required_col = r.required_col)""")
def missing_columns(t):
    required = t.lineitem.select(F.col("l_orderkey").alias("visual_id")).distinct().select(
        "visual_id", F.explode(F.array(F.lit("Qty"), F.lit("Price"), F.lit("Tax")))
        .alias("required_col"))
    return align.missing_columns(line_cells(t), required)
