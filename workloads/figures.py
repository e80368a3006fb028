"""Display numbers, comparison rules, titles and labels."""

from pyspark.sql import functions as F

from tallymark.functions import compare, numbers, text
from tallymark.plans.checks import kpi_mode
from workloads.derive import CUSTOMER_TEXT, ORDER_TEXT, ctes
from workloads.registry import query


@query("parse_display_number", ctes(t=ORDER_TEXT) + """
SELECT o_orderkey, raw, CAST(CASE o_orderkey % 10 WHEN 1 THEN n * 1000 WHEN 2 THEN n * 1000000
  WHEN 3 THEN -n WHEN 4 THEN -n WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE n END AS DOUBLE) AS value
FROM t""")
def parse_display_number(t):
    return t.sql(ORDER_TEXT).select(
        "o_orderkey", "raw", numbers.display_number(F.col("raw")).alias("value"))


@query("parse_null_and_bad_tokens", ctes(t=CUSTOMER_TEXT) + """
SELECT c_custkey, raw, CAST(CASE c_custkey % 18
  WHEN 9 THEN c_custkey WHEN 10 THEN -c_custkey WHEN 11 THEN c_custkey * 1000
  WHEN 13 THEN c_custkey * 10 + 3 WHEN 14 THEN c_custkey WHEN 16 THEN c_custkey * 1000000000
  WHEN 17 THEN -(c_custkey * 1000000 + 500000) END AS DOUBLE) AS value,
  CAST(CASE c_custkey % 18 WHEN 14 THEN c_custkey END AS DOUBLE) AS plain_value
FROM t""")
def parse_null_and_bad_tokens(t):
    return t.sql(CUSTOMER_TEXT).select(
        "c_custkey", "raw", numbers.display_number(F.col("raw")).alias("value"),
        numbers.plain_number(F.col("raw")).alias("plain_value"))


_PERTURBED = """
SELECT o_orderkey, CAST(cents * (98 + o_orderkey % 5) AS DOUBLE) AS published,
       CAST(cents * 100 AS DOUBLE) AS source
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM {orders}) o
"""


@query("tolerance_compare", ctes(t=_PERTURBED) + """
SELECT o_orderkey, round(abs(published - source) / greatest(abs(published), abs(source), 1.0), 6)
         AS rel_diff,
       o_orderkey % 5 IN (1, 2, 3) AS passed,
       CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN 'match' ELSE 'mismatch' END AS status
FROM t""")
def tolerance_compare(t):
    status = compare.value_status(F.col("published"), F.col("source"), F.lit(0.01))
    return t.sql(_PERTURBED).select(
        "o_orderkey",
        F.round(compare.relative_difference(F.col("published"), F.col("source")), 6)
        .alias("rel_diff"),
        compare.passes(status).alias("passed"), status.alias("status"))


_WITH_NULLS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN NULL ELSE o_totalprice END AS published,
       CASE WHEN o_orderkey % 4 IN (0, 2) THEN NULL ELSE o_totalprice END AS source
FROM {orders}
"""


@query("compare_null_policy", ctes(t=_WITH_NULLS) + """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'both_null' WHEN 1 THEN 'published_null'
         WHEN 2 THEN 'source_null' ELSE 'match' END AS status,
       o_orderkey % 4 IN (0, 3) AS passed_match, o_orderkey % 4 = 3 AS passed_strict
FROM t""")
def compare_null_policy(t):
    status = compare.value_status(F.col("published"), F.col("source"), F.lit(0.01))
    return t.sql(_WITH_NULLS).select(
        "o_orderkey", status.alias("status"),
        compare.passes(status, "match").alias("passed_match"),
        compare.passes(status, "strict").alias("passed_strict"))


_DETAIL_INPUT = """
SELECT o_orderkey, n, CASE o_orderkey % 4 WHEN 0 THEN 'Card ' || CAST(o_orderkey AS STRING) ELSE '' END AS title,
       CASE WHEN o_orderkey % 4 = 1 THEN 'Table' ELSE '' END AS type, o_orderkey % 3 AS idx
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM {orders}) o
"""


@query("detail_message", ctes(t=_DETAIL_INPUT) + """
SELECT o_orderkey, '[' || CASE o_orderkey % 4 WHEN 0 THEN title WHEN 1 THEN 'Table[' || idx || ']'
         ELSE 'Unknown' END || '] ' ||
       CASE o_orderkey % 3
         WHEN 0 THEN 'ok: shown $' || n || ', read as ' || n || '.0000, expected ' || n ||
              '.0000, off by 0.0000% of at most 1.00%'
         WHEN 1 THEN 'failed: shown $' || n || ', read as ' || n || '.0000, expected ' || n * 2 ||
              '.0000, off by 50.0000% of at most 1.00%'
         ELSE 'failed: shown $' || n || ', read as ' || n || '.0000, nothing to expect' END
       AS detail
FROM t""")
def detail_message(t):
    df = t.sql(_DETAIL_INPUT).select(
        "*", F.concat(F.lit("$"), F.col("n").cast("string")).alias("raw"),
        F.when(F.col("o_orderkey") % 3 < 2, (F.col("n") * (F.col("o_orderkey") % 3 + 1))
               .cast("double")).alias("source"))
    df = df.withColumn("published", numbers.display_number(F.col("raw")))
    published = F.col("published")
    status = compare.value_status(published, F.col("source"), F.lit(0.01))
    return df.select("o_orderkey", numbers.comparison_detail(
        text.human_label(F.col("title"), F.col("type"), F.col("idx")), F.col("raw"), published,
        F.col("source"), compare.relative_difference(published, F.col("source")), F.lit(0.01),
        compare.passes(status)).alias("detail"))


@query("text_match", """
SELECT p_partkey, p_partkey % 3 < 2 AS passed FROM part""")
def text_match(t):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" - "), F.col("p_type"))
    expected = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lower("p_type"), F.lit("  "))).otherwise(
        F.concat(F.col("p_name"), F.lit("?")))
    return t.part.select("p_partkey", compare.text_matches(raw, expected).alias("passed"))


@query("extraction_only", ctes(t=CUSTOMER_TEXT) + """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'sql' WHEN c_custkey % 4 = 1 THEN 'file'
         WHEN c_custkey % 8 = 2 THEN 'expected_value' WHEN c_custkey % 8 = 6 THEN 'expected_text'
         ELSE 'extraction_only' END AS mode,
       c_custkey % 18 IN (9, 10, 11, 13, 14, 16, 17) AS passed
FROM t""")
def extraction_only(t):
    k = F.col("c_custkey")
    expected = F.when(k % 4 == 2, F.lit("5"))
    return t.sql(CUSTOMER_TEXT).select(
        "c_custkey", kpi_mode(k % 4 == 0, k % 4 <= 1, expected, k % 8 == 6).alias("mode"),
        compare.extracted(F.col("raw")).alias("passed"))


@query("visual_titles", """
WITH t AS (SELECT doc_id, text, [trim(x, ' ' || chr(9) || chr(13)) for x in string_split(text, chr(10))
                         if trim(x, ' ' || chr(9) || chr(13)) <> ''] AS lines FROM documents),
     u AS (SELECT doc_id, text, coalesce(lines[1], '') AS title FROM t),
     v AS (SELECT *, replace(title, '"', '''') AS q FROM u)
SELECT doc_id, title, CASE WHEN length(q) > 80 THEN rtrim(left(q, 80)) || '…' ELSE q END AS safe,
       left(replace(text, chr(10), ' | '), 80) AS snippet,
       title = '' OR regexp_matches(title, '^[$(]') OR regexp_matches(title, '^[\\d,.\\s%]+$')
         OR (length(title) <= 2 AND regexp_matches(title, '^[⇗⇘⇒⇑⇓→↑↓▲▼]'))
         OR regexp_matches(title, '^[$(]?[\\d,.]+[KMBkmbTt%]?\\)?$')
         OR regexp_matches(title, '^Scroll (up|down|left|right)$', 'i') AS noisy
FROM v""")
def visual_titles(t):
    title = text.first_line(F.col("text"))
    return t.documents.select(
        "doc_id", title.alias("title"), text.safe_title(F.col("text")).alias("safe"),
        text.snippet(F.col("text")).alias("snippet"), text.is_noisy(title).alias("noisy"))


@query("point_labels", """
SELECT c_custkey, c_name AS category,
       CASE c_custkey % 4 WHEN 1 THEN c_mktsegment WHEN 2 THEN c_mktsegment || ', more' END AS measure,
       CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS value
FROM customer WHERE c_custkey % 4 < 3""")
def point_labels(t):
    figure = F.floor("c_acctbal").cast("string")
    label = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat_ws(". ", "c_name", figure))
        .when(F.col("c_custkey") % 4 == 1, F.concat_ws(". ", "c_name", "c_mktsegment", figure))
        .when(F.col("c_custkey") % 4 == 2,
              F.concat_ws(". ", "c_name", "c_mktsegment", F.lit("more"), figure))
        .otherwise(F.col("c_name"))
    )
    return t.customer.select(
        "c_custkey", text.point_label(F.concat(label, F.lit("."))).alias("p")
    ).where(F.col("p").isNotNull()).select("c_custkey", "p.category", "p.measure", "p.value")


_INDICATOR = """
SELECT o_orderkey, o_custkey % 19 + 1 AS n, CASE o_orderkey % 5
  WHEN 0 THEN '1of' || CAST(o_custkey % 19 + 1 AS STRING)
  WHEN 1 THEN '1 of ' || CAST(o_custkey % 19 + 1 AS STRING)
  WHEN 2 THEN '1of' || CAST(o_custkey % 9 + 1 AS STRING) || '1- Overview2- ' || o_orderpriority
  WHEN 3 THEN 'no indicator ' || o_orderstatus
  ELSE '0 OF 0' END AS indicator, o_custkey
FROM {orders}
"""


@query("page_count", ctes(t=_INDICATOR) + """
SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN o_custkey % 9 + 1
         ELSE 1 END AS INT) AS pages,
       CAST(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE CASE o_orderkey % 5 WHEN 0 THEN n WHEN 1 THEN n
         WHEN 2 THEN o_custkey % 9 + 1 ELSE 1 END END AS INT) AS navigable
FROM t""")
def page_count(t):
    shown = F.col("indicator")
    return t.sql(_INDICATOR).select(
        "o_orderkey", numbers.page_count(shown).alias("pages"),
        numbers.page_count(shown, F.col("o_custkey") % 2 == 0).alias("navigable"))
