"""Captured grids, chart points and API answers."""

from pyspark.sql import functions as F

from tallymark.functions.text import undouble
from tallymark.operators import captures
from workloads.derive import LINE_CELLS, LINE_ROWS, ctes, line_cells
from workloads.registry import query


@query("grid_rows", ctes(r=LINE_ROWS) + """
SELECT visual_id, row_no, qty AS "Qty", CASE WHEN visual_id % 3 <> 0 THEN price END AS "Price" FROM r""")
def grid_rows(t):
    return captures.grid(
        line_cells(t), ["visual_id", "row_no"], ["Qty", " Price"]
    ).withColumnRenamed(" Price", "Price")


_CELL_TEXT = """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE o_orderstatus END AS a,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS b,
  CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'x' || CAST(o_custkey AS STRING) END AS c, o_custkey
FROM {orders}
"""


@query("named_cells", ctes(t=_CELL_TEXT) + """
SELECT o_orderkey, 0 AS col_no, 'Status' AS col_name, a AS raw, o_orderkey % 3 <> 0 AS kept_when_strict FROM t WHERE o_orderkey % 8 <> 0
UNION ALL SELECT o_orderkey, 1, 'col_1', b, o_orderkey % 3 <> 0 FROM t WHERE o_orderkey % 8 <> 0
UNION ALL SELECT o_orderkey, 2, 'col_2', c, false FROM t WHERE o_orderkey % 3 = 0 AND o_orderkey % 8 <> 0""")
def named_cells(t):
    headers = F.array(F.lit("Status"), F.lit(""))
    two = F.array("a", "b")
    cells = F.when(F.col("o_orderkey") % 3 == 0, F.array("a", "b", "c")).otherwise(two)
    rows = t.sql(_CELL_TEXT).select(
        "o_orderkey", F.inline(captures.named_cells(headers, cells)),
        captures.named_cells(headers, cells, strict=True).isNotNull().alias("kept_when_strict"))
    return captures.drop_empty_rows(rows, ["o_orderkey"])


@query("capture_completeness", ctes(r=LINE_ROWS) + """
, n AS (SELECT visual_id, count(*) AS rows FROM r GROUP BY ALL)
SELECT o_orderkey AS visual_id, o_orderkey % 9 AS reported_total, coalesce(rows, 0) AS captured_rows,
  o_orderkey % 9 > 0 AND coalesce(rows, 0) < o_orderkey % 9 AS partial
FROM orders LEFT JOIN n ON visual_id = o_orderkey""")
def capture_completeness(t):
    reported = t.orders.select(F.col("o_orderkey").alias("visual_id"),
                               (F.col("o_orderkey") % 9).alias("reported_total"))
    return captures.capture_completeness(line_cells(t), reported)


@query("header_lists", ctes(c=LINE_CELLS) + """
SELECT visual_id, string_agg(col_name, '|' ORDER BY col_no) AS headers
FROM (SELECT DISTINCT visual_id, col_no, col_name FROM c) d GROUP BY visual_id""")
def header_lists(t):
    return captures.header_lists(line_cells(t)).select(
        "visual_id", F.array_join("headers", "|").alias("headers"))


@query("preview_snapshot", ctes(c=LINE_CELLS) + """
, n AS (SELECT visual_id, count(DISTINCT row_no) AS rows, min(row_no) AS first FROM c GROUP BY ALL),
  p AS (SELECT n.visual_id, rows, string_agg(col_name, ', ' ORDER BY col_no) AS columns,
          string_agg(raw, ' | ' ORDER BY col_no) AS first_row
        FROM n JOIN c ON c.visual_id = n.visual_id AND c.row_no = n.first GROUP BY ALL)
SELECT o_orderkey AS visual_id, coalesce(rows, 0) AS rows, columns, first_row, rows IS NOT NULL AS extracted
FROM orders LEFT JOIN p ON visual_id = o_orderkey""")
def preview_snapshot(t):
    configured = t.orders.select(F.col("o_orderkey").alias("visual_id"))
    return captures.preview_all(configured, line_cells(t))


_SCROLLED = """
SELECT l_orderkey AS visual_id, pass * 10000000000 + l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS seq,
  l_returnflag AS flag, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS qty
FROM (SELECT *, 0 AS pass FROM {lineitem} UNION ALL SELECT *, 1 AS pass FROM {lineitem} WHERE l_quantity > 20) l
"""


@query("dedup_scroll", ctes(t=_SCROLLED) + """
SELECT visual_id, flag, qty, min(seq) AS seq FROM t GROUP BY ALL""")
def dedup_scroll(t):
    return captures.drop_repeats(t.sql(_SCROLLED), ["visual_id"], ["flag", "qty"], "seq")


@query("api_rows", """
SELECT o_orderkey AS visual_id, 0 AS row_no, 'priority' AS col_name, o_orderpriority AS raw FROM orders WHERE o_orderkey % 6 > 3
UNION ALL SELECT o_orderkey, 0, 'total price', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) FROM orders WHERE o_orderkey % 6 > 3
UNION ALL SELECT o_orderkey, 1, 'priority', 'second' FROM orders WHERE o_orderkey % 6 > 3
UNION ALL SELECT o_orderkey, 1, 'status', o_orderstatus FROM orders WHERE o_orderkey % 6 > 3""")
def api_rows(t):
    kind = F.col("o_orderkey") % 6
    full = F.concat(
        F.lit('{"results":[{"tables":[{"rows":[{"[Priority]":"'), "o_orderpriority",
        F.lit('","Orders[Total Price]":'), F.floor("o_totalprice").cast("string"),
        F.lit('},{"[Priority]":"second","Status ":"'), "o_orderstatus",
        F.lit('"}]},{"rows":[{"x":"other table"}]}]}]}'))
    body = (
        F.when(kind == 0, F.lit('{"results":[]}'))
        .when(kind == 1, F.lit('{"results":[{"tables":[]}]}'))
        .when(kind == 2, F.lit('{"results":[{"tables":[{"rows":[]}]}]}'))
        .when(kind == 3, F.lit("not json")).otherwise(full)
    )
    return captures.api_rows(t.orders.select(F.col("o_orderkey").alias("visual_id"),
                                             body.alias("body")))


# Charts: one per user; bars and ticks are events, texts are doubled or numeric.
_BARS = """
SELECT user_id AS visual_id, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE CAST(event_id % 50 AS STRING) END AS value
FROM {events} WHERE event_type IN ('view', 'click')
"""
_TICKS = """
SELECT user_id AS visual_id, event_id AS seq, CASE event_id % 4
  WHEN 0 THEN 'cat' || CAST(event_id % 20 AS STRING) || 'cat' || CAST(event_id % 20 AS STRING)
  WHEN 1 THEN ' cat' || CAST(event_id % 20 AS STRING) WHEN 2 THEN '1,200.5' ELSE '' END AS text
FROM {events} WHERE event_type = 'signup'
"""
_BAR_SQL = """
, un AS (SELECT visual_id, seq, trim(text) AS x FROM ti),
  na AS (SELECT visual_id, seq, CASE WHEN length(x) % 2 = 0 AND left(x, length(x) // 2) = right(x, length(x) // 2)
           THEN left(x, length(x) // 2) ELSE x END AS category FROM un),
  la AS (SELECT visual_id, category, row_number() OVER (PARTITION BY visual_id ORDER BY min(seq)) - 1 AS idx,
           count(*) OVER (PARTITION BY visual_id) AS n
         FROM na WHERE category <> '' AND NOT regexp_matches(category, '^[\\d.,]+$') GROUP BY visual_id, category),
  nb AS (SELECT *, row_number() OVER (PARTITION BY visual_id ORDER BY seq) - 1 AS bar FROM b),
  ba AS (SELECT b.visual_id, category, trim(value) AS value, min(seq) AS seq FROM nb b
         JOIN la ON la.visual_id = b.visual_id AND la.idx = b.bar % la.n WHERE trim(value) <> '' GROUP BY ALL)
"""


@query("bar_axis_pairing", ctes(b=_BARS, ti=_TICKS) + _BAR_SQL + "SELECT * FROM ba")
def bar_axis_pairing(t):
    return captures.bars_on_axis(t.sql(_BARS), t.sql(_TICKS))


_TEXTS = """
SELECT user_id AS visual_id, event_id AS seq, CASE WHEN event_type = 'purchase'
    THEN (CASE WHEN event_id % 5 = 0 THEN '$' || CAST(event_id % 12 + 10 AS STRING) || 'bn' ELSE CAST(event_id % 9 + 20 AS STRING) || '%' END)
  ELSE (CASE WHEN event_id % 6 = 0 THEN 'x' ELSE 'Group ' || CAST(event_id % 17 AS STRING) END) END AS text
FROM {events} WHERE event_type IN ('purchase', 'error')
"""
_TEXT_SQL = """
, sp AS (SELECT visual_id, text, regexp_matches(text, '^[\\d,.\\s%$€£¥bn]+$', 'i') AS num, min(seq) AS seq
         FROM tx WHERE length(text) > 1 GROUP BY ALL),
  nu AS (SELECT *, row_number() OVER (PARTITION BY visual_id, num ORDER BY seq) - 1 AS idx,
           count(*) OVER (PARTITION BY visual_id, num) AS n FROM sp),
  tp AS (SELECT a.visual_id, a.idx AS seq, a.text AS category, b.text AS value FROM nu a
         JOIN nu b ON a.visual_id = b.visual_id AND a.idx = b.idx AND a.n = b.n AND NOT a.num AND b.num)
"""


@query("text_pairs", ctes(tx=_TEXTS) + _TEXT_SQL + "SELECT * FROM tp")
def text_pairs(t):
    return captures.text_pairs(t.sql(_TEXTS))


@query("undoubled_labels", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderpriority || o_orderstatus END AS label
FROM orders""")
def undoubled_labels(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderpriority", "o_orderpriority")
                  ).otherwise(F.concat("o_orderpriority", "o_orderstatus"))
    return t.orders.select("o_orderkey", undouble(text).alias("label"))


_LABELS = """
SELECT user_id AS visual_id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'Axis' WHEN 1 THEN 'A.'
  WHEN 2 THEN ' C' || CAST(event_id % 30 AS STRING) || '. ' || CAST(event_id % 7 AS STRING) || '. '
  ELSE 'C' || CAST(event_id % 30 AS STRING) || '. Sum of x. ' || CAST(event_id % 7 AS STRING) || '.' END AS label
FROM {events} WHERE user_id % 3 = 0 OR (user_id % 3 = 1 AND event_id % 4 < 2)
"""


@query("chart_points", ctes(lb=_LABELS, b=f"SELECT * FROM ({_BARS}) q WHERE visual_id % 2 = 0", ti=_TICKS, tx=_TEXTS)
       + _BAR_SQL + _TEXT_SQL + """
, l0 AS (SELECT visual_id, trim(label) AS label, min(seq) AS seq FROM lb GROUP BY ALL),
  l1 AS (SELECT visual_id, seq, string_split(regexp_replace(label, '\\.$', ''), '. ') AS p FROM l0),
  l2 AS (SELECT visual_id, 1 AS method, seq, trim(p[1]) AS category, CASE WHEN len(p) = 3 THEN trim(p[2]) END AS measure,
           trim(p[len(p)]) AS value FROM l1 WHERE len(p) >= 2),
  al AS (SELECT * FROM l2 UNION ALL SELECT visual_id, 2, seq, category, NULL, value FROM ba
         UNION ALL SELECT visual_id, 3, seq, category, NULL, value FROM tp)
SELECT * FROM al WHERE method = (SELECT min(method) FROM al m WHERE m.visual_id = al.visual_id)""")
def chart_points(t):
    bars = t.sql(_BARS).where(F.col("visual_id") % 2 == 0)
    return captures.chart_points(t.sql(_LABELS), bars, t.sql(_TICKS), t.sql(_TEXTS))


# Bodies by order, braces as < and >: empty at each level, broken, an error, an odd shape, two rows with typed and nested values.
_BODIES = """
SELECT o_orderkey AS visual_id, replace(replace(CASE o_orderkey % 10
  WHEN 0 THEN '<"results":[]>' WHEN 1 THEN '<"results":[<"tables":[]>]>' WHEN 2 THEN '<"results":[<"tables":[<"rows":[]>]>]>'
  WHEN 3 THEN 'not json' WHEN 4 THEN '<"error":<"code":"E' || CAST(o_custkey AS STRING) || '">>'
  WHEN 5 THEN '<"results":<"tables":1>>' WHEN 6 THEN CAST(NULL AS STRING)
  ELSE '<"results":[<"tables":[<"rows":[<"[Priority]":"' || o_orderpriority || '","Orders[Total]":' || CAST(o_custkey AS STRING)
    || '.5,"Open ":' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'null' END || '>,<"t[Lines]":[1,<"a":' || CAST(o_custkey AS STRING)
    || '>]>]>,<"rows":[<"x":"other table">]>]>]>' END, '<', chr(123)), '>', chr(125)) AS body, o_custkey, o_orderpriority, o_orderstatus
FROM {orders}
"""


@query("api_states", ctes(b=_BODIES) + """
SELECT visual_id, CASE WHEN visual_id % 10 < 3 THEN 'empty' WHEN visual_id % 10 = 3 THEN 'broken' WHEN visual_id % 10 = 4 THEN 'error'
  WHEN visual_id % 10 = 5 THEN 'unexpected' WHEN visual_id % 10 = 6 THEN 'no_body' ELSE 'ok' END AS state,
  CASE WHEN visual_id % 10 = 4 THEN 'E' || o_custkey END AS message, CASE WHEN visual_id % 10 > 6 THEN 2 END AS rows
FROM b""")
def api_states(t):
    return captures.api_answers(t.sql(_BODIES)).withColumn("rows", F.size("rows"))


@query("api_cells", ctes(b=_BODIES) + """
, k AS (SELECT * FROM b WHERE visual_id % 10 > 6)
SELECT visual_id, 0 AS row_no, 'priority' AS col_name, 'text' AS kind, o_orderpriority AS raw, CAST(NULL AS DOUBLE) AS number FROM k
UNION ALL SELECT visual_id, 0, 'total', 'number', o_custkey || '.5', o_custkey + 0.5::DOUBLE FROM k
UNION ALL SELECT visual_id, 0, 'open', CASE WHEN o_orderstatus = 'O' THEN 'boolean' ELSE 'null' END,
  CASE WHEN o_orderstatus = 'O' THEN 'true' END, NULL FROM k
UNION ALL SELECT visual_id, 1, 'lines', 'list', '[1,{"a":' || o_custkey || '}]', NULL FROM k""")
def api_cells(t):
    return captures.api_cells(captures.api_answers(t.sql(_BODIES)))


# A list per customer, seen through pages of four rows that move on by two or three: status repeats a lot.
_SCROLL_PAGES = """
SELECT visual_id, 10 * page AS page, 3 * place - 7 AS row_no, flag, qty FROM (
  SELECT o_custkey AS visual_id, CAST(floor((n + 2) / (2 + o_custkey % 2)) AS BIGINT) AS page, n AS place, flag, qty
  FROM (SELECT o_custkey, o_orderstatus AS flag, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 END AS qty,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {orders}) a
  UNION ALL SELECT o_custkey, CAST(floor(n / (2 + o_custkey % 2)) AS BIGINT), n, flag, qty
  FROM (SELECT o_custkey, o_orderstatus AS flag, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 END AS qty,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {orders}) b
  WHERE floor(n / (2 + o_custkey % 2)) <> floor((n + 2) / (2 + o_custkey % 2))) u
"""


@query("stitch_scroll", ctes(s=_SCROLL_PAGES) + """
, p AS (SELECT visual_id, page, list({'f': flag, 'q': qty} ORDER BY row_no) AS l, list(row_no ORDER BY row_no) AS n
        FROM s GROUP BY ALL),
  q AS (SELECT *, lag(l) OVER (PARTITION BY visual_id ORDER BY page) AS b FROM p),
  k AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(l), len(b)) + 1),
          lambda i: list_slice(b, len(b) - i + 1, len(b)) IS NOT DISTINCT FROM list_slice(l, 1, i))), 0) AS o FROM q)
SELECT visual_id, page, unnest(n[o + 1:]) AS row_no, unnest(l[o + 1:]).f AS flag, unnest(l[o + 1:]).q AS qty FROM k""")
def stitch_scroll(t):
    return captures.stitch_pages(t.sql(_SCROLL_PAGES), ["visual_id"], "page", "row_no", ["flag", "qty"])
