"""Column catalog: matching, table choice, suggestions, foreign keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import catalog, foreign_keys
from tallymark.plans import inventory, suggest
from workloads.derive import CATALOG, HEADERS, ctes
from workloads.registry import query


def _catalog(t):
    return t.sql(CATALOG.replace('"table"', "`table`").replace('"column"', "`column`"))


def _has(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# Every distinct header form against every column, pair by pair.
_MATCH = """
, hf AS (SELECT DISTINCT regexp_replace(lower(trim(header)), '[^a-z0-9]', '', 'g') AS form FROM h),
  cf AS (SELECT *, regexp_replace(lower("column"), '[^a-z0-9]', '', 'g') AS cform FROM c),
  sc AS (SELECT form, cf.*, CASE WHEN form = cform THEN 3 WHEN contains(cform, form) OR contains(form, cform) THEN 2
           WHEN len([1 for i in range(1, CAST(length(form) - 2 AS BIGINT)) if contains(cform, substr(form, i, 4))]) > 0
             AND length(form) >= 4 THEN 1 ELSE 0 END AS w
         FROM hf, cf WHERE form <> ''),
  be AS (SELECT form, w, "table", "column", type FROM sc WHERE w > 0
         QUALIFY row_number() OVER (PARTITION BY form ORDER BY w DESC, table_no, column_no) = 1),
  m AS (SELECT h.*, coalesce("table", '') AS db_table, coalesce("column", '') AS db_col, coalesce(type, '') AS db_type,
          coalesce(w, 0) AS w, CASE coalesce(w, 0) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'NONE' END
          AS confidence, coalesce(contains(type, 'INT') OR contains(type, 'DECIMAL'), false) AS is_numeric,
          coalesce(contains(type, 'DATE'), false) AS is_date, coalesce(contains(type, 'CHAR'), false) AS is_categorical
        FROM h LEFT JOIN be ON be.form = regexp_replace(lower(trim(h.header)), '[^a-z0-9]', '', 'g'))
"""


@query("column_match", ctes(h=HEADERS, c=CATALOG) + _MATCH + """
SELECT visual_id, col_no, header, db_table, db_col, db_type, confidence, is_numeric, is_date, is_categorical FROM m""")
def column_match(t):
    return catalog.match_columns(t.sql(HEADERS), _catalog(t))


_BEST = """
, tb AS (SELECT visual_id, db_table, sum(w) AS score, min(col_no) AS first FROM m WHERE db_table <> '' GROUP BY ALL),
  bt AS (SELECT visual_id, db_table, CAST(score AS BIGINT) AS score FROM tb QUALIFY row_number() OVER (PARTITION BY visual_id
         ORDER BY score DESC, starts_with(db_table, 'fact') DESC, first, db_table) = 1),
  cs AS (SELECT visual_id, CASE WHEN max(w) = 0 THEN 'NONE' WHEN min(w) FILTER (w > 0) = 3 THEN 'HIGH'
           WHEN max(w) >= 2 THEN 'MEDIUM' WHEN min(w) = 0 THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM m GROUP BY ALL)
"""


@query("best_table", ctes(h=HEADERS, c=CATALOG) + _MATCH + _BEST + """
SELECT cs.visual_id, coalesce(db_table, '') AS db_table, score, confidence FROM cs LEFT JOIN bt ON bt.visual_id = cs.visual_id""")
def best_table(t):
    matched = catalog.match_columns(t.sql(HEADERS), _catalog(t))
    return catalog.header_sets(matched, ["visual_id"], "col_no").drop("any_numeric").fillna(
        "", ["db_table"])


_COUNT_WORDS = ["count", "number of", "# of", "qty", "quantity"]
_MEAN_WORDS = ["average", " avg", "mean", "per ", "margin", "rate", "ratio", "percent", "%", "growth"]


def _agg(words):
    return f"""CASE WHEN {_has(words, _COUNT_WORDS)} THEN CASE WHEN contains({words}, 'count') THEN 'COUNT' ELSE 'SUM' END
      WHEN {_has(words, _MEAN_WORDS)} THEN 'AVG' WHEN is_numeric THEN 'SUM' WHEN is_categorical THEN '' ELSE 'SUM' END"""


_CARD_TITLES = """
SELECT l_orderkey AS visual_id, CASE l_partkey % 5 WHEN 0 THEN p_name || ' YoY' WHEN 1 THEN 'Average ' || p_name
  WHEN 2 THEN p_name || ' Rate' WHEN 3 THEN p_name ELSE 'Number of ' || p_name END AS header
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""
_KPI_SQL = f"""
, su AS (SELECT visual_id, header, w > 0 AND NOT {_has("lower(header)", ["yoy", "growth"])} AS usable, w, confidence,
    db_table, db_col, CASE WHEN {_agg("lower(header || ' ' || db_col)")} = '' THEN 'SUM'
      ELSE {_agg("lower(header || ' ' || db_col)")} END AS agg FROM m),
  ks AS (SELECT visual_id, header, CASE WHEN usable THEN db_table ELSE '' END AS db_table,
    CASE WHEN usable THEN db_col ELSE '' END AS db_col, CASE WHEN usable THEN agg ELSE '' END AS agg,
    CASE WHEN NOT usable THEN 'NONE' WHEN agg = 'AVG' AND w = 3 THEN 'MEDIUM' ELSE confidence END AS confidence FROM su)
"""


@query("suggest_kpi", ctes(h=_CARD_TITLES, c=CATALOG) + _MATCH + _KPI_SQL + "SELECT * FROM ks")
def suggest_kpi(t):
    return suggest.suggest_kpis(t.sql(_CARD_TITLES), _catalog(t))


_TABLE_SQL = f"""
, ke AS (SELECT m.*, cs.confidence AS set_confidence, bt.db_table AS source_table, bool_or(is_numeric) OVER (PARTITION BY m.visual_id) AS any_numeric,
     {_agg("lower(' ' || db_col)")} AS guess
   FROM m JOIN bt ON bt.visual_id = m.visual_id AND bt.db_table = m.db_table JOIN cs ON cs.visual_id = m.visual_id),
  ts AS (SELECT visual_id, col_no, header, source_table, db_col,
     CASE WHEN (is_numeric OR NOT any_numeric) AND guess <> '' THEN 'measure' ELSE 'key' END AS role,
     CASE WHEN (is_numeric OR NOT any_numeric) AND guess <> '' THEN guess ELSE '' END AS agg,
     set_confidence AS confidence FROM ke)
"""


@query("suggest_table", ctes(h=HEADERS, c=CATALOG) + _MATCH + _BEST + _TABLE_SQL + "SELECT * FROM ts")
def suggest_table(t):
    return suggest.suggest_tables(t.sql(HEADERS), _catalog(t))


_INVENTORY = """
SELECT o_orderkey AS visual_id, CASE o_orderkey % 3 WHEN 0 THEN 'kpi' WHEN 1 THEN 'chart' ELSE 'other' END AS category,
  'Total ' || o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN p_name END AS heading
FROM {orders} o LEFT JOIN {part} p ON o.o_custkey = p.p_partkey
"""


def _suggestions(t):
    return suggest.suggest_for_inventory(t.sql(_INVENTORY), t.sql(HEADERS), _catalog(t))


_SUGGEST_SQL = ctes(
    i=_INVENTORY, c=CATALOG,
    h=f"""SELECT visual_id, NULL AS col_no, coalesce(heading, title) AS header, 'kpi' AS side FROM ({_INVENTORY}) i
          WHERE category = 'kpi' UNION ALL SELECT visual_id, col_no, header, 'chart' FROM ({HEADERS}) h
          WHERE visual_id % 3 = 1""",
) + _MATCH + """
, mk AS (SELECT * FROM m WHERE side = 'kpi')""" + _KPI_SQL.replace("FROM m)", "FROM mk)") + """
, mc AS (SELECT * FROM m WHERE side = 'chart')""" + _BEST.replace("FROM m ", "FROM mc ") + """
, fo AS (SELECT visual_id, db_table, confidence FROM ks UNION ALL
         SELECT bt.visual_id, bt.db_table, cs.confidence FROM bt JOIN cs ON cs.visual_id = bt.visual_id),
  sg AS (SELECT i.visual_id, category, coalesce(db_table, '') AS db_table, coalesce(confidence, 'NONE') AS confidence
         FROM i LEFT JOIN fo ON fo.visual_id = i.visual_id WHERE category IN ('kpi', 'chart'))
"""


@query("suggest_inventory", _SUGGEST_SQL + "SELECT * FROM sg")
def suggest_inventory(t):
    return _suggestions(t)


@query("confidence_histogram", _SUGGEST_SQL + """
SELECT le.confidence, count(sg.visual_id) AS suggestions
FROM (SELECT unnest(['HIGH', 'MEDIUM', 'LOW', 'NONE']) AS confidence) le
LEFT JOIN sg ON sg.confidence = le.confidence GROUP BY ALL""")
def confidence_histogram(t):
    return inventory.confidence_histogram(_suggestions(t))


@query("suggested_query", """
SELECT l_returnflag AS "Return Flag", CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS "Quantity"
FROM lineitem GROUP BY l_returnflag""")
def suggested_query(t):
    lines = t.lineitem.withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
    columns = catalog.catalog_of({"lineitem": lines})
    names = F.array(F.lit("Return Flag"), F.lit("Quantity"))
    headers = columns.limit(1).select(F.lit(1).alias("visual_id"), F.posexplode(names).alias(
        "col_no", "header"))
    # The roles of one visual, a row per header, become one grouped query.
    roles = suggest.suggest_tables(headers, columns).orderBy("col_no").collect()
    return suggest.grouped_query(lines, [(r.header, r.db_col, r.role, r.agg) for r in roles])


_KEYS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "supplier", "s_nationkey"),
    ("events", "user_id", "supplier", "s_suppkey"),
]


@query("fk_check", " UNION ALL ".join(f"""
SELECT '{a}' AS from_table, '{b}' AS from_col, '{c}' AS to_table, '{d}' AS to_col,
  (SELECT count(*) FROM {a}) AS child_rows,
  (SELECT count(*) FROM {a} WHERE {b} NOT IN (SELECT {d} FROM {c})) AS orphan_rows,
  (SELECT count(*) FROM (SELECT {d} FROM {c} GROUP BY {d} HAVING count(*) > 1)) AS repeated_parent_keys,
  (SELECT count(*) FROM {a} WHERE {b} NOT IN (SELECT {d} FROM {c})) = 0 AND
  (SELECT count(*) FROM (SELECT {d} FROM {c} GROUP BY {d} HAVING count(*) > 1)) = 0 AS holds"""
                                     for a, b, c, d in _KEYS))
def fk_check(t):
    declared = t.spark.createDataFrame(
        [(a, [b], c, [d]) for a, b, c, d in _KEYS],
        "from_table string, from_cols array<string>, to_table string, to_cols array<string>")
    frames = {name: getattr(t, name) for pair in _KEYS for name in (pair[0], pair[2])}
    return catalog.check_foreign_keys(frames, catalog.flatten_keys(declared))


@query("fk_columns", """
SELECT 'f' || l_orderkey AS from_table, 'a' || l_linenumber AS from_col, 't' || l_suppkey AS to_table,
  'x' || l_linenumber AS to_col FROM lineitem
UNION ALL SELECT 'f' || l_orderkey, 'b', 't' || l_suppkey, 'y' || l_partkey FROM lineitem""")
def fk_columns(t):
    return catalog.flatten_keys(t.lineitem.select(
        F.concat(F.lit("f"), "l_orderkey").alias("from_table"),
        F.array(F.concat(F.lit("a"), "l_linenumber"), F.lit("b")).alias("from_cols"),
        F.concat(F.lit("t"), "l_suppkey").alias("to_table"),
        F.array(F.concat(F.lit("x"), "l_linenumber"), F.concat(F.lit("y"), "l_partkey"))
        .alias("to_cols")))


# Pairs of part and supplier that some lines break although each column alone holds; whole tables otherwise.
_PAIRS = """
SELECT CAST(l_partkey AS INT) AS part, l_suppkey AS supplier, min(l_orderkey) AS first_order FROM {lineitem}
WHERE (l_partkey + l_suppkey) % 7 <> 0 OR l_linenumber > 2 GROUP BY l_partkey, l_suppkey
"""
_LINES = """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 4 AND l_partkey % 5 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey
FROM {lineitem}
"""


@query("fk_pairs", ctes(p=_PAIRS, l=_LINES) + """
SELECT 'l_partkey,l_suppkey' AS from_cols, 'part,supplier' AS to_cols, count(*) AS child_rows,
  count(*) FILTER (l_suppkey IS NULL) AS unchecked_rows,
  count(*) FILTER (l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE part = l_partkey AND supplier = l_suppkey)) AS orphan_rows,
  0 AS repeated_parent_keys FROM l
UNION ALL SELECT 'l_partkey', 'part', count(*), 0, count(*) FILTER (l_partkey NOT IN (SELECT part FROM p)),
  (SELECT count(*) FROM (SELECT part FROM p GROUP BY part HAVING count(*) > 1)) FROM l
UNION ALL SELECT 'l_suppkey', 's_suppkey', count(*), count(*) FILTER (l_suppkey IS NULL),
  count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier)), 0 FROM l
UNION ALL SELECT 'part,supplier', 'l_partkey,l_suppkey', (SELECT count(*) FROM p), 0,
  (SELECT count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE part = l_partkey AND supplier = l_suppkey)),
  (SELECT count(*) FROM (SELECT 1 FROM l WHERE l_suppkey IS NOT NULL GROUP BY l_partkey, l_suppkey HAVING count(*) > 1))
UNION ALL SELECT 'first_order,supplier', 'l_orderkey,l_suppkey', (SELECT count(*) FROM p), 0,
  (SELECT count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE first_order = l_orderkey AND supplier = l_suppkey)),
  (SELECT count(*) FROM (SELECT 1 FROM l WHERE l_suppkey IS NOT NULL GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1))""")
def fk_pairs(t):
    frames = {"pairs": t.sql(_PAIRS), "lines": t.sql(_LINES), "supplier": t.supplier}
    declared = t.spark.createDataFrame([
        ("lines", ["l_partkey", "l_suppkey"], "pairs", ["part", "supplier"]), ("lines", ["l_partkey"], "pairs", ["part"]),
        ("lines", ["l_suppkey"], "supplier", ["s_suppkey"]), ("pairs", ["part", "supplier"], "lines", ["l_partkey", "l_suppkey"]),
        ("pairs", ["first_order", "supplier"], "lines", ["l_orderkey", "l_suppkey"]), ("lines", ["nope"], "pairs", ["part"])],
        "from_table string, from_cols array<string>, to_table string, to_cols array<string>")
    return foreign_keys.check_keys(frames, declared).select(
        F.array_join("from_cols", ",").alias("from_cols"), F.array_join("to_cols", ",").alias("to_cols"),
        "child_rows", "unchecked_rows", "orphan_rows", "repeated_parent_keys")
