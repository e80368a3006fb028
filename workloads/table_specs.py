"""Table checks from spec rows: two keys, columns to compare, sides that differ."""

from pyspark.sql import functions as F

from tallymark.plans import tables
from workloads.derive import ctes
from workloads.registry import query

# One table per customer: a row per order, keyed by priority and order, with price and a note.
_ROWS = """
SELECT o_custkey AS visual_id, o_orderkey AS row_no, o_orderpriority AS priority, CAST(o_orderkey AS STRING) AS ord,
       CAST(floor(o_totalprice) AS BIGINT) AS n
FROM {orders}
"""
_SPECS = """
SELECT c_custkey AS visual_id, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END AS visual_title, 'Table' AS visual_type,
  c_custkey % 3 AS visual_index, CASE c_custkey % 4 WHEN 0 THEN 'dom' WHEN 1 THEN 'api' ELSE 'auto' END AS tier,
  c_custkey % 5 <> 0 AS has_api, c_custkey % 11 <> 0 AS has_source, c_custkey % 9 = 0 AS wants_tax,
  CAST(CASE WHEN c_custkey % 13 = 0 THEN 0.5 ELSE 0.01 END AS DOUBLE) AS tolerance
FROM {customer}
"""
# What the sides leave out or show differently.
_DOM = "visual_id % 3 <> 0 AND NOT (visual_id % 7 = 0 AND row_no % 3 = 0)"
_API = "visual_id % 8 <> 5"
_OFF = "visual_id % 10 = 4 AND row_no % 5 = 0"

_SQL = f"""
, d AS (SELECT * FROM r WHERE {_DOM}), a AS (SELECT * FROM r WHERE {_API}),
  c AS (SELECT spec.*, (SELECT count(*) FROM d WHERE d.visual_id = spec.visual_id) AS dr,
     (SELECT count(*) FROM a WHERE a.visual_id = spec.visual_id) AS ar,
     (SELECT count(*) FROM r WHERE r.visual_id = spec.visual_id) AS source_rows FROM spec),
  u AS (SELECT *, CASE WHEN tier IN ('auto', 'dom') AND dr > 0 THEN 'dom' WHEN tier = 'dom' THEN 'dom_failed'
     WHEN has_api AND ar > 0 THEN 'api' WHEN tier = 'api' AND NOT has_api THEN 'api_unavailable'
     WHEN tier = 'api' THEN 'api_failed' WHEN has_source THEN 'source' ELSE 'source_unavailable' END AS tier_used FROM c),
  p AS (SELECT *, CASE tier_used WHEN 'dom' THEN dr WHEN 'api' THEN ar ELSE 0 END AS published_rows FROM u),
  x AS (SELECT p.visual_id, p.tolerance, r.ord, r.priority, r.n,
     CASE WHEN {_OFF.replace('visual_id', 'r.visual_id').replace('row_no', 'r.row_no')} THEN r.n * 2 ELSE r.n END AS v,
     CASE p.tier_used WHEN 'dom' THEN {_DOM.replace('visual_id', 'r.visual_id').replace('row_no', 'r.row_no')}
       ELSE {_API.replace('visual_id', 'r.visual_id')} END AS shown
     FROM p JOIN r ON r.visual_id = p.visual_id WHERE p.tier_used IN ('dom', 'api') AND p.has_source AND NOT p.wants_tax),
  y AS (SELECT *, CASE WHEN NOT shown THEN 'missing_in_published'
     WHEN abs(n - v) / greatest(abs(n), abs(v), 1.0) <= tolerance THEN 'match' ELSE 'mismatch' END AS status FROM x),
  s AS (SELECT visual_id, count(*) AS cells, count(*) FILTER (status <> 'match') AS failed_cells FROM y GROUP BY visual_id),
  j AS (SELECT p.*, coalesce(cells, 0) AS cells, coalesce(failed_cells, 0) AS failed_cells,
     CASE WHEN tier_used = 'source' THEN CASE WHEN source_rows > 0 THEN 'ok' ELSE 'source_empty' END
       WHEN tier_used NOT IN ('dom', 'api') THEN tier_used WHEN NOT has_source THEN 'no_source'
       WHEN wants_tax THEN 'missing: tax' WHEN published_rows <> source_rows THEN 'row_counts_differ'
       WHEN failed_cells > 0 THEN 'cells_differ' ELSE 'ok' END AS verdict
     FROM p LEFT JOIN s ON s.visual_id = p.visual_id)
"""


def _checked(t):
    rows = t.sql(_ROWS)

    def cells(df, price):
        return df.select("visual_id", "row_no", F.inline(F.array(*[
            F.struct(F.lit(name).alias("col_name"), value.alias("raw")) for name, value in (
                (" Priority ", F.concat(F.col("priority"), F.lit("\t"))), ("Order", F.col("ord")),
                ("Price\t", price), ("note", F.lit("hello")))])))

    shown = F.concat(F.lit("$"), F.col("n").cast("string"))
    off = F.when(F.expr(_OFF), F.col("n") * 2).otherwise(F.col("n")).cast("string")
    base = F.array(F.lit("Price"))
    specs = t.sql(_SPECS).withColumns({
        "join_keys": F.array(F.lit("PRIORITY"), F.lit("order ")),
        "compare_cols": F.when(F.col("wants_tax"), F.array_append(base, F.lit("Tax"))).otherwise(base)})
    return tables.check_tables(specs, cells(rows.where(_DOM), shown), cells(rows.where(_API), shown),
                               cells(rows, off))


@query("dataset_check", ctes(r=_ROWS, spec=_SPECS) + _SQL + """
SELECT visual_id, CASE WHEN visual_title = '' THEN 'Table[' || visual_index || ']' ELSE visual_title END AS label,
  tier_used, published_rows, source_rows, published_rows = source_rows AS rows_equal, cells, failed_cells, verdict,
  verdict = 'ok' AS passed
FROM j""")
def dataset_check(t):
    return _checked(t)[0]


@query("dataset_lines", ctes(r=_ROWS, spec=_SPECS) + _SQL + """
SELECT visual_id, ord, CASE status WHEN 'mismatch' THEN '[' || priority || ' | ' || ord || ' | price] failed: shown $' || n ||
   ', read as ' || n || '.0000, expected ' || v || '.0000, off by 50.0000% of at most 1.00%'
  ELSE '[' || priority || ' | ' || ord || ' | price] ' || status END AS detail
FROM y WHERE status <> 'match'""")
def dataset_lines(t):
    return tables.cell_lines(_checked(t)[1]).select(
        "visual_id", F.get("row_key", F.lit(1)).alias("ord"), "detail")


# Three ways to meet: unique keys, repeated priorities in order of price, orders by position.
_MODES = """
SELECT c_custkey AS visual_id, c_name AS visual_title, 'Table' AS visual_type, 0 AS visual_index, 'dom' AS tier, false AS has_api,
  true AS has_source, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' Occurrence' ELSE 'positional' END AS align,
  CAST(0.01 AS DOUBLE) AS tolerance
FROM {customer}
"""
_SHOWN = "NOT (visual_id % 7 = 0 AND row_no % 3 = 0)"


@query("dataset_modes", ctes(r=_ROWS, spec=_MODES) + f"""
, g AS (SELECT r.*, visual_id % 3 AS mode, CASE WHEN {_OFF} THEN n * 2 ELSE n END AS v, {_SHOWN} AS shown FROM r),
  p AS (SELECT visual_id, CASE mode WHEN 0 THEN priority || '/' || ord WHEN 1 THEN priority ELSE '' END AS meet,
      CASE mode WHEN 0 THEN 1 WHEN 1 THEN row_number() OVER (PARTITION BY visual_id, priority ORDER BY n)
        ELSE row_number() OVER (PARTITION BY visual_id ORDER BY row_no) END AS occurrence, priority, ord, n
    FROM g WHERE shown),
  s AS (SELECT visual_id, CASE mode WHEN 0 THEN priority || '/' || ord WHEN 1 THEN priority ELSE '' END AS meet,
      CASE mode WHEN 0 THEN 1 WHEN 1 THEN row_number() OVER (PARTITION BY visual_id, priority ORDER BY v)
        ELSE row_number() OVER (PARTITION BY visual_id ORDER BY row_no) END AS occurrence, priority, ord, v
    FROM g WHERE visual_id IN (SELECT visual_id FROM g WHERE shown)),
  j AS (SELECT coalesce(p.visual_id, s.visual_id) AS visual_id, coalesce(p.occurrence, s.occurrence) AS occurrence,
      coalesce(p.priority, s.priority) AS priority, coalesce(p.ord, s.ord) AS ord, p.n, s.v
    FROM p FULL JOIN s ON p.visual_id = s.visual_id AND p.meet = s.meet AND p.occurrence = s.occurrence)
SELECT visual_id, CASE visual_id % 3 WHEN 0 THEN priority || ' | ' || ord WHEN 1 THEN priority ELSE ord END AS row_key, occurrence,
  CAST(n AS DOUBLE) AS published, CAST(v AS DOUBLE) AS source, CASE WHEN n IS NULL THEN 'missing_in_published'
    WHEN v IS NULL THEN 'missing_in_source' WHEN abs(n - v) / greatest(abs(n), abs(v), 1.0) <= 0.01 THEN 'match' ELSE 'mismatch' END AS status
FROM j""")
def dataset_modes(t):
    rows = t.sql(_ROWS)
    mode = F.col("visual_id") % 3
    specs = t.sql(_MODES).withColumns({
        "join_keys": F.when(mode == 0, F.array(F.lit("priority"), F.lit("order"))).when(
            mode == 1, F.array(F.lit("priority"))).otherwise(F.array(F.lit("order"))),
        "compare_cols": F.array(F.lit("price"))})

    def cells(df, price):
        return df.select("visual_id", "row_no", F.inline(F.array(*[
            F.struct(F.lit(name).alias("col_name"), value.alias("raw")) for name, value in (
                ("Priority", F.col("priority")), ("Order", F.col("ord")), ("Price", price))])))

    off = F.when(F.expr(_OFF), F.col("n") * 2).otherwise(F.col("n")).cast("string")
    shown = cells(rows.where(_SHOWN), F.concat(F.lit("$"), F.col("n").cast("string")))
    found = tables.check_tables(specs, shown, shown.limit(0), cells(rows, off))[1]
    return found.select("visual_id", F.array_join("row_key", " | ").alias("row_key"), "occurrence",
                        "published", "source", "status")
