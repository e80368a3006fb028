"""Run logs and run summaries."""

from pyspark.sql import functions as F

from tallymark.plans import runs
from workloads.derive import LOG, ctes
from workloads.registry import query

# Gaps and islands in one window per test.
_LINES = """
, mk AS (SELECT *, CASE WHEN regexp_matches(msg, '^STEP\\d_START\\|.') THEN 'S' WHEN regexp_matches(msg, '^STEP\\d_END')
           THEN 'E' END AS mark FROM l),
  st AS (SELECT *, sum(CASE WHEN mark = 'S' THEN 1 ELSE 0 END) OVER w AS step,
           last_value(mark IGNORE NULLS) OVER w AS state FROM mk WINDOW w AS (PARTITION BY test_id ORDER BY seq)),
  li AS (SELECT test_id, CAST(step AS BIGINT) AS step, seq, level, msg, coalesce(mark, '') = 'S' AS is_start,
           coalesce(mark, '') <> 'S' AND (level = 'ERROR' OR starts_with(msg, 'FAIL') OR contains(msg, 'AssertionError')) AS failed
         FROM st WHERE state = 'S'),
  sp AS (SELECT test_id, step, max(CASE WHEN is_start THEN CAST(substr(msg, 5, 1) AS INT) END) AS step_no,
           max(CASE WHEN is_start THEN substr(msg, 13) END) AS title, count(*) FILTER (NOT is_start) AS lines,
           bool_or(failed) AS failed FROM li GROUP BY ALL)
"""


@query("log_step_lines", ctes(l=LOG) + _LINES + "SELECT * FROM li")
def log_step_lines(t):
    return runs.step_lines(t.sql(LOG))


@query("log_steps", ctes(l=LOG) + _LINES + "SELECT * FROM sp")
def log_steps(t):
    return runs.steps(runs.step_lines(t.sql(LOG)))


_RESULTS = """
SELECT 'T' || CAST(user_id AS STRING) AS test_id, CASE WHEN user_id % 3 = 0 THEN 'failed' ELSE 'passed' END AS outcome,
  CASE user_id % 4 WHEN 0 THEN 'trace' || chr(10) || 'E   AssertionError: 3 of ' || CAST(user_id AS STRING) || ' differ ' || chr(10) || 'E   assert x'
    WHEN 1 THEN 'trace' || chr(10) || 'E   assert ' || CAST(user_id AS STRING) || ' == 0' WHEN 2 THEN 'E   Timeout' ELSE '' END AS error_text
FROM (SELECT DISTINCT user_id FROM {events}) u
"""


@query("last_failed_steps", ctes(l=LOG, r=_RESULTS) + _LINES + """
, la AS (SELECT sp.*, step = max(step) OVER (PARTITION BY test_id) AS is_last, CAST(substr(test_id, 2) AS BIGINT) AS u FROM sp),
  bl AS (SELECT *, is_last AND u % 3 = 0 AND NOT failed AS blamed FROM la)
SELECT test_id, step, step_no, title, lines, failed OR blamed AS failed, CASE WHEN blamed THEN
  CASE u % 4 WHEN 0 THEN '3 of ' || u || ' differ' WHEN 1 THEN 'assert ' || u || ' == 0' ELSE 'Test failed' END END AS summary
FROM bl""")
def last_failed_steps(t):
    steps = runs.steps(runs.step_lines(t.sql(LOG)))
    return runs.mark_last_steps(steps, t.sql(_RESULTS))


_TESTS = """
SELECT CASE o_orderkey % 5 WHEN 0 THEN 'test_kpi_discover_visuals' WHEN 1 THEN 'test_all_kpis' WHEN 2 THEN 'test_all_tables'
  WHEN 3 THEN 'test_table_row_counts' ELSE 'test_pages_exist' END AS name,
  CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'skipped' ELSE 'passed' END AS outcome,
  o_custkey % 60 AS duration, o_orderstatus AS suite
FROM {orders}
"""
_SUMMARY = """count(*) AS total, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'failed') AS failed,
  count(*) FILTER (outcome = 'skipped') AS skipped, CAST(sum(duration) AS BIGINT) AS duration,
  round(100.0 * count(*) FILTER (outcome = 'passed') / count(*), 1) AS pass_rate,
  round(100.0 * count(*) FILTER (outcome = 'failed') / count(*), 1) AS fail_rate"""


@query("run_summary", ctes(t=_TESTS) + f"SELECT suite, {_SUMMARY} FROM t GROUP BY suite")
def run_summary(t):
    return runs.run_summary(t.sql(_TESTS), ["suite"])


@query("run_groups", ctes(t=_TESTS) + f"""
SELECT CASE WHEN contains(name, 'discover') THEN 'GROUP 1 — VISUAL DISCOVERY' WHEN contains(name, 'kpi') THEN 'GROUP 2 — KPI VALIDATION'
  WHEN contains(name, 'table') THEN 'GROUP 3 — TABLE VALIDATION' ELSE 'GROUP 4 — OTHER DASHBOARD TESTS' END AS test_group, {_SUMMARY}
FROM t GROUP BY ALL""")
def run_groups(t):
    return runs.grouped_summary(t.sql(_TESTS))


_RUNS = """
SELECT event_type || CAST(user_id % 10 AS STRING) AS suite, ts, event_id AS run_id, event_id % 3 = 0 AS passed FROM {events}
"""


@query("latest_run", ctes(r=_RUNS) + """
SELECT suite, ts, run_id, passed FROM r QUALIFY row_number() OVER (PARTITION BY suite ORDER BY ts DESC, run_id DESC) = 1""")
def latest_run(t):
    return runs.latest_runs(t.sql(_RUNS), ["suite"], "ts")
