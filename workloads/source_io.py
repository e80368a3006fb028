"""Sources and the result sink, written to and read from the shared folder."""

from pyspark.sql import functions as F

from tallymark.session import shared_path
from tallymark.sources import readers, runs, sinks
from workloads.derive import ctes
from workloads.registry import query


@query("csv_source", """
SELECT c_custkey AS cust_key, c_name AS customer_name, c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def csv_source(t):
    path = shared_path(t.spark, "csv")
    t.customer.select(
        F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias("Customer Name "),
        F.col("c_acctbal").alias("BALANCE"), F.col("c_mktsegment").alias("Segment"),
    ).write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(
        t.spark, path,
        schema="`Cust Key` bigint, `Customer Name ` string, BALANCE double, Segment string")


@query("sheet_source", """
SELECT o_orderkey AS order_key, o_totalprice AS total_sales, o_orderstatus AS status FROM orders""")
def sheet_source(t):
    root = shared_path(t.spark, "book")
    t.orders.select(
        F.col("o_orderkey").alias("Order Key"), F.col("o_totalprice").alias("Total Sales"),
        F.col("o_orderstatus").alias("STATUS"),
    ).write.parquet(f"{root}/Sales_Performance")
    return readers.read_sheet(t.spark, root, "Sales_Performance")


@query("sql_source", """
SELECT o_orderpriority AS "Priority", count(*) AS "Order Count" FROM orders WHERE year(o_orderdate) = 1997 GROUP BY ALL""")
def sql_source(t):
    return readers.read_query(
        t.spark, 'SELECT o_orderpriority AS "Priority", count(*) AS "Order Count" FROM recon_orders '
                 "WHERE year(o_orderdate) = 1997 GROUP BY o_orderpriority",
        {"recon_orders": t.orders}, quoted_names=True)


@query("scalar_source", """
SELECT 'orders' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'none', NULL""")
def scalar_source(t):
    views = {"recon_orders": t.orders}
    count = readers.read_scalar(t.spark, "SELECT count(*) FROM recon_orders", views)
    none = readers.read_scalar(
        t.spark, "SELECT o_totalprice FROM recon_orders WHERE o_totalprice < 0", views)
    return count.select(F.lit("orders").alias("name"), "value").unionByName(
        none.select(F.lit("none").alias("name"), "value"))


@query("result_sink", """
WITH e AS (SELECT event_id, event_type AS suite, date_trunc('hour', ts) AS run_ts, value > 10 AS passed FROM events)
SELECT event_id, suite, passed FROM e WHERE run_ts = (SELECT max(run_ts) FROM e x WHERE x.suite = e.suite)""")
def result_sink(t):
    path = shared_path(t.spark, "results")
    verdicts = t.events.select(
        "event_id", "event_type", "ts", (F.col("value") > 10).alias("passed"))
    sinks.write_results(verdicts, path, F.date_trunc("hour", F.col("ts")), F.col("event_type"))
    return sinks.latest_results(t.spark, path).select("event_id", "suite", "passed")


# Notes with line breaks, quotes and commas; every 50th record of the second file has a field too many.
_NOTES = """
SELECT c_custkey, c_name || chr(10) || 'said "' || c_mktsegment || '", twice' AS note, c_acctbal,
  c_custkey % 2 AS part, c_custkey % 50 = 7 AS bad
FROM {customer}
"""


@query("csv_records", ctes(n=_NOTES) + """
SELECT c_custkey AS cust_key, note, CASE WHEN part = 0 THEN c_acctbal ELSE floor(c_acctbal) END AS balance,
  part = 1 AND bad AS broken FROM n""")
def csv_records(t):
    rows = t.sql(_NOTES)
    tidy, raw = shared_path(t.spark, "csv-tidy"), shared_path(t.spark, "csv-raw")
    rows.where("part = 0").select(F.col("c_custkey").alias("Cust Key"), "note", F.col("c_acctbal").alias(" Balance")).write.option(
        "header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(tidy)
    quoted = F.concat(F.lit('"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), quoted, F.floor("c_acctbal").cast("string"),
                       F.when(F.col("bad"), F.lit("one more")))
    header = t.spark.createDataFrame([(-1, "Cust Key,note, Balance")], "n bigint, value string")
    # The header leads the only file.
    rows.where("part = 1").select(F.col("c_custkey").alias("n"), line.alias("value")).unionByName(header).repartition(
        1).sortWithinPartitions("n").select("value").write.text(raw)
    schema = "`Cust Key` bigint, note string, ` Balance` double"
    read = [readers.read_csv(t.spark, tidy, "ISO-8859-1", schema, broken="broken"),
            readers.read_csv(t.spark, raw, schema=schema, broken="broken")]
    return read[0].unionByName(read[1]).withColumn("broken", F.col("broken").isNotNull())


@query("result_runs", """
WITH e AS (SELECT event_id, event_type AS suite, CAST(ts AS DATE) AS day, value > 10 AS passed FROM events),
  m AS (SELECT suite, max(day) AS day FROM e GROUP BY suite)
SELECT event_id, e.suite, CAST(e.day AS VARCHAR) AS run_id, CASE WHEN e.suite = 'view' THEN NOT passed ELSE passed END AS passed
FROM e JOIN m ON e.suite = m.suite AND e.day = m.day""")
def result_runs(t):
    root = shared_path(t.spark, "runs")
    verdicts = t.events.select("event_id", "event_type", F.to_date("ts").alias("day"), (F.col("value") > 10).alias("passed"))
    day, suite = F.col("day").cast("string"), F.col("event_type")

    def run(df):
        return df, root, day, suite, F.col("day").cast("timestamp")

    runs.write_runs(*run(verdicts))
    again = verdicts.where("event_type = 'view'").withColumn("passed", ~F.col("passed"))
    runs.write_runs(*run(again))  # the runs of one suite are written again
    runs.stage_runs(*run(verdicts.withColumn("passed", F.lit(None).cast("boolean"))))  # and never committed
    return runs.latest_runs(t.spark, root).select("event_id", "suite", "run_id", "passed")
