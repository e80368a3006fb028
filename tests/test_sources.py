import hashlib

import pytest
from pyspark.sql import functions as F

from tallymark import session
from tallymark.operators.captures import api_answers, api_cells, api_rows
from tallymark.sources import readers, runs, sinks


def test_csv_headers_and_encoding(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("Total Sales , Région\n5,Île\n".encode("latin-1"))
    df = readers.read_csv(spark, str(path), encoding="ISO-8859-1")
    assert df.columns == ["total_sales", "région"]
    assert tuple(df.first()) == (5, "Île")
    typed = readers.read_csv(spark, str(path), encoding="ISO-8859-1", schema="a double, b string")
    assert typed.dtypes == [("a", "double"), ("b", "string")]


def test_sheets(spark, tmp_path):
    spark.createDataFrame([(1,)], "`Total Sales` int").write.parquet(str(tmp_path / "Sheet1"))
    assert readers.read_sheet(spark, str(tmp_path)).columns == ["total_sales"]
    assert readers.read_sheet(spark, str(tmp_path), "").count() == 1


def test_queries_with_quoted_names(spark):
    views = {"recon_t": spark.range(3)}
    df = readers.read_query(spark, 'SELECT id AS "My Id" FROM recon_t', views, quoted_names=True)
    assert df.columns == ["My Id"] and df.count() == 3
    assert spark.conf.get(readers.QUOTED_NAMES) == "false"
    assert readers.read_query(spark, "SELECT id FROM recon_t WHERE id > 9").count() == 0


def test_api_answers_empty_at_any_level(spark):
    bodies = ['{"results":[{"tables":[{"rows":[{"[A]":1,"T[B]":"x"}]}]}]}', "{}", '{"results":[]}',
              '{"results":[{"tables":[]}]}', '{"results":[{"tables":[{"rows":[]}]}]}', "oops", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "visual_id int, body string")
    assert {tuple(r) for r in api_rows(df).collect()} == {(0, 0, "a", "1"), (0, 0, "b", "x")}


def test_sink_keeps_history_and_shows_the_latest(spark, tmp_path):
    path = str(tmp_path / "out")
    for day in ("2024-01-01", "2024-01-02"):
        verdicts = spark.createDataFrame([("v", True)], "label string, passed boolean")
        sinks.write_results(verdicts, path, F.lit(day).cast("timestamp"), F.lit("kpi"), files_per_day=1)
    assert spark.read.parquet(path).count() == 2
    assert [str(r.run_date) for r in sinks.latest_results(spark, path).collect()] == ["2024-01-02"]


class Cluster:
    """Stands for a session on a cluster without a shared folder."""

    class sparkContext:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(name, default=None):
            return default


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Cluster)


def test_the_configured_folder_is_used(spark):
    folder = session.checkpoint_dir(spark)
    assert folder == (spark.conf.get(session.CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir())
    assert session.shared_path(spark, "x") != session.shared_path(spark, "x")


def test_api_answers_tell_their_states_apart(spark):
    def body(rows):
        return f'{{"results":[{{"tables":[{{"rows":{rows}}}]}}]}}'

    bodies = {
        "ok": body('[{"[A]":1,"T[B]":"x","c":null,"d":{"e":[true]},"f":1e3,"g":false}, 5, {}]'), "none": None, "text": "oops",
        "blank": "", "object": "{}", "null": "null", "list": "[]", "no results": '{"results":null}', "odd": '{"results":[1]}',
        "odd rows": body('{"a":1}'), "no rows": body("[]"), "null rows": body("null"), "message": '{"error":{"code":"c","message":"m"}}',
        "code": '{"error":{"code":"c"}}', "plain": '{"error":"no"}', "cut": body('[{"a":1}')[:-3]}
    df = spark.createDataFrame(list(bodies.items()), "visual_id string, body string")
    answers = api_answers(df)
    got = {r.visual_id: (r.state, r.message) for r in answers.collect()}
    assert got == {
        "ok": ("ok", None), "none": ("no_body", None), "text": ("broken", None), "blank": ("broken", None), "cut": ("broken", None),
        "object": ("empty", None), "null": ("unexpected", None), "list": ("unexpected", None), "no results": ("empty", None),
        "odd": ("unexpected", None), "odd rows": ("unexpected", None), "no rows": ("empty", None), "null rows": ("empty", None),
        "message": ("error", "m"), "code": ("error", "c"), "plain": ("error", "no")}
    cells = {(r.row_no, r.col_name): (r.kind, r.raw, r.number) for r in api_cells(answers).collect()}
    assert cells == {
        (0, "a"): ("number", "1", 1.0), (0, "b"): ("text", "x", None), (0, "c"): ("null", None, None), (0, "d"): ("object", '{"e":[true]}', None),
        (0, "f"): ("number", "1000.0", 1000.0), (0, "g"): ("boolean", "false", None)}


def test_a_long_body_is_work_for_many_tasks(spark):
    rows = ",".join(f'{{"a":{i},"text":"{hashlib.sha256(bytes([i % 256, i >> 8])).hexdigest()}"}}' for i in range(20_000))
    df = spark.createDataFrame([(1, f'{{"results":[{{"tables":[{{"rows":[{rows}]}}]}}]}}')], "visual_id int, body string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    try:
        cells = api_cells(api_answers(df))
        parts = cells.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in parts) == 40_000
        assert len(parts) > 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", before)


def test_csv_records_across_lines(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.csv").write_text('Id,Note, Value\n1,"line one\nline two",5\n2,"say ""hi"", twice",6\n3,short\n4,x,7,8\n5,y,abc\n')
    (folder / "b.csv").write_text('Id,Note, Value\n6,"é\r\n",9\n')
    df = readers.read_csv(spark, str(folder), schema="id bigint, note string, value bigint", broken="broken")
    got = {r.id: (r.note, r.value, r.broken) for r in df.collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        1: ("line one\nline two", 5), 2: ('say "hi", twice', 6), 3: ("short", None), 4: ("x", 7), 5: ("y", None), 6: ("é\r\n", 9)}
    assert {k: v[2] for k, v in got.items() if v[2]} == {3: "3,short", 4: "4,x,7,8", 5: "5,y,abc"}
    assert df.rdd.getNumPartitions() >= 1 and "broken" not in readers.read_csv(spark, str(folder)).columns
    assert readers.read_csv(spark, str(folder)).count() == 6
    assert readers.read_csv(spark, str(folder), multi_line=False).count() == 8
    wide = tmp_path / "w.csv"
    wide.write_bytes('a,b\n"ü\nö",1\n'.encode("utf-16"))
    assert tuple(readers.read_csv(spark, str(wide), "utf-16").first()) == ("ü\nö", 1)


def test_runs_are_whole_or_not_there(spark, tmp_path):
    root = str(tmp_path / "runs")

    def verdicts(n, passed=True):
        return spark.range(n).select(F.col("id").alias("label"), F.lit(passed).alias("passed")).repartition(3)

    def at(run, suite, day):
        return root, F.lit(run), F.lit(suite), F.lit(day).cast("timestamp")

    lines = runs.write_runs(verdicts(10, False), *at("2024-01-01", "kpi", "2024-01-01")).collect()
    assert [(r.run_id, r.suite, r.rows) for r in lines] == [("2024-01-01", "kpi", 10)]
    runs.write_runs(verdicts(7), *at("2024-01-01", "kpi", "2024-01-01"), files=1)  # written again
    runs.write_runs(verdicts(3), *at("2024-01-01", "table", "2024-01-01"))  # another suite with that id
    runs.stage_runs(verdicts(99), *at("2024-01-02", "kpi", "2024-01-02"))  # never committed
    broken = verdicts(50).withColumn("passed", F.expr("CASE WHEN label = 49 THEN raise_error('lost') ELSE passed END"))
    with pytest.raises(Exception, match="lost"):
        runs.write_runs(broken, *at("2024-01-03", "kpi", "2024-01-03"))
    assert {(r.run_id, r.suite): r.rows for r in runs.run_manifest(spark, root).collect()} == {
        ("2024-01-01", "kpi"): 7, ("2024-01-01", "table"): 3}
    rows = runs.read_runs(spark, root)
    assert rows.where("suite = 'kpi'").count() == 7 and rows.where("passed").count() == 10
    runs.write_runs(verdicts(4), *at("2024-01-04", "kpi", "2024-01-04"))
    latest = runs.latest_runs(spark, root).groupBy("suite", "run_id").count().collect()
    assert {tuple(r) for r in latest} == {("kpi", "2024-01-04", 4), ("table", "2024-01-01", 3)}
    assert runs.read_runs(spark, root).count() == 14
