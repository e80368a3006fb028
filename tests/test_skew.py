from pyspark.sql import functions as F

from tallymark.operators.skew import spread_join


def test_spread_join_equals_a_plain_join(spark):
    left = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None).cast("string"))
        .otherwise((F.col("id") % 20).cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("2", 3), ("nowhere", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi"):
        plain = left.join(right, "k", how)
        spread = spread_join(left, right, ["k"], ["id"], how, parts=5)
        assert spread.columns == plain.columns
        key = lambda r: (str(r[0]), r[1])
        assert sorted(map(tuple, spread.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_a_hot_key_is_shared_by_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(4000).select(F.lit("hot").alias("k"), "id")
        right = spark.createDataFrame([("hot", 1)], "k string, v int")
        joined = spread_join(left, right, ["k"], ["id"]).withColumn("task", F.spark_partition_id())
        assert joined.select("task").distinct().count() > 4
        assert joined.count() == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_only_large_keys_are_spread(spark, monkeypatch):
    from tallymark.operators import skew

    monkeypatch.setattr(skew, "WHOLE_ROWS", 5)
    left = spark.range(30).selectExpr("id", "IF(id < 20, 0, id) AS k", "IF(id < 20, 20, 1) AS n")
    right = left.select("k", "n").distinct().withColumn("name", F.col("k") * 2)
    joined = spread_join(left, right, ["k"], ["id"], parts=4, size="n")
    assert sorted((r.id, r.n, r.name) for r in joined.collect()) == [(i, 20, 0) if i < 20 else (i, 1, 2 * i) for i in range(30)]
    made = [line for line in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "sequence(0, CASE" in line]
    assert made
