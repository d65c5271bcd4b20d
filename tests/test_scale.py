from webledger import scale


def skewed(spark):
    return spark.createDataFrame(
        [("hot" if i % 3 else f"k{i}", i) for i in range(120)] + [(None, 1000 + i) for i in range(40)], "k string, v int"
    )


def test_salted_join_equals_the_plain_one(spark):
    many = skewed(spark)
    one = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("unused", 4)], "k string, w int")
    for how in ("left", "inner"):
        plain = many.join(one, "k", how)
        salted = scale.join_to_one(many, one, ["k"], ["v"], how, hot_rows=10)
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))
    assert {r.k for r in scale.hot_keys(many, ["k"], 10).collect()} == {"hot", None}


def test_a_salted_key_reaches_several_tasks(spark):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = spark.createDataFrame([("hot", 1)], "k string, w int")
        joined = scale.join_to_one(skewed(spark), one, ["k"], ["v"], hot_rows=10)
        tasks = joined.where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks > 1


def test_row_numbers_in_chunks(spark):
    plain = scale.with_row_number(skewed(spark), ["k"], ["v"], "n", hot_rows=None)
    chunked = scale.with_row_number(skewed(spark), ["k"], ["v"], "n", hot_rows=10)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(chunked) == rows(plain) and chunked.schema == plain.schema
    two = skewed(spark).selectExpr("k", "cast(v % 2 as string) j", "v")
    plain = scale.with_row_number(two, ["k", "j"], ["v"], "n", hot_rows=None)
    assert rows(scale.with_row_number(two, ["k", "j"], ["v"], "n", hot_rows=10)) == rows(plain)


def test_a_measured_table_is_broadcast_only_when_small(spark, monkeypatch):
    one = spark.createDataFrame([("hot", 1)], "k string, w int")
    small = scale.join_small(skewed(spark), one, ["k"], ["v"])
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1)
    large = scale.join_small(skewed(spark), one, ["k"], ["v"])
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
    assert large.count() == small.count()


def test_working_tables_go_where_the_session_says(spark):
    stored = scale.store(skewed(spark), "t")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(f.replace("file://", "").startswith(folder) for f in stored.inputFiles())
