"""Masking, tokens, budgets, batches and skew-safe numbering."""

from tableguard.operators.shaping import assign_batches, mask_long_text, sequence_rows, split_by_budget


def test_mask_multi_and_single(spark):
    long = "x" * 201
    df = spark.createDataFrame([(1, "short", long), (2, None, "s")], "id long, a string, b string")
    got = {r.id: r for r in mask_long_text(df).collect()}
    assert got[1].a == "short" and got[1].b == "<TEXT>" and got[2].b == "<TEXT>" and got[2].a is None
    one = mask_long_text(df.where("id = 1")).first()
    assert one.b == long


def test_mask_counts_bytes(spark):
    df = spark.createDataFrame([(1, "é" * 101), (2, "a")], "id long, t string")   # 202 bytes, 101 chars
    assert {r.t for r in mask_long_text(df).collect()} == {"<TEXT>"}


def test_budget(spark):
    df = spark.createDataFrame([(1, "a" * 7000), (1, "b"), (2, "c" * 6999)], "k long, t string")
    got = {r.k: r for r in split_by_budget(df, "k", "t").collect()}
    assert got[1].est_tokens == 2001 and not got[1].accepted and got[2].est_tokens == 2000 and not got[2].accepted


def test_sequence_rows_hot_key(spark):
    data = [(0, i) for i in range(3000)] + [(k, i) for k in range(1, 50) for i in range(20)]
    df = spark.createDataFrame(data, "k long, o long")
    got = sequence_rows(df, ["k"], ["o"], partitions=16).collect()
    assert all(r.rn == r.o + 1 for r in got) and len(got) == len(data)
    glob = sequence_rows(spark.range(1000).withColumnRenamed("id", "o"), [], ["o"], partitions=7).collect()
    assert sorted(r.rn for r in glob) == list(range(1, 1001)) and all(r.rn == r.o + 1 for r in glob)


def test_sequence_rows_with_payload_above_the_range_sample(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").withColumn("payload", F.repeat(F.lit("p"), 50))
    orders = orders.withColumn("k", F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_custkey") % 50))
    got = sequence_rows(orders, ["k"], ["o_orderkey"], partitions=12)
    want = orders.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o_orderkey")).cast("long"))
    key = ["o_orderkey", "payload", "rn"]
    assert got.count() == orders.count() and got.select(key).exceptAll(want.select(key)).count() == 0


def test_batches_keep_every_row_at_sf01(spark):
    conv = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    got = assign_batches(conv, "text", ["turn"], ["conv_id"])
    assert got.count() == conv.count() == got.select("conv_id", "turn").distinct().count()


def test_batches_brute_force(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = {(r.conv_id, r.turn): r.batch_no for r in assign_batches(conv, "text", ["turn"], ["conv_id"]).collect()}
    by = {}
    for r in conv.collect():
        by.setdefault(r.conv_id, []).append(r)
    for k, rs in by.items():
        rs.sort(key=lambda r: r.turn)
        total = sum(len((r.text or "").encode()) for r in rs)
        per = max(1, 1500 // max(1, -(-total // len(rs))))
        for i, r in enumerate(rs):
            assert got[(k, r.turn)] == (i // per if total > 1800 else 0)


def test_cluster_settings_scale_with_input():
    from tableguard.session import cluster_settings

    small = cluster_settings(8, 10 << 20)
    big = cluster_settings(8000, 100 << 40)           # 1000 executors x 8 cores, 100 TB
    assert int(small["spark.sql.shuffle.partitions"]) == 24
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (128 << 20)
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
