"""Column profiles: one meaning of ``distinct`` at any width."""

from pyspark.sql import functions as F

from tableguard.operators.checks import column_estimates, column_profile


def test_wide_tables_have_exact_counts(spark):
    wide = spark.range(3000).select(*[(F.col("id") % (k + 1)).alias(f"c{k}") for k in range(40)], F.col("id").cast("string").alias("s"))
    got = {r.column: r for r in column_profile(wide).collect()}
    assert all(got[f"c{k}"].distinct == k + 1 for k in range(40)) and got["s"].distinct == 3000 and got["s"].max_bytes == 4


def test_kinds_nulls_ties_and_odd_names(spark):
    rows = [(1.5, [1, 2], {"a": 1, "b": 2}, None, "é", float("nan")), (0.0, [1, 2], {"b": 2, "a": 1}, None, "", float("nan")),
            (-0.0, None, None, None, None, 1.0), (1.5, [], {}, None, "é", None)]
    df = spark.createDataFrame(rows, "`a.b` double, l array<int>, m map<string,int>, n string, `q``t` string, f double")
    got = {r.column: (r.type, r.rows, r.nulls, r.distinct, r.max_bytes) for r in column_profile(df.select("*")).collect()}
    assert got["a.b"] == ("DOUBLE", 4, 0, 2, None) and got["l"][1:4] == (4, 1, 2) and got["m"][1:4] == (4, 1, 2)
    assert got["n"] == ("STRING", 4, 4, 0, None) and got["f"][2:4] == (1, 2)


def test_empty_table(spark):
    got = [tuple(r) for r in column_profile(spark.range(0).select("id", F.lit("x").alias("s"))).orderBy("column").collect()]
    assert got == [("id", "BIGINT", 0, 0, 0, None), ("s", "STRING", 0, 0, 0, None)]


def test_estimates_merge(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"), F.lit(None).cast("string").alias("n"))
    got = {r.column: r.approx_distinct for r in column_estimates(df).collect()}
    assert abs(got["k"] - 1000) < 60 and got["n"] == 0
    both = column_estimates(df.where("k < 600")).unionByName(column_estimates(df.where("k >= 400"))).where("column = 'k'")
    assert abs(both.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).first().n - 1000) < 60
