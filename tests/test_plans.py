"""Plan checks: native operators stay on the JVM (no Python evaluation nodes),
and scans read only the columns they need."""

import pytest

import __spark_entry__ as entry
from tableguard.plans.registry import QUERIES, load_all

load_all()

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
ALLOWED_PYTHON = {"model_spans"}        # the predictor hook is Python by design


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if k not in ALLOWED_PYTHON))
def test_no_python_in_plan(spark, key):
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PYTHON_NODES), key


def test_model_spans_is_map_in_pandas(spark):
    plan = entry.queries()["model_spans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan


def test_column_pruning_reaches_scan(spark):
    plan = entry.queries()["estimate_tokens"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_filter_pushed_to_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = entry.queries()["sql_project_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "GreaterThan(c_acctbal,0.0)" in pushed and "In(c_mktsegment" in pushed


def test_no_nested_loop_in_the_range_join(spark):
    plan = entry.queries()["sql_range_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_building_a_plan_starts_no_job(spark):
    from tableguard.operators.redact import redact_columns
    from tableguard.operators.spans import detect_spans

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grouped = docs.groupBy("doc_id").agg({"text": "max"}).toDF("doc_id", "text")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    redact_columns(grouped)
    detect_spans(grouped, "doc_id", "text")
    jobs = tracker.getJobIdsForGroup("plans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []
