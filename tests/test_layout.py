"""Layout of the registered queries' inputs."""

import glob

from pyspark.sql import functions as F

from tableguard.plans.layout import dealt
from tableguard.session import ensure_checkpoint_dir


def _one_row_group(spark, path, rows):
    rows.coalesce(1).write.parquet(str(path))
    return str(path)


def test_rows_of_one_row_group_are_dealt_evenly(spark, tmp_path):
    """A file of many splits whose rows all lie in one of them."""
    path = _one_row_group(spark, tmp_path / "t", spark.range(4000).withColumn("text", F.sha2(F.col("id").cast("string"), 512)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= 16
        assert scan.select(F.spark_partition_id()).distinct().count() == 1
        parts = [r["count"] for r in dealt(scan).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(parts) >= 16 and sum(parts) == 4000 and max(parts) <= 2 * 4000 / len(parts)


def test_stream_lands_files_for_all_cores(spark, tmp_path):
    import __spark_entry__ as entry

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("mail a"), "id", F.lit("@b.org now")).alias("text"),
                                   F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(20).cast("long").alias("n_chars"))
    _one_row_group(spark, tmp_path / "documents.parquet", docs)
    base = ensure_checkpoint_dir(spark).removeprefix("file:").rstrip("/")
    before = set(glob.glob(f"{base}/tables/landing-*"))
    got = entry.queries()["redact_stream"](spark, str(tmp_path)).collect()
    assert len(got) == 200 and {r.text for r in got} == {"mail [REDACTED_email] now"}
    landed, = set(glob.glob(f"{base}/tables/landing-*")) - before
    assert len(glob.glob(f"{landed}/*.parquet")) >= 8
