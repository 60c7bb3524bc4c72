"""Spark session helpers.

The library never creates a session on its own inside an operator; tests,
``bench.py`` and the command-line helpers call :func:`get_spark`.  On a cluster
the caller's session is used as it is: only settings that are still unset get a
default here.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings we want on every session.  AQE re-plans joins and coalesces
# shuffle partitions at run time; skew join splits hot partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tableguard") -> SparkSession:
    """Return the active session or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    master = master or os.environ.get("TABLEGUARD_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    parts = shuffle_partitions or int(os.environ.get("TABLEGUARD_SHUFFLE_PARTITIONS", "8"))
    builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = builder.config("spark.driver.memory", os.environ.get("TABLEGUARD_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3...);
    we read it from the session.  A scratch folder of our own is made only for a
    local master, where driver and executors are one process; elsewhere an unset
    folder is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="tableguard-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return spark.sparkContext.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def written(df, name: str):
    """``df`` written once to the shared scratch folder and read back: a fixed table whose readers do not compute it again."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cluster_settings(total_cores: int, input_bytes: int, target_partition_bytes: int = 128 << 20) -> dict:
    """Settings for a large cluster run, sized from the cores and the input.

    * scans split at ``target_partition_bytes`` (128 MB), so a task's text fits
      in executor memory with room for the regex arrays built per row;
    * shuffles start with enough partitions for both the cores (3 waves) and
      the data (one target size each); AQE then coalesces small ones and
      splits skewed ones (a hot key, a hot source) at run time;
    * a broadcast is never chosen from estimates above 64 MB.
    """
    by_data = max(1, input_bytes // target_partition_bytes)
    parts = max(3 * total_cores, by_data)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def apply_cluster_settings(spark: SparkSession, total_cores: int, input_bytes: int) -> dict:
    """Apply :func:`cluster_settings` for keys the session does not set yet."""
    applied = {}
    for k, v in cluster_settings(total_cores, input_bytes).items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
            applied[k] = v
    ensure_checkpoint_dir(spark)
    return applied
