"""Streaming log analysis: level counts per hour, whole however late a line comes, and the newest entries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from tableguard.operators.logs import DEFAULT_LIMIT, level_counts

BUCKETS = 16        # groups whose newest entries are kept apart, so that no single task sees all lines


def write_level_counts(parsed: DataFrame, path: str, checkpoint: str) -> None:
    """Count the entries of a parsed log stream per (level, hour), batch by batch.

    Every micro-batch writes its own partial counts to ``path/batch=N`` (overwritten
    if the batch is run again), so there is no state to keep, no watermark, and no
    line is too late to count.
    """
    def partial(batch: DataFrame, number: int) -> None:
        level_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = (parsed.writeStream.foreachBatch(partial).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_level_counts(spark, path: str) -> DataFrame:
    """``(level, hour, entries)`` summed over all batches written so far."""
    parts = spark.read.schema("level string, hour timestamp, entries bigint, batch bigint").parquet(path)
    return parts.groupBy("level", "hour").agg(F.sum("entries").alias("entries"))


def write_latest(parsed: DataFrame, path: str, checkpoint: str, limit: int = DEFAULT_LIMIT, buckets: int = BUCKETS) -> None:
    """Keep the newest ``limit`` valid entries (largest ``id``) of a parsed log stream.

    Lines are dealt by id into ``buckets`` groups; each group's state, in Spark's state
    store, is its ``limit`` newest entries, however many lines come.  A micro-batch writes
    the groups it changed to ``path/batch=N`` (overwritten if the batch is run again), and
    a restarted query goes on from the checkpointed state.
    """
    n = limit if limit > 0 else DEFAULT_LIMIT

    def newest(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for part in parts:      # bounded pieces of the group's new lines
            kept = heapq.nlargest(n, [*kept, *zip(part["id"].tolist(), part["entry"].tolist())])
        state.update(tuple(map(list, zip(*kept))))
        yield pd.DataFrame([(key[0], i, e) for i, e in kept], columns=["bucket", "id", "entry"])

    rows = parsed.where(F.col("valid") & F.col("id").isNotNull())
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), F.col("id").cast("long").alias("id"),
                       F.to_json(F.struct(*[c for c in parsed.columns if c != "id"])).alias("entry"))
    tops = rows.groupBy("bucket").applyInPandasWithState(
        newest, "bucket int, id bigint, entry string", "ids array<bigint>, entries array<string>", "update", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = (tops.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_latest(spark, path: str, like: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest ``limit`` entries kept so far, newest first, with the columns of the parsed log ``like``."""
    n = limit if limit > 0 else DEFAULT_LIMIT
    rows = spark.read.schema("bucket int, id bigint, entry string, batch bigint").parquet(path)
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    fields = [f for f in like.schema.fields if f.name != "id"]
    entry = F.from_json("entry", StructType(fields), {"mode": "FAILFAST"})
    top = rows.join(last, ["bucket", "batch"]).orderBy(F.col("id").desc()).limit(n)
    return top.select("id", entry.alias("e")).select("id", "e.*").select(*like.columns)
