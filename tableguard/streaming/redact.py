"""Streaming versions of the stateless operators.

Redaction and log parsing are per-row expressions, so the batch operators run
on a streaming DataFrame unchanged; these helpers only wire the source and the
sink.  Long-text masking needs a full pass over a finished result and has no
streaming form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableguard.operators.redact import redact_columns


def redact_stream(stream: DataFrame, columns: list[str] | None = None, labels=None,
                  threshold: float = 0.6) -> DataFrame:
    """``redact_columns`` on a streaming DataFrame (no state, append mode)."""
    return redact_columns(stream, columns, labels, threshold)


def parquet_stream(spark: SparkSession, path: str, like: DataFrame, max_files_per_trigger: int | None = None
                   ) -> DataFrame:
    """A file stream over ``path`` with the schema of ``like`` (streams need one)."""
    reader = spark.readStream.schema(like.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available now into Parquet files at ``path`` and read them.

    Checkpointed, so a restarted query resumes where it stopped; the file sink
    commits each micro-batch once.
    """
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
