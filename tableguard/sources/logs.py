"""Reading JSON-lines log files, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableguard.operators.logs import parse_log
from tableguard.plans.joins import checked_broadcast


def read_log_lines(spark: SparkSession, path: str, with_ids: bool = False, per_file: bool = False) -> DataFrame:
    """``(line, file_path, file_modification_time[, id])`` of every line under ``path``.

    ``with_ids`` numbers the lines from 1 (see :func:`line_ids`): over all files in the
    order of their paths, as a log in part files is read, or within each file.
    """
    df = spark.read.text(path)
    columns = [F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"),
               F.col("_metadata.file_modification_time").alias("file_modification_time")]
    if not with_ids:
        return df.select(*columns)
    placed = df.select(*columns, F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    return line_ids(placed, per_file).select("line", "file_path", "file_modification_time", "id")


def line_ids(placed: DataFrame, per_file: bool = False) -> DataFrame:
    """``placed`` with ``id``, the number of each line, by a line-offset index.

    ``placed`` has ``file_path``, ``__block`` (where the split of the file that holds the
    line begins) and ``__at`` (increasing within a split).  The index has a row per split:
    its lines, its first ``__at`` and the lines of all splits before it.  A first scan
    counts, without the texts; ids are sums in the second.  Both scans plan the same
    splits; should they ever differ, the query fails instead of numbering wrongly.
    """
    counts = placed.groupBy("file_path", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    order = Window.partitionBy("file_path").orderBy("__block") if per_file else Window.orderBy("file_path", "__block")
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = counts.select(F.col("file_path").alias("__path"), F.col("__block").alias("__start"), "__n", "__first", before.alias("__before"))
    rows = placed.join(checked_broadcast(index), (F.col("file_path") == F.col("__path")) & (F.col("__block") == F.col("__start")))
    place = F.col("__at") - F.col("__first")
    known = (place >= 0) & (place < F.col("__n"))
    number = F.when(known, F.col("__before") + place + 1).otherwise(F.raise_error(F.lit("the splits changed between two scans")).cast("long"))
    return rows.withColumn("id", number).drop("__path", "__start", "__n", "__first", "__before", "__block", "__at")


def read_json_log(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Parsed entries of a JSON-lines log (see :func:`tableguard.operators.logs.parse_log`)."""
    lines = read_log_lines(spark, path, with_ids=with_ids)
    if not with_ids:
        lines = lines.withColumn("id", F.lit(None).cast("long"))
    return parse_log(lines, "id", "line")


def stream_json_log(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same parse on a streaming text source (new files are picked up as they land)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(path)
    return parse_log(lines.withColumn("id", F.lit(None).cast("long")), "id", "value")
