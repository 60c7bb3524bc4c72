"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableguard.session import scratch_path

ROWS_IN_FILE = 1 << 17
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder that all executors share."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, compression: str | None = None, rows: int | None = None) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    This cuts the lineage: a lost executor costs the readers nothing, and several
    readers do not compute ``df`` again.  ``rows``: for short rows behind a shuffle, a bound
    on their number; the table gets a file for each ``ROWS_IN_FILE`` of these at most, where it
    would have one for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_IN_FILE)))
    path = shared_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(rows: DataFrame, run, shape) -> DataFrame:
    """``mapInArrow`` over batches of about ``BATCH_BYTES``, if the session sets no other bound.

    Spark's own bounds are 10,000 rows and 64 MB, and the executor holds several copies
    of a batch beside its heap, Python some more.  A longer row is a batch of its own.
    """
    conf = rows.sparkSession.conf
    if conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return rows.mapInArrow(run, shape)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")), F.lit(n))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches_by_bytes(table, col: str, limit: int):
    """Slices of an Arrow batch whose ``col`` holds about ``limit`` bytes each (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(table.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size + 1)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield table.slice(start, stop - start)
        start = stop
