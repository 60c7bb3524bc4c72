"""Sharding by jump consistent hashing.

``assign_shards`` maps a stable key to one of ``n_shards`` shards.  The shard is a
pure function of the key and the shard count, so there is no ring table to keep,
and going from n to n + 1 shards moves only the rows that land in the new shard
(about 1/(n + 1) of them).

Defined results
* Null keys all get the shard of one fixed key value (they are one key).
* Null texts have no bytes: size ``overhead``, checksum of no bytes (0).
* Repeated rows get the same shard and different slots.
* Texts of any length are read whole, once; only size and checksum are carried on.
* ``with_slots`` keeps all columns, whatever their names; only one named as the slot
  column is replaced.  ``document_shards`` reads id and text alone.
* An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableguard.llm.common import shuffle_width, written

NULL_KEY = 0x6A756D70  # fixed key that stands for a null


def jump_hash(keys, n_shards: int):
    """Shard of each 64-bit key (numpy), for ``n_shards`` >= 1.

    Follows the published recurrence (Lamping and Veach, 2014): a key jumps to ever
    later shards with a pseudo-random step until it passes the last one.
    """
    import numpy as np

    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    state = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = np.floor((shard[live] + 1) * (float(1 << 31) / step))
        on = jump < n_shards
        live, jump = live[on], jump[on]
        shard[live] = jump.astype(np.int64)
    return shard.astype(np.int32)


def _shard_udf(n_shards: int):
    @F.pandas_udf("int")
    def of(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(jump_hash(k.to_numpy(), n_shards))

    return of


def assign_shards(df: DataFrame, key: str, n_shards: int, grown: int | None = None,
                  shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """``df`` with its shard, and with its shard among ``grown`` shards if given."""
    key64 = F.xxhash64(F.coalesce(F.col(key), F.lit(NULL_KEY).cast(df.schema[key].dataType)))
    out = df.withColumn(shard_col, _shard_udf(n_shards)(key64))
    return out.withColumn(grown_col, _shard_udf(grown)(key64)) if grown else out


def with_slots(df: DataFrame, shard_col: str, order: list[str], slot_col: str = "slot",
               chunks: int | None = None) -> DataFrame:
    """Number the rows of each shard 0, 1, 2, ... without a window over a whole shard.

    Rows are hashed on ``order`` into chunks, numbered inside (shard, chunk), and
    shifted by the number of rows in the shard's earlier chunks.  The table of
    chunk sizes has ``n_shards x chunks`` rows, however large a shard is.
    """
    chunks = chunks or 4 * shuffle_width(df.sparkSession)
    # the row travels as one struct, so no helper column can clash with its columns
    keys = [f"k{i}" for i in range(len(order))]
    part = df.select(F.struct("*").alias("row"), F.col(shard_col).alias("s"), *[F.col(c).alias(k) for c, k in zip(order, keys)],
                     F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int").alias("chunk"))
    sizes = part.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("s").alias("of"), F.col("chunk").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("s", "chunk").orderBy(*keys)
    numbered = part.withColumn("place", F.row_number().over(inside))
    joined = numbered.join(shift, F.col("s").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")))
    kept = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c != slot_col]
    return joined.select(*kept, (F.col("shift") + F.col("place") - 1).cast("long").alias(slot_col))


def document_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                    overhead: int = 8) -> DataFrame:
    """Shard, slot and next-size shard of every document (one row per input row)."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = docs.select(F.col(id_col), (F.octet_length(data).cast("long") + overhead).alias("size"),
                       F.crc32(data).alias("text_crc32"))
    # texts are read and hashed once; sizes of chunks and slots both come from this small table
    rows = written(assign_shards(rows, id_col, n_shards, n_shards + 1), "shards")
    rows = with_slots(rows, "shard", [id_col, "text_crc32", "size"])
    return rows.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def moved_rows(shards: DataFrame) -> DataFrame:
    """Per new shard, how many rows move when one shard is appended."""
    return (shards.filter("shard <> grown_shard").groupBy(F.col("grown_shard").alias("shard"))
            .agg(F.count(F.lit(1)).alias("rows_in")))


def write_shards(df: DataFrame, path: str, key: str, n_shards: int, max_rows_per_file: int = 1_000_000) -> None:
    """Write ``df`` as one folder per shard; files split at ``max_rows_per_file``.

    Rows are spread over (shard, hash) before writing, so a shard is written by
    many tasks.
    """
    out = assign_shards(df, key, n_shards)
    spread = max(1, shuffle_width(df.sparkSession) // n_shards)
    out = out.repartition(F.col("shard"), F.pmod(F.xxhash64(key), F.lit(spread)))
    out.write.partitionBy("shard").option("maxRecordsPerFile", max_rows_per_file).parquet(path)
