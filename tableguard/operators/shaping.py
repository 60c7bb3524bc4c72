"""Result shaping: long-text masking, token estimates, budgets, batches, paging."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableguard.plans.joins import checked_broadcast
from tableguard.session import scratch_path

# --- fixed values: limits the reference states ---
LONG_TEXT_BYTES = 200          # a string longer than this (in bytes) is "long"
LONG_TEXT_MARKER = "<TEXT>"
BYTES_PER_TOKEN = 3.5          # token estimate = ceil(bytes / 3.5)
MAX_PAYLOAD_TOKENS = 2000      # payloads of this many estimated tokens are refused
BATCH_TARGET_BYTES = 1500      # target bytes per batch
BATCH_ONLY_ABOVE_BYTES = 1800  # results up to this size stay one batch
DEFAULT_PAGE_ROWS = 10
# --- end of fixed values ---


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _long_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: row count and the longest value (bytes) of every string column."""
    return df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.max(F.octet_length(F.col(c))).alias(f"__max{i}") for i, c in enumerate(cols)])


def mask_long_text(df: DataFrame, limit: int = LONG_TEXT_BYTES, marker: str = LONG_TEXT_MARKER) -> DataFrame:
    """Mask whole columns that hold a long string, when the result has >1 row.

    Two passes: one global aggregate (partial per task, one row at the end)
    and the masking scan, joined to that single row by a broadcast.  The
    input is read twice, so it must be deterministic; cache it if it is costly.
    A one-row result is left whole, nulls stay null.
    """
    cols = _string_columns(df)
    if not cols:
        return df
    stats = _long_stats(df, cols)
    joined = df.crossJoin(F.broadcast(stats))       # exactly one row: bounded by construction
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            long_col = (F.col("__n") > 1) & (F.col(f"__max{i}") > limit)
            out.append(F.when(long_col & F.col(c).isNotNull(), F.lit(marker)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def long_text_columns(df: DataFrame, limit: int = LONG_TEXT_BYTES) -> DataFrame:
    """``(column, max_bytes, is_long)`` for every string column."""
    cols = _string_columns(df)
    stats = _long_stats(df, cols)
    pairs = ", ".join(f"'{c}', __max{i}" for i, c in enumerate(cols))
    return (stats.selectExpr("__n", f"stack({len(cols)}, {pairs}) AS (column, max_bytes)")
            .select("column", F.col("max_bytes").cast("long").alias("max_bytes"),
                    ((F.col("__n") > 1) & (F.coalesce(F.col("max_bytes"), F.lit(0)) > limit)).alias("is_long")))


def estimate_tokens(col: Column) -> Column:
    """Estimated tokens of a text: ceil(bytes / 3.5)."""
    return F.ceil(F.octet_length(col) / F.lit(BYTES_PER_TOKEN)).cast("long")


def with_token_estimate(df: DataFrame, col: str, out_col: str = "est_tokens") -> DataFrame:
    return df.withColumn(out_col, estimate_tokens(F.col(col)))


def split_by_budget(df: DataFrame, key: str, col: str, budget: int = MAX_PAYLOAD_TOKENS) -> DataFrame:
    """One verdict per payload (group): estimated tokens and ``accepted``.

    A plain aggregate, combined map-side, so a hot key costs no more than any
    other; the estimate is taken on the group's total bytes.
    """
    agg = df.groupBy(key).agg(F.sum(F.octet_length(F.col(col))).cast("long").alias("n_bytes"),
                             F.count(F.lit(1)).alias("n_rows"))
    tokens = F.ceil(F.col("n_bytes") / F.lit(BYTES_PER_TOKEN)).cast("long")
    return agg.select(key, "n_rows", "n_bytes", tokens.alias("est_tokens"),
                      (tokens < budget).alias("accepted"))


def sequence_rows(df: DataFrame, key_cols: list[str], order_cols: list[str], out_col: str = "rn",
                  partitions: int | None = None) -> DataFrame:
    """1-based row number per key in ``order_cols`` order, skew-safe.

    ``key_cols`` + ``order_cols`` must be unique.  Instead of a window per key
    (one task per key, so a hot key lands on one core), rows are
    range-partitioned on (key, order) -- a hot key spreads over many
    partitions -- and sorted inside each partition.  This layout is written once to
    the shared scratch folder, since a second evaluation would draw other range
    bounds.  Counts per (partition, key) then give each partition's offset within
    its key; that table has at most (#partitions + #keys) rows.  Null keys are one
    key.  With no key, this is a global row number.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = key_cols + order_cols
    laid = (df.repartitionByRange(n, *sort_cols).sortWithinPartitions(*sort_cols)
            .select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().alias("__local")))
    path = scratch_path(spark, f"sequence-{uuid.uuid4().hex}")
    laid.write.parquet(path)
    ranged = spark.read.schema(laid.schema).parquet(path)
    counts = (ranged.groupBy("__pid", *key_cols)
              .agg(F.count(F.lit(1)).alias("__cnt"), F.min("__local").alias("__first")))
    w = Window.partitionBy(*key_cols).orderBy("__pid") if key_cols else Window.orderBy("__pid")
    offsets = counts.select(F.col("__pid").alias("__opid"), "__first", *[F.col(k).alias(f"__o_{k}") for k in key_cols],
                            F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    same = F.col("__pid") == F.col("__opid")
    for k in key_cols:
        same = same & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    rn = (F.col("__off") + F.col("__local") - F.col("__first") + 1).cast("long")
    return ranged.join(checked_broadcast(offsets), same).select(*df.columns, rn.alias(out_col))


def assign_batches(df: DataFrame, text_col: str, order_cols: list[str], key_cols: list[str] | None = None,
                   out_col: str = "batch_no") -> DataFrame:
    """Consecutive row batches of about 1500 bytes per key (or globally).

    avg = ceil(total bytes / rows); rows per batch = max(1, floor(1500 / avg));
    a result of at most 1800 bytes stays one batch (batch 0).
    """
    keys = key_cols or []
    sizes = df.groupBy(*keys).agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)))
                                  .cast("long").alias("__total"),
                                  F.count(F.lit(1)).alias("__rows"))
    avg = F.ceil(F.col("__total") / F.col("__rows"))
    per = F.greatest(F.lit(1), F.floor(F.lit(BATCH_TARGET_BYTES) / F.greatest(avg, F.lit(1))))
    sizes = sizes.select(*keys, "__total", per.cast("long").alias("__per"))
    numbered = sequence_rows(df, keys, order_cols, "__rn")
    if keys:
        sizes = sizes.select("__total", "__per", *[F.col(k).alias(f"__s_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
        joined = numbered.join(sizes, same)
    else:
        joined = numbered.crossJoin(F.broadcast(sizes))   # one row
    batch = F.when(F.col("__total") > BATCH_ONLY_ABOVE_BYTES,
                   F.floor((F.col("__rn") - 1) / F.col("__per"))).otherwise(F.lit(0)).cast("long")
    return joined.select(*df.columns, batch.alias(out_col))


def page(df: DataFrame, order_cols: list[str], limit: int = DEFAULT_PAGE_ROWS, offset: int = 0) -> DataFrame:
    """ORDER BY ... LIMIT n OFFSET m; planned as a top-k, not a full sort."""
    return df.orderBy(*order_cols).offset(offset).limit(limit) if offset else df.orderBy(*order_cols).limit(limit)
