"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a side may hold to be broadcast.  Sides we broadcast are small by construction
# (label lists, per-source flags, filter lists); the check makes the bound explicit
# and falls back to a shuffle join above it.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 32 << 20


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` if it holds at most ``max_rows`` rows and ``max_bytes`` bytes, else ``df``.

    Bytes are those of the rows as JSON.  The check reads ``max_rows + 1`` rows at most.
    """
    some = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
    n, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df
