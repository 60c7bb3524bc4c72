"""Whole-cell PII redaction: detect, resolve overlaps, splice, column by column.

The same spans decide here, in span-based redaction and in the inventory, so a cell
is redacted alike whichever operator sees it.  Everything is a per-row expression:
no shuffle, and it works on streaming DataFrames as is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableguard.functions.pii_labels import DEFAULT_THRESHOLD
from tableguard.operators.spans import redact_with_spans
from tableguard.plans.joins import checked_broadcast


def _targets(df: DataFrame, columns: list[str] | None) -> list[str]:
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    bad = set(columns or []) - set(strings)
    if bad:
        raise ValueError(f"not string columns: {sorted(bad)}")
    return [c for c in strings if columns is None or c in columns]


def redact_columns(df: DataFrame, columns: list[str] | None = None, labels=None,
                   threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Redact every ``StringType`` column (or the given ones); other types untouched."""
    out = df
    for c in _targets(df, columns):
        out = redact_with_spans(out, c, threshold, labels)
    return out.select(*df.columns)


def redact_enabled(df: DataFrame, source_col: str, enabled: DataFrame, columns: list[str] | None = None,
                   labels=None, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Redact only rows whose source has ``pii_enabled`` true (default off).

    ``enabled`` is a table ``(source, pii_enabled)``, one row per configured
    source -- a connection list, small by nature; it is still size-checked
    before it is broadcast.  Only an exact ``true`` switches redaction on.
    """
    flags = (enabled.select(F.col("source").alias("__src"),
                            (F.col("pii_enabled") == F.lit(True)).alias("__on"))
             .groupBy("__src").agg(F.max("__on").alias("__on")))
    joined = df.join(checked_broadcast(flags), df[source_col] == F.col("__src"), "left")
    on = F.coalesce(F.col("__on"), F.lit(False))
    targets = [c for c in _targets(df, columns) if c != source_col]
    # a row that stays as it is has no text to look at, so it costs no scan
    out = joined.select("*", *[F.when(on, F.col(c)).alias(f"__in_{c}") for c in targets])
    for c in targets:
        out = redact_with_spans(out, f"__in_{c}", threshold, labels)
    return out.select(*[F.when(on, F.col(f"__in_{c}")).otherwise(F.col(c)).alias(c) if c in targets else F.col(c)
                        for c in df.columns])
