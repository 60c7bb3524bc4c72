"""Registry of the named queries wired into ``__spark_entry__``.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` over the given test
tables plus, where the result is expressible in plain SQL, a function that
returns the DuckDB SQL computing the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableguard.plans.layout import dealt

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(key: str, oracle: Callable[[], str] | str | None = None):
    """Decorator: register a query under ``key`` with its optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle if callable(oracle) else (lambda s=oracle: s)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; parquet scans prune columns and push filters down."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``table`` for queries with costly work per row: a scan of few splits is dealt out."""
    return dealt(table(spark, sf_dir, name))


def load_all() -> None:
    """Import every module that registers queries."""
    from tableguard.plans import (  # noqa: F401
        queries_pii,
        queries_shaping,
        queries_sql,
        queries_names,
        queries_logs,
        queries_text,
    )
