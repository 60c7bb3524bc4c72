"""Named sources: register tables as views, reload (write) tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableguard.sources.jdbc import jdbc_scan


def register_source(spark: SparkSession, name: str, spec: dict) -> list[str]:
    """Register every table of a source as a temp view ``<name>_<table>``.

    ``spec``: ``{"format": "parquet", "path": dir, "tables": [...]}`` (file
    tables ``<path>/<table>.parquet``) or ``{"format": "jdbc", "url": ...,
    "tables": [...], "options": {...}}``; ``partition_columns`` (table to column)
    and ``num_partitions`` split JDBC reads.  ``pii_enabled`` may be given and is
    returned by :func:`source_flags`.  Returns the view names.
    """
    fmt = spec.get("format", "parquet")
    views = []
    for t in spec["tables"]:
        if fmt == "jdbc":
            column = (spec.get("partition_columns") or {}).get(t)
            df = jdbc_scan(spark, spec, t, column, num_partitions=spec.get("num_partitions"))
        else:
            df = spark.read.format(fmt).options(**spec.get("options", {})).load(
                f"{spec['path'].rstrip('/')}/{t}.{fmt}")
        view = f"{name}_{t}"
        df.createOrReplaceTempView(view)
        views.append(view)
    return views


def register_sources(spark: SparkSession, config: dict) -> dict[str, list[str]]:
    """Register a set of sources: ``{"connections": {name: spec}}`` or a single
    ``{"default": spec}`` / ``{"url": ...}`` (then named ``default``)."""
    if "connections" in config:
        conns = config["connections"]
    elif "default" in config:
        conns = {"default": config["default"]}
    else:
        conns = {"default": config}
    if not conns:
        raise ValueError("no connections configured")
    return {name: register_source(spark, name, spec) for name, spec in conns.items()}


def source_flags(spark: SparkSession, sources: dict[str, dict]) -> DataFrame:
    """``(source, pii_enabled)``: only an explicit ``True`` turns redaction on."""
    rows = [(n, spec.get("pii_enabled") is True) for n, spec in sources.items()]
    return spark.createDataFrame(rows, "source string, pii_enabled boolean")


_POINTER = "number bigint, format string, generations array<string>"


def _current(spark: SparkSession, path: str) -> tuple[int, str, list[str]]:
    """(number, format, generations) of the table's last whole write; number 0 if there is none."""
    try:
        rows = spark.read.schema(_POINTER).parquet(f"{path}/current")
        last = rows.orderBy(F.col("number").desc()).first()
    except AnalysisException:       # no such folder yet
        last = None
    return (last["number"], last["format"], list(last["generations"])) if last else (0, "parquet", [])


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write ``df`` as a new generation of the table at ``path``, then point to it.

    The rows go to a folder of their own; only when that write has committed is a row
    appended to the table's pointer.  A failed write thus leaves the old rows as they
    were, readers of the old generation go on undisturbed, and a frame may be computed
    from the very table it replaces.  ``append`` adds the generation to those before it.
    Older generations stay in ``path/generations`` until the user removes them.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}; use overwrite or append")
    spark = df.sparkSession
    number, before_fmt, before = _current(spark, path)
    if mode == "append" and before and before_fmt != fmt:
        raise ValueError(f"cannot append {fmt} to {before_fmt}")
    generation = uuid.uuid4().hex
    df.write.format(fmt).save(f"{path}/generations/{generation}")
    kept = [*(before if mode == "append" else []), generation]
    spark.createDataFrame([(number + 1, fmt, kept)], _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/current")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table's last whole write."""
    number, fmt, generations = _current(spark, path)
    if not number:
        raise ValueError(f"no table at {path}")
    return spark.read.format(fmt).load([f"{path}/generations/{g}" for g in generations])


def reload_tables(frames: dict[str, DataFrame], base_path: str, mode: str = "overwrite",
                  fmt: str = "parquet") -> DataFrame:
    """Write every frame to ``<base_path>/<table>`` (replacing what was there),
    read it back and report ``(table, rows)``.

    A bulk, parallel write per table (:func:`write_table`); the written tables also cut
    lineage for later jobs that read them.
    """
    spark = next(iter(frames.values())).sparkSession
    counts = []
    for name, df in frames.items():
        path = f"{base_path.rstrip('/')}/{name}"
        write_table(df, path, mode, fmt)
        counts.append(read_table(spark, path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows"))
    return reduce(DataFrame.unionByName, counts)
