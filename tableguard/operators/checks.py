"""Inventories and data checks: tables, columns, profiles, keys, foreign keys, CHECKs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableguard.functions.names import normalize_detail, normalize_mode
from tableguard.operators.names import match_names


def sql_type(dt: T.DataType) -> str:
    """Upper-case SQL name of a Spark type (``BIGINT``, ``STRING``, ``ARRAY<FLOAT>``)."""
    return dt.simpleString().upper()


def table_inventory(frames: dict[str, DataFrame], source: str = "default") -> DataFrame:
    """``(source, table, rows)`` for every table; counts come from a
    column-free aggregate each (parquet answers them from footers)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(source).alias("source"),
                                                           F.lit(name).alias("table"), "rows")
             for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def column_inventory(frames: dict[str, DataFrame]) -> DataFrame:
    """``(table, column, position, type, nullable, rows, nulls)`` of every column.

    Names and types come from the schemas, rows and nulls from one aggregate per table.
    """
    parts = []
    for name, df in frames.items():
        fields = df.schema.fields
        one = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"__c{i}") for i, f in enumerate(fields)])
        cols = [F.struct(F.lit(f.name).alias("column"), F.lit(i + 1).alias("position"), F.lit(sql_type(f.dataType)).alias("type"),
                         F.lit(f.nullable).alias("nullable"), F.col("__rows").alias("rows"), (F.col("__rows") - F.col(f"__c{i}")).alias("nulls"))
                for i, f in enumerate(fields)]
        parts.append(one.select(F.lit(name).alias("table"), F.explode(F.array(*cols)).alias("c")).select("table", "c.*"))
    return reduce(DataFrame.unionByName, parts)


def schema_lookup(frames: dict[str, DataFrame], flt: str = "", mode: str = "contains", detail: str = "summary") -> DataFrame:
    """Matching tables at one detail level, with counts read from the tables.

    ``summary``: ``(table, rows)``; ``columns``: ``(table, rows, column, position, type)``;
    ``full``: also ``nulls``, ``distinct`` and ``max_bytes`` of every column.  Only
    matching tables are read.  A blank filter matches all; an unknown mode or detail
    level is an error.
    """
    detail, mode = normalize_detail(detail), normalize_mode(mode)
    spark = next(iter(frames.values())).sparkSession
    listed = spark.createDataFrame([(name,) for name in frames], "name string")
    kept = {r.name for r in match_names(listed, "name", flt, mode).collect()}     # as many rows as there are tables
    frames = {name: df for name, df in frames.items() if name in kept}
    shape = {"summary": "table string, rows bigint", "columns": "table string, rows bigint, column string, position int, type string",
             "full": "table string, rows bigint, column string, position int, type string, nulls bigint, distinct bigint, max_bytes bigint"}[detail]
    if not frames:
        return spark.createDataFrame([], shape)
    if detail == "summary":
        return table_inventory(frames).select("table", "rows")
    if detail == "columns":
        return column_inventory(frames).select("table", "rows", "column", "position", "type")
    parts = []
    for name, df in frames.items():
        places = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i + 1))])
        parts.append(column_profile(df).select(F.lit(name).alias("table"), "rows", "column", places[F.col("column")].alias("position"),
                                               "type", "nulls", "distinct", "max_bytes"))
    return reduce(DataFrame.unionByName, parts)


def _value_key(name: str, kind: T.DataType):
    """128 bits that stand for a value (null for null); a map's entries count in any order."""
    c = F.col("`" + name.replace("`", "``") + "`")
    v = F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c
    return F.when(c.isNotNull(), F.struct(F.xxhash64(F.lit(1), v), F.xxhash64(F.lit(2), v)))


def _stacked(df: DataFrame) -> DataFrame:
    """(i, h, b): column number, value key and bytes of every cell."""
    cells = []
    for i, f in enumerate(df.schema.fields):
        size = F.octet_length(F.col("`" + f.name.replace("`", "``") + "`")) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("int")
        cells.append(F.struct(F.lit(i).alias("i"), _value_key(f.name, f.dataType).alias("h"), size.alias("b")))
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def _column_list(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, sql_type(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "i int, column string, type string")


def column_profile(df: DataFrame) -> DataFrame:
    """``(column, type, rows, nulls, distinct, max_bytes)`` of every column, from one scan.

    ``distinct`` is exact (by 128-bit value keys) at any number of columns: cells are
    counted per (column, key) inside each task first, so a hot value travels once per
    task, and no row is expanded to the table's width.  :func:`column_estimates` has
    cheaper estimates.
    """
    groups = _stacked(df).groupBy("i", "h").agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("b"))
    counts = groups.groupBy("i").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("h").isNull(), F.col("n"))).alias("nulls"),
                                     F.count("h").alias("distinct"), F.max("b").alias("max_bytes"))
    zero = F.lit(0).cast("long")
    return _column_list(df).join(counts, "i", "left").select(
        "column", "type", F.coalesce("rows", zero).alias("rows"), F.coalesce("nulls", zero).alias("nulls"),
        F.coalesce("distinct", zero).alias("distinct"), F.col("max_bytes").cast("long").alias("max_bytes"))


def column_estimates(df: DataFrame) -> DataFrame:
    """``(column, type, sketch, approx_distinct)``: a mergeable HyperLogLog sketch of every column.

    Sketches of several tables or days merge with ``hll_union_agg``.
    """
    sketches = _stacked(df).where("h IS NOT NULL").groupBy("i").agg(F.hll_sketch_agg(F.xxhash64("h")).alias("sketch"))
    return _column_list(df).join(sketches, "i", "left").select(
        "column", "type", "sketch", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0).cast("long")).alias("approx_distinct"))


def key_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Does ``columns`` hold a key?  ``(rows, distinct, nulls, is_unique, is_primary)``.

    An empty table has no row that breaks a key: it is unique and primary.

    One grouped count (partial aggregation map-side, so a hot key value costs
    one partial row per task), then one global aggregate of the groups.
    """
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"),
                                      F.max(any_null.cast("int")).alias("__null"))
    zero = F.lit(0)
    return groups.agg(F.coalesce(F.sum("__n"), zero).cast("long").alias("rows"),
                      F.count(F.lit(1)).alias("distinct"),
                      F.coalesce(F.sum(F.when(F.col("__null") == 1, F.col("__n")).otherwise(0)), zero).cast("long").alias("nulls"),
                      F.coalesce(F.max("__n") <= 1, F.lit(True)).alias("is_unique")
                      ).select("rows", "distinct", "nulls", "is_unique",
                               (F.col("is_unique") & (F.col("nulls") == 0)).alias("is_primary"))


def foreign_key_check(child: DataFrame, child_cols: list[str], parent: DataFrame,
                      parent_cols: list[str]) -> DataFrame:
    """``(rows, orphans)``: child rows whose non-null key has no parent row.

    One scan of the child: rows are counted per key value (nulls included, a
    hot value becomes one partial row per task), so the anti-join sees each
    distinct key once and cannot skew; the total row count comes from the same
    grouped rows.
    """
    keyed = child.groupBy(*child_cols).agg(F.count(F.lit(1)).alias("__n"))
    not_null = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_cols])
    pk = (parent.select(*[F.col(p).alias(c) for p, c in zip(parent_cols, child_cols)]).distinct()
          .withColumn("__hit", F.lit(True)))
    # a left join keeps null keys and unmatched keys; one aggregate gives both
    # totals, so the child is read once
    joined = keyed.join(pk, child_cols, "left")
    orphan = not_null & F.col("__hit").isNull()
    return joined.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("rows"),
                      F.coalesce(F.sum(F.when(orphan, F.col("__n")).otherwise(0)), F.lit(0)).cast("long")
                      .alias("orphans"))


def check_rows(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """``(name, violations)``: rows where a CHECK expression is false (NULL passes)."""
    aggs = [F.coalesce(F.sum(F.when(F.expr(e) == F.lit(False), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"__v{i}")
            for i, e in enumerate(checks.values())]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(f"__v{i}").alias("violations"))
        for i, name in enumerate(checks)])).alias("c")).select("c.*")
