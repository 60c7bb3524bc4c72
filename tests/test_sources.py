"""JDBC URL mapping, source registration and reload."""

import pytest

from tableguard.sources.catalog import register_sources, reload_tables, source_flags
from tableguard.sources.jdbc import jdbc_url


@pytest.mark.parametrize("url,want", [
    ("mysql://u:p@db:3306/app", "jdbc:mysql://db:3306/app"),
    ("mysql2://db/app", "jdbc:mysql://db/app"),
    ("mariadb://db/app", "jdbc:mysql://db/app"),
    ("postgresql://db:5432/app", "jdbc:postgresql://db:5432/app"),
    ("pgsql://db/app", "jdbc:postgresql://db/app"),
    ("postgres://db/app", "jdbc:postgresql://db/app"),
    ("sqlite:///var/app.db", "jdbc:sqlite:/var/app.db"),
    ("sqlsrv://db:1433/app", "jdbc:sqlserver://db:1433;databaseName=app"),
    ("mssql://db/app", "jdbc:sqlserver://db;databaseName=app"),
    ("jdbc:derby:memory:x;create=true", "jdbc:derby:memory:x;create=true"),
])
def test_jdbc_url(url, want):
    assert jdbc_url({"url": url})[0] == want


def test_overrides():
    url, driver = jdbc_url({"url": "postgresql://db/app", "host": "other", "port": 6543, "dbname": "x"})
    assert url == "jdbc:postgresql://other:6543/x" and driver == "org.postgresql.Driver"


def test_register_sources_and_flags(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    views = register_sources(spark, {"connections": {
        "a": {"format": "parquet", "path": sf, "tables": ["nation"], "pii_enabled": True},
        "b": {"format": "parquet", "path": sf, "tables": ["region"], "pii_enabled": "yes"}}})
    assert views == {"a": ["a_nation"], "b": ["b_region"]}
    assert spark.table("a_nation").count() == 25
    flags = {r.source: r.pii_enabled for r in source_flags(spark, {"a": {"pii_enabled": True},
                                                                   "b": {"pii_enabled": "yes"}, "c": {}}).collect()}
    assert flags == {"a": True, "b": False, "c": False}
    counts = {r.table: r.rows for r in reload_tables({"nation": spark.table("a_nation")}, str(tmp_path)).collect()}
    assert counts == {"nation": 25}


def _database(spark, df, types="", table="T"):
    import uuid

    url = f"jdbc:derby:memory:t{uuid.uuid4().hex[:8]};create=true"
    (df.write.format("jdbc").option("url", url).option("dbtable", table).option("driver", "org.apache.derby.jdbc.EmbeddedDriver")
     .options(**({"createTableColumnTypes": types} if types else {})).save())
    return url


def _sizes(df):
    from pyspark.sql import functions as F

    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_jdbc_reads_are_near_equal_on_skewed_keys(spark):
    """Numbers with a long tail, texts, dates; null keys in a read of their own; hot values."""
    from pyspark.sql import functions as F

    from tableguard.sources.jdbc import jdbc_scan

    rows = spark.range(1200).select(
        F.when(F.col("id") % 10 < 9, F.pow("id", F.lit(3)).cast("long")).alias("cube"), F.concat(F.lit("o'b "), F.hex("id")).alias("name"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.pow(F.col("id") / 40, F.lit(2))).cast("int")).alias("day"),
        F.when(F.col("id") < 700, 5).otherwise(F.col("id")).alias("hot"), F.col("id"))
    url = _database(spark, rows, "name VARCHAR(64)")
    want = sorted(map(str, rows.collect()))
    for column in ("cube", "name", "day"):
        got = jdbc_scan(spark, {"url": url}, "T", column, num_partitions=4)
        assert sorted(map(str, got.collect())) == want
        sizes = _sizes(got)
        assert len(sizes) == (5 if column == "cube" else 4) and max(sizes) < 450, (column, sizes)
    hot = jdbc_scan(spark, {"url": url}, "T", "hot", num_partitions=4)
    assert sorted(map(str, hot.collect())) == want and max(_sizes(hot)) < 1000
    equal = jdbc_scan(spark, {"url": url}, "T", "id", bounds=(0, 1200), num_partitions=3)
    assert _sizes(equal) == [400, 400, 400]


def test_jdbc_of_empty_and_all_null_keys(spark):
    from pyspark.sql import functions as F

    from tableguard.sources.jdbc import jdbc_scan, range_predicates

    rows = spark.range(5).select(F.col("id"), F.lit(None).cast("int").alias("k"))
    assert jdbc_scan(spark, {"url": _database(spark, rows)}, "T", "k").count() == 5
    assert jdbc_scan(spark, {"url": _database(spark, rows.limit(0))}, "T", "k").count() == 0
    assert range_predicates('"k"', [1, 5]) == ['"k" <= 1', '"k" > 1 AND "k" <= 5', '"k" > 5', '"k" IS NULL']
    assert range_predicates("k", ["it's"])[0] == "k <= 'it''s'" and range_predicates("k", []) == ["k IS NOT NULL", "k IS NULL"]


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from tableguard.sources.catalog import read_table, write_table

    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        read_table(spark, path)
    write_table(spark.range(10), path)
    old = read_table(spark, path)
    bad = spark.range(10, 1000).select(F.when(F.col("id") == 777, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id")).repartition(4)
    for _ in range(2):
        with pytest.raises(Exception):
            write_table(bad, path)
        assert read_table(spark, path).count() == 10
    write_table(read_table(spark, path).select((F.col("id") + 100).alias("id")), path)     # from the table itself
    assert sorted(r.id for r in read_table(spark, path).collect()) == list(range(100, 110))
    assert sorted(r.id for r in old.collect()) == list(range(10))                           # a reader of the old one goes on
    write_table(spark.range(3), path, mode="append")
    assert read_table(spark, path).count() == 13
    write_table(spark.range(0), path, fmt="json")
    with pytest.raises(ValueError):
        write_table(spark.range(1), path, mode="append")
    with pytest.raises(ValueError):
        write_table(spark.range(1), path, mode="ignore")
