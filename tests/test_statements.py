"""Statement split, keyword screen, limit rule, guard and script runner."""

import pytest

from tableguard.functions.statements import FORBIDDEN_KEYWORDS
from tableguard.operators.statements import audit_statements, split_statements
from tableguard.plans.guard import RefusedStatement, check_statement, guarded_sql, run_script

KEYWORD_CASES = [
    ('INSERT INTO users (name) VALUES ("test")', "INSERT"),
    ('UPDATE users SET name = "test"', "UPDATE"),
    ("DELETE FROM users WHERE id = 1", "DELETE"),
    ("DROP TABLE users", "DROP"),
    ("CREATE TABLE test (id INT)", "CREATE"),
    ("ALTER TABLE users ADD COLUMN test VARCHAR(255)", "ALTER"),
    ("TRUNCATE TABLE users", "TRUNCATE"),
    ("EXEC sp_test", "EXEC"),
    ("EXECUTE sp_test", "EXECUTE"),
    ("SELECT * INTO new_table FROM users", "INTO"),
    ("MERGE INTO users USING source ON users.id = source.id", "MERGE"),
    ("GRANT SELECT ON users TO test_user", "GRANT"),
    ("REVOKE SELECT ON users FROM test_user", "REVOKE"),
    ("COMMIT", "COMMIT"),
    ("ROLLBACK", "ROLLBACK"),
    ("BEGIN TRANSACTION", "TRANSACTION"),
]


def straight_split(sql):
    """Character loop over the splitting rules, for comparison only."""
    out, buf, i, n = [], "", 0, len(sql)
    in_str = q = None
    esc = line = block = False
    while i < n:
        ch = sql[i]
        if line:
            if ch == "\n":
                line = False
                buf += "\n"
        elif block:
            if ch == "*" and i + 1 < n and sql[i + 1] == "/":
                block = False
                i += 1
                buf += " "
        elif esc:
            buf += ch
            esc = False
        elif ch == "\\":
            buf += ch
            esc = True
        elif in_str:
            if ch == q and i + 1 < n and sql[i + 1] == q:
                buf += ch + q
                i += 1
            else:
                if ch == q:
                    in_str = None
                buf += ch
        elif ch == "#":
            line = True
        elif ch == "-" and i + 1 < n and sql[i + 1] == "-":
            line = True
            i += 1
        elif ch == "/" and i + 1 < n and sql[i + 1] == "*":
            block = True
            i += 1
        elif ch in "'\"":
            in_str, q = True, ch
            buf += ch
        elif ch == ";":
            if buf.strip(" \t\n\r\x00\x0b"):
                out.append(buf.strip(" \t\n\r\x00\x0b"))
            buf = ""
        else:
            buf += ch
        i += 1
    if buf.strip(" \t\n\r\x00\x0b"):
        out.append(buf.strip(" \t\n\r\x00\x0b"))
    return out


SCRIPTS = [
    "SELECT * FROM users WHERE id = 1; SELECT count(*) as count FROM users",
    "SELECT ';' LIMIT 1; SELECT \"'\" LIMIT 1",
    "SELECT 'It''s a test' LIMIT 1",
    "SELECT 1; -- c1 ; x\nSELECT 2 /* ; */; # h ;\nSELECT 3",
    "SELECT '-- not a comment', '/* no */' LIMIT 1; SELECT \"#x\" LIMIT 1",
    "SELECT 'a\\'; b' LIMIT 1; SELECT 2 /* open",
    "; ;  ;",
    "",
    "SELECT 1 -- tail",
]


def _split(spark, scripts):
    df = spark.createDataFrame(list(enumerate(scripts)), "id long, sql string")
    got = {}
    for r in split_statements(df, "id", "sql").collect():
        got.setdefault(r.id, []).append((r.stmt_no, r.statement))
    return {i: [s for _, s in sorted(v)] for i, v in got.items()}


def test_split_matches_straight_line(spark):
    got = _split(spark, SCRIPTS)
    for i, s in enumerate(SCRIPTS):
        assert got.get(i, []) == straight_split(s), s


def test_split_counts(spark):
    got = _split(spark, SCRIPTS)
    assert len(got[0]) == 2 and len(got[1]) == 2 and len(got[2]) == 1 and len(got[3]) == 3


@pytest.mark.parametrize("sql,kw", KEYWORD_CASES)
def test_keyword_screen(spark, sql, kw):
    df = spark.createDataFrame([(1, sql + " LIMIT 1")], "id long, sql string")
    r = audit_statements(df, "id", "sql").first()
    assert not r.allowed and f'"{kw}"' in r.error
    with pytest.raises(RefusedStatement, match=kw):
        check_statement(spark, sql + " LIMIT 1")


def test_keyword_edges(spark):
    df = spark.createDataFrame([(1, "SELECT updated_at FROM t LIMIT 1"), (2, "SELECT 'please update' LIMIT 1"),
                                (3, "SELECT * FROM users"), (4, "SELECT COUNT(*) FROM users"),
                                (5, "SELECT a, COUNT(*) FROM t"), (6, "SELECT * FROM t WHERE\nx = 1"),
                                (7, "SELECT x FROM desktop t"), (8, "WITH a AS (SELECT 1) SELECT * FROM a")],
                               "id long, sql string")
    got = {r.id: r for r in audit_statements(df, "id", "sql").collect()}
    assert got[1].allowed and not got[2].allowed and "UPDATE" in got[2].error
    assert not got[3].allowed and got[3].error.startswith("SELECT query without WHERE")
    assert got[4].allowed and got[5].allowed and not got[6].allowed and got[7].allowed and got[8].allowed
    assert FORBIDDEN_KEYWORDS[0] == "COMMIT"


def test_guard_spark_rules(spark):
    for bad in ("SELECT java_method('java.lang.System', 'exit', 0) LIMIT 1",
                "SELECT reflect('a', 'b') LIMIT 1", "SET spark.x = 1"):
        with pytest.raises(RefusedStatement):
            guarded_sql(spark, bad)
    assert guarded_sql(spark, "SELECT 1 AS one LIMIT 1").first().one == 1


def test_run_script_last_result_and_partial_failure(spark):
    spark.range(3).createOrReplaceTempView("users_t")
    df = run_script(spark, "SELECT * FROM users_t WHERE id = 1; SELECT count(*) as count FROM users_t")
    assert df.first()["count"] == 3
    with pytest.raises(Exception):
        run_script(spark, "SELECT 1 as val LIMIT 1; SELECT * FROM non_existent_table LIMIT 1; SELECT 2 as val LIMIT 1")
    assert run_script(spark, "  ;  ") is None


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

PIECES = ["SELECT ", "a", " ", ";", "'", "''", '"', '""', "\\", "--", "#", "/*", "*/", "\n", "x;y", "é", "\t"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_property_split_matches_straight_line(spark, script):
    assert _split(spark, [script]).get(0, []) == straight_split(script)


def test_guard_refuses_file_sql_and_restores_setting(spark):
    path = "/root/testdata/sf0.001/nation.parquet"
    with pytest.raises(Exception):
        guarded_sql(spark, f"SELECT * FROM parquet.`{path}` LIMIT 1")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"
    assert spark.sql(f"SELECT count(*) AS n FROM parquet.`{path}`").first().n == 25


def test_long_literals_split_without_deep_recursion(spark):
    from tableguard.operators.statements import split_statements

    n = 1 << 20
    texts = ["SELECT '" + "a" * n + ";' LIMIT 1; SELECT 2", "SELECT '" + "\\'" * (n // 2) + ";' LIMIT 1; SELECT 2",
             "SELECT '" + "''" * (n // 2) + ";' LIMIT 1; SELECT 2", 'SELECT "' + "x" * n, "-- " + "c" * n + "\nSELECT 2", "/*" + "*" * n]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, sql string").repartition(6)
    rows = {}
    for r in split_statements(df, "id", "sql").collect():
        rows.setdefault(r.id, []).append(r.statement)
    assert [len(rows.get(i, [])) for i in range(6)] == [2, 2, 2, 1, 1, 0]
    assert rows[0][0] == texts[0].split(" SELECT 2")[0][:-1] and rows[4] == ["SELECT 2"]


def test_the_rule_reads_long_blanks_in_one_pass(spark):
    from tableguard.functions.statements import needs_limit
    from pyspark.sql import functions as F

    text = "SELECT COUNT(x)" + " " * 200_000 + "FRO"
    assert spark.createDataFrame([(text,)], "s string").select(needs_limit(F.col("s")).alias("n")).first().n


@pytest.mark.parametrize("sql", [
    "SELECT `java_method`('java.lang.Math', 'random') LIMIT 1", "SELECT reflect /* c */ ('java.lang.Math', 'random') LIMIT 1",
    "SELECT (SELECT java_method('java.lang.Math', 'random')) LIMIT 1", "SELECT 1 WHERE EXISTS (SELECT try_reflect('java.lang.Math', 'random'))",
    "SELECT id FROM range(3) WHERE java_method('java.lang.Math', 'random') > '0'",
    "SELECT TRANSFORM(id) ROW FORMAT DELIMITED FIELDS TERMINATED BY ',' USING 'cat' FROM range(3) LIMIT 1",
    "WITH q AS (SELECT reflect('java.lang.Math', 'random') AS r) SELECT * FROM q LIMIT 1",
    "SELECT * FROM parquet.`/tmp/x` LIMIT 1", "SELECT 1 WHERE 1 IN (SELECT a FROM Json.`/tmp/x`)",
])
def test_plans_that_reflect_or_read_paths_are_refused(spark, sql):
    with pytest.raises(RefusedStatement):
        guarded_sql(spark, sql)


NATION = "/root/testdata/sf0.001/nation.parquet"


@pytest.mark.parametrize("sql", [
    f"SELECT * FROM `org.apache.spark.sql.parquet`.`{NATION}` LIMIT 1",
    f"SELECT * FROM `org.apache.spark.sql.execution.datasources.parquet.ParquetFileFormat`.`{NATION}` LIMIT 1",
    f"SELECT * FROM `org.apache.spark.sql.execution.datasources.v2.parquet.ParquetDataSourceV2`.`{NATION}` LIMIT 1",
    f"EXPLAIN SELECT * FROM parquet.`{NATION}` LIMIT 1", f"EXPLAIN EXTENDED SELECT * FROM parquet.`{NATION}` LIMIT 1",
    "DESCRIBE QUERY SELECT reflect('java.lang.Math', 'random')", "EXPLAIN SELECT reflect('java.lang.Math', 'random') LIMIT 1",
    f"DESCRIBE QUERY SELECT * FROM parquet.`{NATION}`", f"SELECT * FROM IDENTIFIER('parquet.`{NATION}`') LIMIT 1",
    "SELECT IDENTIFIER('reflect')('java.lang.Math', 'random') LIMIT 1",
    f"WITH q AS (SELECT * FROM `org.apache.spark.sql.parquet`.`{NATION}`) SELECT * FROM q LIMIT 1",
    f"SELECT 1 WHERE 1 IN (SELECT n_nationkey FROM `org.apache.spark.sql.parquet`.`{NATION}`)",
    f"SELECT (SELECT max(n_nationkey) FROM PARQUET.`{NATION}`) LIMIT 1",
    f"SELECT id FROM range(1) UNION ALL SELECT n_nationkey FROM Orc.`{NATION}` LIMIT 1", f"TABLE parquet.`{NATION}`",
    f"SELECT * FROM guard_view WITH (path = '{NATION}') LIMIT 1", f"DESCRIBE TABLE parquet.`{NATION}`",
])
def test_sources_outside_the_catalog_are_refused(spark, sql):
    spark.range(2).createOrReplaceTempView("guard_view")
    with pytest.raises(RefusedStatement):
        guarded_sql(spark, sql)


@pytest.mark.parametrize("sql, rows", [
    ("SELECT count(*) AS n FROM guard_files", 1), ("SELECT * FROM guard_files WHERE n_nationkey < 3", 3), ("SELECT * FROM default.guard_table LIMIT 2", 2),
    ("SELECT * FROM spark_catalog.default.guard_table LIMIT 2", 2), ("WITH q AS (SELECT * FROM guard_files) SELECT * FROM q LIMIT 4", 4),
    ("SELECT * FROM guard_nested LIMIT 2", 2), ("EXPLAIN SELECT * FROM guard_files LIMIT 1", 1), ("DESCRIBE QUERY SELECT n_name FROM guard_files", 1),
    ("DESCRIBE TABLE guard_table", 3), ("SHOW TABLES", None), ("SHOW COLUMNS FROM default.guard_table", 3), ("VALUES (1), (2)", 2),
    ("SELECT 1 WHERE EXISTS (SELECT 1 FROM default.guard_table)", 1), ("TABLE guard_files", 25),
    ("SELECT * FROM (SELECT explode(array(1, 2)) AS x) LIMIT 5", 2), ("DESCRIBE FUNCTION abs", None), ("SHOW DATABASES", None),
    ("DESCRIBE DATABASE default", None), ("SELECT * FROM guard_files a JOIN guard_table b ON a.n_nationkey = b.n_nationkey LIMIT 3", 3),
    ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT * FROM r LIMIT 9", 4),
])
def test_registered_sources_pass(spark, sql, rows):
    spark.read.parquet(NATION).createOrReplaceTempView("guard_files")
    spark.sql("CREATE OR REPLACE TEMP VIEW guard_nested AS SELECT * FROM guard_files WHERE n_nationkey > 1")
    if not spark.catalog.tableExists("default.guard_table"):
        spark.sql(f"CREATE TABLE default.guard_table USING parquet LOCATION '{NATION}'")
    got = guarded_sql(spark, sql).collect()
    assert rows is None or len(got) == rows


def test_plain_queries_pass_the_plan_check(spark):
    before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    got = guarded_sql(spark, "SELECT x.id, (SELECT max(id) FROM range(4)) AS m FROM range(3) x WHERE x.id IN (SELECT id FROM range(2))").collect()
    assert len(got) == 2 and spark.conf.get("spark.sql.runSQLOnFiles", "true") == before


def test_errors_map_to_three_classes_and_refusals(spark):
    from tableguard.plans.guard import error_result

    def row(exc):
        r = error_result(spark, exc).first()
        return r.hint.split(".")[0].split(";")[0], r.retryable

    try:
        spark.sql("SELECT nope FROM range(1)")
    except Exception as exc:
        assert row(exc) == ("Query failed in the database", True)
    assert row(ValueError("bad mode")) == ("Check tool arguments and use values from tools/list (for connections) and resources/list (for tables)", False)
    assert row(RuntimeError("x")) == ("Temporary internal failure", True)
    assert row(RefusedStatement("m", "h")) == ("h", False)
