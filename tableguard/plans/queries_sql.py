"""Registered statement jobs, the guarded query, the script runner and the
acceptance queries of the relational surface Spark SQL provides."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableguard.functions.statements import (
    FORBIDDEN_KEYWORDS,
    KEYWORD_ERROR,
    KEYWORD_HINT,
    LIMIT_ERROR,
    LIMIT_HINT,
    SELECT_FROM_RE,
)
from tableguard.operators.statements import audit_statements, limit_rule, screen_keywords, split_statements
from tableguard.plans.guard import guarded_sql, run_script
from tableguard.plans.oracle import q
from tableguard.plans.registry import dealt_table, register, table

# the tokenizer's rules for DuckDB's RE2, which has no possessive loops and never recurses
TOKEN_RE2 = (r"(?s)(?:\\.|'(?:\\.|''|[^'\\])*'?|\"(?:\\.|\"\"|[^\"\\])*\"?|--[^\n]*\n?|#[^\n]*\n?"
             r"|/\*.*?(?:\*/|\z)|;|[^'\"\\;#/-]+|.)")

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# One script template per event type; {U} = user_id, {E} = event_id.  They
# exercise quotes, escapes, comments, empty statements and write keywords.
SCRIPT_TEMPLATES = {
    "view": "SELECT * FROM users WHERE id = {U}; SELECT count(*) as count FROM users",
    "signup": "SELECT ';' LIMIT 1; SELECT \"'\" LIMIT 1; SELECT 'It''s a test {E}' LIMIT 1",
    "click": "-- first {U}\nSELECT a FROM t LIMIT 1; # hash\nSELECT b FROM t /* block; */ WHERE x = 'a;b'; ;"
             " SELECT '-- not a comment' LIMIT {U}; /* open",
    "error": "UPDATE users SET name = 'x' WHERE id = {U}; SELECT 1 FROM t WHERE updated_at > {E};"
             " SELECT 'please delete' LIMIT 1; MERGE INTO t USING s ON 1 = 1",
    "purchase": "SELECT id, COUNT(*) FROM orders; SELECT SUM(x) FROM orders; SELECT * FROM orders;"
                " WITH q AS (SELECT 1) SELECT * FROM q; SELECT x FROM t WHERE\ny = {E};"
                " SELECT 'a\\'; b' FROM t LIMIT 1; SELECT x FROM desktop ",
}


def _template_spark(tpl: str):
    parts, out = tpl.replace("{E}", "\x00E\x00").replace("{U}", "\x00U\x00").split("\x00"), []
    for p in parts:
        if p == "E":
            out.append(F.col("event_id").cast("string"))
        elif p == "U":
            out.append(F.col("user_id").cast("string"))
        elif p:
            out.append(F.lit(p))
    return F.concat(*out)


def _template_sql(tpl: str) -> str:
    parts, out = tpl.replace("{E}", "\x00E\x00").replace("{U}", "\x00U\x00").split("\x00"), []
    for p in parts:
        if p == "E":
            out.append("CAST(event_id AS VARCHAR)")
        elif p == "U":
            out.append("CAST(user_id AS VARCHAR)")
        elif p:
            out.append(q(p))
    return " || ".join(out)


def scripts(spark, sf_dir):
    """``(script_id, sql)``: a query log derived from ``events``."""
    ev = dealt_table(spark, sf_dir, "events")
    expr = None
    for et, tpl in SCRIPT_TEMPLATES.items():
        expr = (F.when(F.col("event_type") == et, _template_spark(tpl)) if expr is None
                else expr.when(F.col("event_type") == et, _template_spark(tpl)))
    return ev.select(F.col("event_id").alias("script_id"), expr.alias("sql"))


def scripts_sql() -> str:
    whens = " ".join(f"WHEN {q(et)} THEN {_template_sql(tpl)}" for et, tpl in SCRIPT_TEMPLATES.items())
    return f"(SELECT event_id AS script_id, CASE event_type {whens} END AS sql FROM events)"


def split_sql() -> str:
    text = ("CASE WHEN starts_with(t, '--') OR starts_with(t, '#') THEN CASE WHEN ends_with(t, chr(10)) "
            "THEN chr(10) ELSE '' END WHEN starts_with(t, '/*') THEN CASE WHEN length(t) >= 4 AND ends_with(t, '*/') "
            "THEN ' ' ELSE '' END ELSE t END")
    trim_set = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
    return f"""
WITH s AS (SELECT script_id, regexp_extract_all(sql, {q(TOKEN_RE2)}, 0) AS tok FROM {scripts_sql()}),
m AS (SELECT script_id, tok, list_transform(tok, lambda t: {text}) AS txt FROM s),
b AS (SELECT script_id, txt, [0] || list_filter(range(1, len(tok) + 1), lambda i: tok[i] = ';') || [len(tok) + 1] AS bd FROM m),
p AS (SELECT script_id, list_filter(list_transform(range(1, len(bd)), lambda k:
        trim(array_to_string(list_slice(txt, bd[k] + 1, bd[k + 1] - 1), ''), {trim_set})), lambda x: x <> '') AS st FROM b)
SELECT script_id, CAST(generate_subscripts(st, 1) AS INTEGER) AS stmt_no, unnest(st) AS statement FROM p"""


def keyword_sql(col: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({col}, {q('(?i)(?:^|[^A-Za-z0-9_])' + kw + '(?:[^A-Za-z0-9_]|$)')}) "
                     f"THEN {q(kw)}" for kw in FORBIDDEN_KEYWORDS)
    return f"CASE {whens} END"


def needs_limit_sql(col: str) -> str:
    n = f"upper(trim({col}, ' ' || chr(9) || chr(10) || chr(13) || chr(11)))"
    sel = f"regexp_extract({n}, {q(SELECT_FROM_RE)}, 1)"
    aggs = " OR ".join(f"contains({n}, {q(a)})" for a in [" COUNT(", " SUM(", " AVG(", " MIN(", " MAX(",
                                                          " GROUP_CONCAT(", " STRING_AGG("])
    agg_only = (f"(NOT contains({n}, 'GROUP BY') AND ({aggs}) AND regexp_matches({n}, {q(SELECT_FROM_RE)}) "
                f"AND NOT (contains({sel}, '*') AND NOT contains({sel}, '(*)')))")
    passes = (f"(NOT starts_with({n}, 'SELECT') OR contains({n}, 'WHERE ') OR contains({n}, 'LIMIT ') "
              f"OR contains({n}, 'TOP ') OR contains({n}, 'FETCH NEXT') OR {agg_only})")
    return f"(NOT {passes})"


@register("statement_split", split_sql)
def q_statement_split(spark, sf_dir):
    return split_statements(scripts(spark, sf_dir), "script_id", "sql")


@register("statement_keyword_screen",
          lambda: f"SELECT script_id, stmt_no, statement, {keyword_sql('statement')} AS keyword FROM ({split_sql()})")
def q_keyword_screen(spark, sf_dir):
    return screen_keywords(split_statements(scripts(spark, sf_dir), "script_id", "sql"), "statement")


@register("statement_limit_rule",
          lambda: f"SELECT script_id, stmt_no, statement, {needs_limit_sql('statement')} AS needs_limit "
                  f"FROM ({split_sql()})")
def q_limit_rule(spark, sf_dir):
    return limit_rule(split_statements(scripts(spark, sf_dir), "script_id", "sql"), "statement")


def verdict_sql() -> str:
    kw_err = KEYWORD_ERROR.split("{kw}")
    return f"""
SELECT script_id, stmt_no, statement, NOT nl AND kw IS NULL AS allowed,
  CASE WHEN nl THEN {q(LIMIT_ERROR)} WHEN kw IS NOT NULL THEN {q(kw_err[0])} || kw || {q(kw_err[1])} END AS error,
  CASE WHEN nl THEN {q(LIMIT_HINT)} WHEN kw IS NOT NULL THEN {q(KEYWORD_HINT)} END AS hint,
  CASE WHEN nl OR kw IS NOT NULL THEN false END AS retryable
FROM (SELECT *, {needs_limit_sql('statement')} AS nl, {keyword_sql('statement')} AS kw FROM ({split_sql()}))"""


@register("statement_verdict", verdict_sql)
def q_verdict(spark, sf_dir):
    return audit_statements(scripts(spark, sf_dir), "script_id", "sql")


def register_views(spark, sf_dir, names=TABLES) -> None:
    """Temp views named like the tables, so one SQL text runs here and in DuckDB."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


_GUARDED = ("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders "
            "WHERE o_totalprice > 1000 GROUP BY o_orderstatus")


@register("guarded_query", _GUARDED)
def q_guarded(spark, sf_dir):
    register_views(spark, sf_dir, ["orders"])
    return guarded_sql(spark, _GUARDED)


_SCRIPT = ("-- two statements, the last result wins\nSELECT * FROM nation WHERE n_regionkey = 1; "
           "SELECT count(*) as count FROM customer")


@register("script_last_result", "SELECT count(*) as count FROM customer")
def q_script(spark, sf_dir):
    register_views(spark, sf_dir, ["nation", "customer"])
    return run_script(spark, _SCRIPT)


# Acceptance queries: key -> (Spark SQL run through the guard, DuckDB SQL or None if identical).
ACCEPTANCE = {
    "sql_project_filter": (
        "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') "
        "AND c_nationkey NOT IN (1, 2) AND c_acctbal > 0", None),
    "sql_sort_limit": (
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' "
        "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "sql_offset": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100", None),
    "sql_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 0", None),
    "sql_inner_join": (
        "SELECT n.n_name, count(*) AS n_customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
        "WHERE c.c_acctbal > 0 GROUP BY n.n_name", None),
    "sql_outer_join": (
        "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, count(*) AS n_rows FROM customer c "
        "LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_acctbal IS NOT NULL GROUP BY c.c_custkey", None),
    "sql_semi_anti_join": (
        "SELECT c_custkey, c_mktsegment, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey "
        "AND o.o_orderstatus = 'F') AS has_final FROM customer c WHERE NOT EXISTS "
        "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')", None),
    "sql_range_join": (
        # band join as an equi-join on 20-wide price buckets: each part is listed in its
        # own bucket and both neighbours first, so no nested loop is left
        "SELECT p.p_partkey, count(*) AS n_suppliers FROM (SELECT p_partkey, p_retailprice, "
        "explode(transform(array(-1, 0, 1), d -> floor(p_retailprice / 20) + d)) AS b FROM part WHERE p_retailprice IS NOT NULL) p "
        "JOIN supplier s ON floor(s.s_acctbal / 20) = p.b "
        "AND s.s_acctbal BETWEEN p.p_retailprice - 10 AND p.p_retailprice + 10 GROUP BY p.p_partkey",
        "SELECT p.p_partkey, count(*) AS n_suppliers FROM part p JOIN supplier s "
        "ON s.s_acctbal BETWEEN p.p_retailprice - 10 AND p.p_retailprice + 10 GROUP BY p.p_partkey"),
    "sql_aggregate": (
        "SELECT count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, "
        "min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM lineitem", None),
    "sql_string_agg": (
        "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation "
        "WHERE n_regionkey >= 0 GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation "
        "WHERE n_regionkey >= 0 GROUP BY n_regionkey"),
    "sql_group_by": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue "
        "FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10", None),
    "sql_count_distinct": (
        "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers FROM orders WHERE o_orderkey > 0 "
        "GROUP BY o_orderstatus", None),
    "sql_rollup_cube": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > 0 "
        "GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "sql_window_rank": (
        "SELECT c_custkey, c_nationkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS BIGINT) "
        "AS rnk, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn "
        "FROM customer WHERE c_acctbal IS NOT NULL", None),
    "sql_window_frame": (
        "SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_order, "
        "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND "
        "CURRENT ROW), 2) AS running FROM orders WHERE o_orderkey > 0", None),
    "sql_set_ops": (
        "(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT n_nationkey FROM nation "
        "WHERE n_regionkey = 0) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 INTERSECT "
        "SELECT n_nationkey FROM nation WHERE n_nationkey >= 0", None),
    "sql_scalar_subquery": (
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", None),
    "sql_cte": (
        "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) "
        "SELECT n, count(*) AS customers FROM t GROUP BY n", None),
    "sql_view": ("SELECT c_custkey, c_name FROM active_customers WHERE c_nationkey = 3",
                 "SELECT c_custkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal > 0) WHERE c_nationkey = 3"),
    "sql_string_functions": (
        "SELECT c_custkey, upper(c_name) AS u, concat(c_name, '''s') AS poss, CAST(length(c_name) AS BIGINT) AS len, "
        "substr(c_name, 1, 8) AS pre, replace(c_mktsegment, 'I', 'i') AS seg, 'a;b' AS lit "
        "FROM customer WHERE c_name IS NOT NULL", None),
    "sql_date_functions": (
        "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, "
        "CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS n "
        "FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2, 3", None),
    "sql_math_functions": (
        "SELECT p_partkey, p_retailprice * 2 AS doubled, round(p_retailprice / 4, 2) AS quarter, "
        "abs(p_size - 25) AS dist, p_size % 7 AS m7 FROM part WHERE p_size > 0", None),
    "sql_json_functions": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events WHERE props IS NOT NULL",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events "
        "WHERE props IS NOT NULL"),
    "sql_array_functions": (
        "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS dims, CAST(element_at(embedding, 1) AS DOUBLE) AS first "
        "FROM embeddings WHERE embedding IS NOT NULL",
        "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, CAST(embedding[1] AS DOUBLE) AS first "
        "FROM embeddings WHERE embedding IS NOT NULL"),
}


def _acceptance(key: str, spark_sql: str):
    def run(spark, sf_dir):
        register_views(spark, sf_dir)
        if key == "sql_view":
            spark.sql("CREATE OR REPLACE TEMP VIEW active_customers AS "
                      "SELECT * FROM customer WHERE c_acctbal > 0")
        return guarded_sql(spark, spark_sql)
    run.__name__ = f"q_{key}"
    return run


for _key, (_spark_sql, _duck_sql) in ACCEPTANCE.items():
    register(_key, _duck_sql or _spark_sql)(_acceptance(_key, _spark_sql))
