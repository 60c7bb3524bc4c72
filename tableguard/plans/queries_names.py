"""Registered name-matching, inventory and data-check queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableguard.functions.names import normalize_name
from tableguard.operators.checks import (
    check_rows,
    column_inventory,
    column_profile,
    foreign_key_check,
    key_check,
    schema_lookup,
    table_inventory,
)
from tableguard.operators.names import (
    distinct_names,
    filter_with_children,
    match_names,
    match_names_join,
    near_names,
    near_names_join,
    no_match_report,
)
from tableguard.plans.oracle import q
from tableguard.plans.queries_sql import TABLES
from tableguard.plans.registry import register, table

_WS = r"[ \t\n\r\f\x0B]"
_OUTER = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"


def duck_norm(col: str) -> tuple[str, str]:
    """DuckDB (canonical, leaf) of a name column."""
    trimmed = f"trim({col}, {_OUTER})"
    parts = (f"list_filter(list_transform(string_split_regex({trimmed}, {q(_WS + '*[.]' + _WS + '*')}), "
             f"lambda p: lower(trim(p, {q(chr(34) + chr(39) + '`[] ')}))), lambda p: p <> '')")
    whole = f"lower(trim({trimmed}, {q(chr(34) + chr(39) + '`[] ')}))"
    canonical = f"CASE WHEN len({parts}) > 0 THEN array_to_string({parts}, '.') ELSE {whole} END"
    leaf = (f"CASE WHEN len({parts}) > 0 THEN CASE WHEN {parts}[-1] = '0' THEN {canonical} ELSE {parts}[-1] END "
            f"ELSE {whole} END")
    return canonical, leaf


def names_df(spark, sf_dir) -> DataFrame:
    """``(name, type)``: a catalog of object names derived from the test tables."""
    nation, part, cust = (table(spark, sf_dir, t) for t in ("nation", "part", "customer"))
    return reduce(DataFrame.unionByName, [
        nation.select(F.col("n_name").alias("name"), F.lit("table").alias("type")),
        nation.select(F.concat(F.lit('main."'), F.lower("n_name"), F.lit('"')).alias("name"),
                      F.lit("view").alias("type")),
        part.select(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name"), F.lit("table").alias("type")),
        cust.select(F.concat(F.lit("[sales].["), F.col("c_name"), F.lit("]")).alias("name"),
                    F.lit("procedure").alias("type")),
    ])


NAMES_SQL = ("(SELECT n_name AS name, 'table' AS type FROM nation UNION ALL "
             "SELECT 'main.\"' || lower(n_name) || '\"', 'view' FROM nation UNION ALL "
             "SELECT replace(p_name, ' ', '_'), 'table' FROM part UNION ALL "
             "SELECT '[sales].[' || c_name || ']', 'procedure' FROM customer)")


def filters_df(spark, sf_dir) -> DataFrame:
    """``(filter)``: lookups users would type, right and mistyped, more with every supplier."""
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    number = F.substring("s_name", 10, 9)
    return reduce(DataFrame.unionByName, [
        nation.select(F.lower("n_name").alias("filter")),
        nation.select(F.concat(F.lower("n_name"), F.lit("x")).alias("filter")),
        nation.select(F.concat(F.lit("`main`."), F.lower("n_name"), F.lit("zz")).alias("filter")),
        region.select(F.lit("  ").alias("filter")),
        supplier.select(F.concat(F.lit("Customer#"), number).alias("filter")),
        supplier.select(F.concat(F.lit("[sales].Custmer#"), number).alias("filter")),
    ])


FILTERS_SQL = ("(SELECT lower(n_name) AS filter FROM nation UNION ALL SELECT lower(n_name) || 'x' FROM nation "
               "UNION ALL SELECT '`main`.' || lower(n_name) || 'zz' FROM nation UNION ALL SELECT '  ' FROM region "
               "UNION ALL SELECT 'Customer#' || substr(s_name, 10, 9) FROM supplier "
               "UNION ALL SELECT '[sales].Custmer#' || substr(s_name, 10, 9) FROM supplier)")


def _normed(src: str, col: str, extra: str = "*") -> str:
    c, lf = duck_norm(col)
    return f"(SELECT {extra}, {c} AS canonical, {lf} AS leaf FROM {src})"


@register("normalize_name", lambda: f"SELECT name, type, canonical, leaf FROM {_normed(NAMES_SQL, 'name')}")
def q_normalize_name(spark, sf_dir):
    n = normalize_name(F.col("name"))
    return names_df(spark, sf_dir).select("name", "type", n["canonical"].alias("canonical"),
                                          n["leaf"].alias("leaf"))


def _match_sql(pred: str) -> str:
    return f"SELECT name, type FROM {_normed(NAMES_SQL, 'name')} WHERE {pred}"


# single-filter matches: (filter, mode, oracle predicate on the normalised filter)
_SINGLE = {
    "match_contains": ("NATION_1", "contains", "contains(canonical, 'nation_1') OR contains(leaf, 'nation_1')"),
    "match_prefix": ("Customer#0000001", "prefix",
                     "starts_with(canonical, 'customer#0000001') OR starts_with(leaf, 'customer#0000001')"),
    "match_exact": ('"main".NATION_3', "exact", "canonical = 'main.nation_3' OR leaf = 'nation_3'"),
    "match_glob": ("small_*", "glob", "canonical GLOB 'small_*' OR leaf GLOB 'small_*'"),
}


def _single(key, flt, mode):
    def run(spark, sf_dir):
        return match_names(names_df(spark, sf_dir), "name", flt, mode)
    run.__name__ = f"q_{key}"
    return run


for _k, (_flt, _mode, _pred) in _SINGLE.items():
    register(_k, _match_sql(_pred))(_single(_k, _flt, _mode))


_MANY = {
    "match_many": ("contains", FILTERS_SQL, "contains(n.{p}, f.{p})"),
    "match_many_prefix": ("prefix", FILTERS_SQL, "starts_with(n.{p}, f.{p})"),
    "match_many_exact": ("exact", FILTERS_SQL, "n.{p} = f.{p}"),
    "match_many_glob": ("glob", "(SELECT lower(n_name) || '*' AS filter FROM nation UNION ALL SELECT '*_' || n_nationkey || '?' FROM nation "
                                "UNION ALL SELECT '*#00000?[!0-4]' || n_nationkey % 10 || '*' FROM nation WHERE n_nationkey < 3 "
                                "UNION ALL SELECT '  ' FROM region UNION ALL SELECT '*er#' || substr(s_name, 10, 8) || '[0-4]' FROM supplier)", "n.{p} GLOB f.{p}"),
}


def globs_df(spark, sf_dir) -> DataFrame:
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    key = F.col("n_nationkey")
    return reduce(DataFrame.unionByName, [
        nation.select(F.concat(F.lower("n_name"), F.lit("*")).alias("filter")),
        nation.select(F.concat(F.lit("*_"), key.cast("string"), F.lit("?")).alias("filter")),
        nation.where(key < 3).select(F.concat(F.lit("*#00000?[!0-4]"), (key % 10).cast("string"), F.lit("*")).alias("filter")),
        region.select(F.lit("  ").alias("filter")),
        supplier.select(F.concat(F.lit("*er#"), F.substring("s_name", 10, 8), F.lit("[0-4]")).alias("filter")),
    ])


def _many_sql(filters: str, pred: str) -> str:
    c, lf = duck_norm("filter")
    return (f"SELECT n.name, n.type, f.filter FROM {_normed(NAMES_SQL, 'name')} n JOIN "
            f"(SELECT filter, {c} AS canonical, {lf} AS leaf FROM {filters} WHERE trim(filter, {_OUTER}) <> '') f "
            f"ON {pred.format(p='canonical')} OR {pred.format(p='leaf')}")


def _many(key, mode):
    def run(spark, sf_dir):
        filters = globs_df(spark, sf_dir) if mode == "glob" else filters_df(spark, sf_dir)
        return match_names_join(names_df(spark, sf_dir), "name", filters, "filter", mode)
    run.__name__ = f"q_{key}"
    return run


for _k, (_mode, _filters, _pred) in _MANY.items():
    register(_k, _many_sql(_filters, _pred))(_many(_k, _mode))


def _near_sql() -> str:
    return (f"SELECT name, type, canonical AS normalized_name, "
            f"CAST(least(levenshtein('nation_1x', canonical), levenshtein('nation_1x', leaf)) AS INTEGER) AS score "
            f"FROM {_normed(NAMES_SQL, 'name')} ORDER BY score, type, name LIMIT 5")


@register("near_names", _near_sql)
def q_near_names(spark, sf_dir):
    return near_names(names_df(spark, sf_dir), "name", "type", "nation_1x", 5)


def _pairs_sql(filters: str) -> str:
    fc, fl = duck_norm("filter")
    return (f"SELECT f.filter, n.name, n.type, n.canonical AS normalized_name, "
            f"CAST(least(levenshtein(f.fc, n.canonical), levenshtein(f.fl, n.leaf)) AS INTEGER) AS score "
            f"FROM {_normed(NAMES_SQL, 'name')} n, (SELECT filter, {fc} AS fc, {fl} AS fl FROM {filters}) f")


def _near_join_sql() -> str:
    nonblank = f"(SELECT * FROM {FILTERS_SQL} WHERE trim(filter, {_OUTER}) <> '')"
    return (f"SELECT filter AS target, name, type, normalized_name, score, CAST(rank AS INTEGER) AS rank FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY filter ORDER BY score, type, name) AS rank "
            f"FROM ({_pairs_sql(nonblank)}) WHERE score <= 2) WHERE rank <= 5")


@register("near_names_join", _near_join_sql)
def q_near_names_join(spark, sf_dir):
    targets = filters_df(spark, sf_dir).where(F.btrim("filter", F.lit(" \t\n\r\x00\x0b")) != F.lit(""))
    return near_names_join(names_df(spark, sf_dir), "name", "type", targets, "filter", 5, 2)


def _no_match_sql() -> str:
    fc, fl = duck_norm("filter")
    n = _normed(NAMES_SQL, "name")
    unmatched = (f"(SELECT DISTINCT filter, {fc} AS fc, {fl} AS fl FROM {FILTERS_SQL} "
                 f"WHERE trim(filter, {_OUTER}) <> '') u WHERE NOT EXISTS (SELECT 1 FROM {n} n "
                 f"WHERE n.canonical = u.fc OR n.leaf = u.fl)")
    return (f"WITH um AS (SELECT * FROM {unmatched}), "
            f"pairs AS (SELECT um.filter, n.name, n.type, n.canonical AS normalized_name, "
            f"least(levenshtein(um.fc, n.canonical), levenshtein(um.fl, n.leaf)) AS score FROM um, {n} n), "
            f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filter ORDER BY score, type, name) "
            f"AS rank FROM pairs) WHERE rank <= 5) "
            f"SELECT um.filter, 'no_exact_match' AS status, um.fc AS canonical, um.fl AS leaf, "
            f"CASE WHEN um.fc = um.fl THEN [um.fc] ELSE [um.fc, um.fl] END AS names_tried, "
            f"CAST(top.rank AS INTEGER) AS rank, top.name, top.type, top.normalized_name "
            f"FROM um LEFT JOIN top ON um.filter = top.filter")


@register("no_match_report", _no_match_sql)
def q_no_match_report(spark, sf_dir):
    return no_match_report(names_df(spark, sf_dir), "name", "type", filters_df(spark, sf_dir), "filter", 5)


@register("object_names", f"SELECT DISTINCT name FROM {NAMES_SQL} WHERE trim(name, {_OUTER}) <> ''")
def q_object_names(spark, sf_dir):
    return distinct_names(names_df(spark, sf_dir), "name")


def _frames(spark, sf_dir):
    return {t: table(spark, sf_dir, t) for t in TABLES}



def _children_sql() -> str:
    pc, pl = duck_norm("n_name")
    cc, cl = duck_norm("c_name")
    return (f"WITH p AS (SELECT n_nationkey AS k, n_name AS parent, contains({pc}, '2') OR contains({pl}, '2') AS pm FROM nation), "
            f"c AS (SELECT c_nationkey AS k, c_name AS child, contains({cc}, '2') OR contains({cl}, '2') AS cm FROM customer) "
            f"SELECT p.parent, c.child FROM p LEFT JOIN c ON p.k = c.k AND (p.pm OR c.cm) "
            f"WHERE p.pm OR EXISTS (SELECT 1 FROM c x WHERE x.k = p.k AND x.cm)")


@register("filter_with_children", _children_sql)
def q_filter_with_children(spark, sf_dir):
    """Nations and their customers, by a filter on either name."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    children = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("n_name", "c_name")
    return filter_with_children(nation, "n_name", children, "n_name", "c_name", "2", "contains")


@register("table_inventory", lambda: " UNION ALL ".join(
    f"SELECT 'testdata' AS source, {q(t)} AS \"table\", count(*) AS rows FROM {t}" for t in TABLES))
def q_table_inventory(spark, sf_dir):
    return table_inventory(_frames(spark, sf_dir), "testdata")


_TYPE_MAP = ("CASE data_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'INTEGER' THEN 'INT' "
             "WHEN 'FLOAT[]' THEN 'ARRAY<FLOAT>' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' ELSE data_type END")


# columns of the given tables (text columns marked *)
_COLUMNS = {
    "region": "r_regionkey r_name*", "nation": "n_nationkey n_name* n_regionkey",
    "customer": "c_custkey c_name* c_nationkey c_acctbal c_mktsegment*", "supplier": "s_suppkey s_name* s_nationkey s_acctbal",
    "part": "p_partkey p_name* p_brand* p_type* p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus* o_totalprice o_orderdate o_orderpriority*",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag* l_linestatus* l_shipdate",
    "events": "event_id ts user_id event_type* value props*", "documents": "doc_id text* lang* source* n_chars",
    "embeddings": "vec_id embedding label", "pages": "page_id url* html*", "benchmark": "item_id text*",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role* text*",
}


def _column_counts(tables: list[str], more: str = "") -> str:
    """One row per column: t, c, n (rows), v (non-null values) and what ``more`` adds."""
    out = []
    for t in tables:
        for c in _COLUMNS[t].split():
            name = c.rstrip("*")
            size = f"CAST(max(strlen({name})) AS BIGINT)" if c.endswith("*") else "CAST(NULL AS BIGINT)"
            out.append(f"SELECT {q(t)} AS t, {q(name)} AS c, count(*) AS n, count({name}) AS v {more.format(c=name, size=size)} FROM {t}")
    return " UNION ALL ".join(out)


def _columns_sql() -> str:
    return (f"SELECT i.table_name AS \"table\", i.column_name AS \"column\", CAST(i.ordinal_position AS INTEGER) AS position, {_TYPE_MAP} AS type, "
            f"i.is_nullable = 'YES' AS nullable, k.n AS rows, k.n - k.v AS nulls FROM information_schema.columns i "
            f"JOIN ({_column_counts(TABLES)}) k ON k.t = i.table_name AND k.c = i.column_name")


_LOOKUP = "er"


def _lookup_sql() -> str:
    counts = _column_counts([t for t in TABLES if _LOOKUP in t], ", count(DISTINCT {c}) AS d, {size} AS b")
    return (f"SELECT i.table_name AS \"table\", k.n AS rows, i.column_name AS \"column\", CAST(i.ordinal_position AS INTEGER) AS position, "
            f"{_TYPE_MAP} AS type, k.n - k.v AS nulls, k.d AS \"distinct\", k.b AS max_bytes FROM information_schema.columns i "
            f"JOIN ({counts}) k ON k.t = i.table_name AND k.c = i.column_name")


@register("schema_lookup", _lookup_sql)
def q_schema_lookup(spark, sf_dir):
    """Tables whose name holds ``er``, with the full profile of their columns."""
    return schema_lookup(_frames(spark, sf_dir), _LOOKUP, "contains", "full")


@register("column_inventory", _columns_sql)
def q_column_inventory(spark, sf_dir):
    return column_inventory(_frames(spark, sf_dir))


_CUST_COLS = [("c_custkey", "BIGINT", False), ("c_name", "STRING", True), ("c_nationkey", "INT", False),
              ("c_acctbal", "DOUBLE", False), ("c_mktsegment", "STRING", True)]


@register("column_profile", lambda: " UNION ALL ".join(
    f"SELECT {q(c)} AS \"column\", {q(t)} AS type, count(*) AS rows, count(*) - count({c}) AS nulls, "
    f"count(DISTINCT {c}) AS \"distinct\", "
    f"{'CAST(max(strlen(' + c + ')) AS BIGINT)' if s else 'CAST(NULL AS BIGINT)'} AS max_bytes FROM customer"
    for c, t, s in _CUST_COLS))
def q_column_profile(spark, sf_dir):
    return column_profile(table(spark, sf_dir, "customer"))


_KEYS = [("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("labels", ["doc_id"]),
         ("customer", ["c_nationkey"])]


def _key_sql() -> str:
    parts = []
    for t, cols in _KEYS:
        cl = ", ".join(cols)
        nulls = " OR ".join(f"{c} IS NULL" for c in cols)
        parts.append(
            f"SELECT {q(t + '(' + cl + ')')} AS \"check\", CAST(sum(n) AS BIGINT) AS rows, count(*) AS \"distinct\", "
            f"CAST(sum(CASE WHEN nl THEN n ELSE 0 END) AS BIGINT) AS nulls, max(n) <= 1 AS is_unique, "
            f"max(n) <= 1 AND sum(CASE WHEN nl THEN n ELSE 0 END) = 0 AS is_primary "
            f"FROM (SELECT {cl}, count(*) AS n, bool_or({nulls}) AS nl FROM {t} GROUP BY {cl})")
    return " UNION ALL ".join(parts)


@register("key_check", _key_sql)
def q_key_check(spark, sf_dir):
    return reduce(DataFrame.unionByName, [
        key_check(table(spark, sf_dir, t), cols).select(F.lit(f"{t}({', '.join(cols)})").alias("check"), "*")
        for t, cols in _KEYS])


_FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("labels", "doc_id", "documents", "doc_id"), ("lineitem", "l_partkey", "part", "p_partkey")]


def _fk_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {q(f'{c}.{cc} -> {p}.{pc}')} AS \"check\", (SELECT count(*) FROM {c}) AS rows, "
        f"(SELECT count(*) FROM {c} x WHERE x.{cc} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {p} y WHERE y.{pc} = x.{cc})) AS orphans"
        for c, cc, p, pc in _FKS)


@register("foreign_key_check", _fk_sql)
def q_foreign_key_check(spark, sf_dir):
    return reduce(DataFrame.unionByName, [
        foreign_key_check(table(spark, sf_dir, c), [cc], table(spark, sf_dir, p), [pc])
        .select(F.lit(f"{c}.{cc} -> {p}.{pc}").alias("check"), "*") for c, cc, p, pc in _FKS])


_CHECKS = {
    "acctbal_not_negative": "c_acctbal >= 0",
    "nation_in_range": "c_nationkey BETWEEN 0 AND 24",
    "segment_known": "c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')",
    "name_prefixed": "c_name LIKE 'Customer#%'",
}


@register("check_constraint", lambda: " UNION ALL ".join(
    f"SELECT {q(n)} AS name, CAST(coalesce(sum(CASE WHEN ({e}) = false THEN 1 ELSE 0 END), 0) AS BIGINT) "
    f"AS violations FROM customer" for n, e in _CHECKS.items()))
def q_check_constraint(spark, sf_dir):
    return check_rows(table(spark, sf_dir, "customer"), _CHECKS)

