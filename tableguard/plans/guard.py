"""Guarded SQL on Spark: the statement rules in front of ``spark.sql``.

This is a guard against accidents, not a sandbox.  On top of the fixed rules (limit
rule, forbidden keywords) Spark needs a few of its own: only read statements may
start a query, and the statement's own plan may hold no JVM reflection, no script
transform and no source but the session's own tables and views.

Sources are held against an allow-list, twice:

* in the parsed plan, before anything is looked up: a name of several parts must be a
  table or view of the catalog (a data source's class name with a path is none), a name
  of one part can be no path, and no relation may carry a path among its options;
* in the analysed plan: every leaf that reads data must belong to a catalog table or lie
  below a registered view.  This also sees names that only analysis puts together.

Both walk into subqueries, common table expressions and the inner statement of EXPLAIN
and DESCRIBE QUERY.  Plans are read through the classic session; on a session that does
not show them every statement is refused.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableguard.functions.statements import (
    ARGUMENT_HINT,
    DATABASE_HINT,
    FORBIDDEN_KEYWORDS,
    INTERNAL_HINT,
    KEYWORD_ERROR,
    KEYWORD_HINT,
    LIMIT_ERROR,
    LIMIT_HINT,
    TRIM_CHARS,
    needs_limit,
)
from tableguard.operators.statements import with_statements

READ_STARTS = ("SELECT", "WITH", "VALUES", "TABLE", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "(")
# kinds of plan nodes and expressions that a read statement has no use for
REFUSED_NODES = {"ScriptTransformation", "ScriptInputOutputSchema", "CallMethodViaReflection", "TryReflect"}
REFLECTION_NAMES = {"java_method", "reflect", "try_reflect"}
# unresolved names of tables and views, as the parser leaves them
NAME_NODES = {"UnresolvedRelation", "UnresolvedTableOrView", "UnresolvedTable", "UnresolvedView"}
# leaves of an analysed plan that read nothing but the statement itself or the session's own rows
OWN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "LogicalRDD", "CTERelationRef", "ResolvedNamespace", "ResolvedTable",
              "ResolvedPersistentView", "ResolvedTempView", "ResolvedPersistentFunc", "ResolvedNonPersistentFunc", "UnionLoopRef",
              "CurrentNamespace", "CommandResult"}
PATH_OPTIONS = {"path", "paths"}


class RefusedStatement(Exception):
    """A refused statement: message, hint and whether a retry can help."""

    def __init__(self, message: str, hint: str, retryable: bool = False):
        super().__init__(message)
        self.hint = hint
        self.retryable = retryable


def check_statement(spark: SparkSession, stmt: str) -> None:
    """Raise :class:`RefusedStatement` if the statement's text is refused."""
    if spark.range(1).select(needs_limit(F.lit(stmt)).alias("n")).first().n:
        raise RefusedStatement(LIMIT_ERROR, LIMIT_HINT, False)
    for kw in FORBIDDEN_KEYWORDS:
        if re.search(rf"(?i)(?:^|[^A-Za-z0-9_]){kw}(?:[^A-Za-z0-9_]|$)", stmt):
            raise RefusedStatement(KEYWORD_ERROR.format(kw=kw), KEYWORD_HINT, False)
    head = stmt.strip(TRIM_CHARS).upper()
    if not head.startswith(READ_STARTS):
        raise RefusedStatement("Only read statements (SELECT, WITH, VALUES, TABLE, SHOW, DESCRIBE, EXPLAIN) "
                               "are allowed.", "Use a read-only SELECT query.", False)


def _each(seq):
    items = seq.iterator()
    while items.hasNext():
        yield items.next()


def _inner(node):
    """The statement inside EXPLAIN or DESCRIBE QUERY, if the node is one."""
    kind = node.getClass().getSimpleName()
    return node.logicalPlan() if kind == "ExplainCommand" else node.plan() if kind == "DescribeQueryCommand" else None


def _walk(node, stop=frozenset()):
    """(kind, ancestors, node) of the node and everything below it.

    Below lie plan children, inner plans, expressions, plans in expressions and the
    statement inside EXPLAIN and DESCRIBE QUERY.  Nothing below a kind in ``stop``.
    """
    kind, ancestors = node.getClass().getSimpleName(), _ancestors(node)
    yield kind, ancestors, node
    if kind in stop:
        return
    below = list(_each(node.children()))
    if _inner(node) is not None:
        below.append(_inner(node))
    if "LogicalPlan" in ancestors:
        below += [*_each(node.innerChildren()), *_each(node.expressions())]
    elif "PlanExpression" in ancestors:
        below.append(node.plan())
    for child in below:
        yield from _walk(child, stop)


def _ancestors(node) -> set[str]:
    names, kind = set(), node.getClass()
    while kind is not None:
        names.add(kind.getSimpleName())
        kind = kind.getSuperclass()
    return names


def _refuse_code() -> None:
    raise RefusedStatement("Reflection and script transforms are not allowed.", "Use built-in SQL functions only.", False)


def _refuse_source(what: str) -> None:
    raise RefusedStatement(f"{what} cannot be read as a table.", "Use the names of the given tables and views.", False)


def _check_parsed(spark: SparkSession, parsed) -> None:
    for kind, _, node in _walk(parsed):
        if kind in REFUSED_NODES:
            _refuse_code()
        if kind == "UnresolvedFunction" and str(list(_each(node.nameParts()))[-1]).lower() in REFLECTION_NAMES:
            _refuse_code()
        if kind in NAME_NODES:
            parts = [str(p) for p in _each(node.multipartIdentifier())]
            if len(parts) > 1 and not spark.catalog.tableExists(".".join("`" + p.replace("`", "``") + "`" for p in parts)):
                _refuse_source(".".join(parts))
            options = node.options().keySet().toArray() if kind == "UnresolvedRelation" else []
            if any(str(k).lower() in PATH_OPTIONS for k in options):
                _refuse_source("A path option")


def _check_analysed(analysed) -> None:
    for kind, ancestors, node in _walk(analysed, stop={"View"}):
        if kind in REFUSED_NODES:
            _refuse_code()
        if kind == "View" or "LogicalPlan" not in ancestors or list(_each(node.children())) or "RunnableCommand" in ancestors or kind in OWN_LEAVES:
            continue
        if kind == "LogicalRelation" and node.catalogTable().isDefined():
            continue
        if kind == "DataSourceV2Relation" and node.catalog().isDefined() and node.identifier().isDefined():
            continue
        if kind == "HiveTableRelation" or "Command" in kind or kind.startswith(("Show", "Describe")):
            continue
        _refuse_source(f"A {kind} outside the catalog")


def check_plan(spark: SparkSession, stmt: str) -> None:
    """Raise :class:`RefusedStatement` if the statement's plan reflects, transforms or reads what is not registered.

    A statement that does not parse or cannot be analysed passes: ``spark.sql`` raises
    the same error before it reads anything.
    """
    try:
        state = spark._jsparkSession.sessionState()
    except Exception as exc:
        raise RefusedStatement("Statements cannot be checked on this session.", "Use a classic Spark session.", False) from exc
    try:
        parsed = state.sqlParser().parsePlan(stmt)
    except Exception:
        return
    _check_parsed(spark, parsed)
    plan = parsed
    while _inner(plan) is not None:
        plan = _inner(plan)     # analysing EXPLAIN would leave its statement as it is
    try:
        analysed = state.analyzer().execute(plan)
    except Exception:
        return
    _check_analysed(analysed)


def guarded_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Validate one statement, then run it with ``spark.sql`` (lazily)."""
    check_statement(spark, sql)
    check_plan(spark, sql)
    return spark.sql(sql)


def script_statements(spark: SparkSession, script: str) -> list[str]:
    """Split one script with the same tokenizer job used for script tables.

    The script is a single driver-side string; the split runs as a one-row
    Spark job so there is one implementation of the rules.
    """
    one = spark.createDataFrame([(script,)], "sql string")
    row = with_statements(one, "sql", "st").select("st").first()
    return list(row["st"]) if row and row["st"] else []


def run_script(spark: SparkSession, script: str) -> DataFrame | None:
    """Run the statements in order and return the last result (None if empty).

    Validation is interleaved with execution: statement 1
    runs before statement 2 is judged.  Earlier results are executed through
    the ``noop`` sink so their errors surface; the first error stops the rest.
    """
    last = None
    for stmt in script_statements(spark, script):
        if last is not None:
            last.write.format("noop").mode("overwrite").save()
        last = guarded_sql(spark, stmt)
    return last


def error_result(spark: SparkSession, exc: Exception) -> DataFrame:
    """The ``(error, hint, retryable)`` row for a failure.

    Refusals carry their own hint; errors of Spark are database errors; a bad argument
    cannot be retried as it is; anything else may pass once retried.
    """
    message = str(exc).splitlines()[0] if str(exc) else type(exc).__name__
    if isinstance(exc, RefusedStatement):
        message, hint, retry = str(exc), exc.hint, exc.retryable
    elif isinstance(exc, PySparkException):
        hint, retry = DATABASE_HINT, True
    elif isinstance(exc, (ValueError, TypeError)):
        hint, retry = ARGUMENT_HINT, False
    else:
        hint, retry = INTERNAL_HINT, True
    return spark.createDataFrame([(message, hint, retry)], "error string, hint string, retryable boolean")


__all__ = ["guarded_sql", "run_script", "check_statement", "check_plan", "RefusedStatement", "error_result"]
