"""Jobs over a table of SQL scripts: split, screen, limit rule, verdict.

Each script is one row; all work is column expressions on that row (one
``regexp_extract_all`` tokenizer pass, then array functions), so a query log
of any size is processed in parallel with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableguard.functions.statements import (
    KEYWORD_ERROR,
    KEYWORD_HINT,
    LIMIT_ERROR,
    LIMIT_HINT,
    TOKEN_RE,
    TRIM_CHARS,
    first_forbidden_keyword,
    needs_limit,
    token_text,
)


def with_statements(df: DataFrame, sql_col: str, out_col: str = "statements") -> DataFrame:
    """Add ``out_col``: the script's statements (array<string>), comments stripped.

    Tokens are staged in their own columns so the lambdas below read them as
    plain attributes instead of re-running the tokenizer per element.
    """
    tok = df.select("*", F.regexp_extract_all(F.col(sql_col), F.lit(TOKEN_RE), F.lit(0)).alias("__tok"))
    mapped = tok.select("*", F.transform("__tok", token_text).alias("__txt"))
    n = F.size("__tok")
    semis = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                     lambda i: F.element_at(F.col("__tok"), i) == F.lit(";"))
    bounds = mapped.select("*", F.when(n > 0, F.concat(F.array(F.lit(0)), semis, F.array(n + 1)))
                           .otherwise(F.array(F.lit(0), F.lit(1))).alias("__b"))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("__b") - 1),
        lambda k: F.btrim(F.array_join(F.slice(F.col("__txt"), F.element_at(F.col("__b"), k) + 1,
                                               F.element_at(F.col("__b"), k + 1) - F.element_at(F.col("__b"), k) - 1),
                                       ""), F.lit(TRIM_CHARS)))
    stmts = F.filter(pieces, lambda s: s != F.lit(""))
    return (bounds.withColumn(out_col, F.when(F.col(sql_col).isNull(), F.array().cast("array<string>"))
                              .otherwise(stmts))
            .drop("__tok", "__txt", "__b"))


def split_statements(df: DataFrame, id_col: str, sql_col: str) -> DataFrame:
    """``(id, stmt_no, statement)``: one row per non-empty statement, 1-based."""
    staged = with_statements(df.select(id_col, sql_col), sql_col, "__st")
    return (staged.select(id_col, F.posexplode_outer("__st").alias("__pos", "statement"))
            .where(F.col("statement").isNotNull())
            .select(id_col, (F.col("__pos") + 1).cast("int").alias("stmt_no"), "statement"))


def screen_keywords(df: DataFrame, stmt_col: str, out_col: str = "keyword") -> DataFrame:
    return df.withColumn(out_col, first_forbidden_keyword(F.col(stmt_col)))


def limit_rule(df: DataFrame, stmt_col: str, out_col: str = "needs_limit") -> DataFrame:
    return df.withColumn(out_col, needs_limit(F.col(stmt_col)))


def audit_statements(df: DataFrame, id_col: str, sql_col: str) -> DataFrame:
    """Split then judge every statement: limit rule first, then the keyword screen.

    ``(id, stmt_no, statement, allowed, error, hint, retryable)``.
    """
    st = split_statements(df, id_col, sql_col)
    kw = first_forbidden_keyword(F.col("statement"))
    nl = needs_limit(F.col("statement"))
    judged = st.select("*", nl.alias("__nl"), kw.alias("__kw"))
    error = (F.when(F.col("__nl"), F.lit(LIMIT_ERROR))
             .when(F.col("__kw").isNotNull(),
                   F.concat(F.lit(KEYWORD_ERROR.split("{kw}")[0]), F.col("__kw"), F.lit(KEYWORD_ERROR.split("{kw}")[1]))))
    hint = F.when(F.col("__nl"), F.lit(LIMIT_HINT)).when(F.col("__kw").isNotNull(), F.lit(KEYWORD_HINT))
    allowed = ~F.col("__nl") & F.col("__kw").isNull()
    return judged.select(id_col, "stmt_no", "statement", allowed.alias("allowed"), error.alias("error"),
                         hint.alias("hint"), F.when(~allowed, F.lit(False)).alias("retryable"))
