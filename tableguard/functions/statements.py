"""Column expressions for SQL-statement text: tokens, keyword screen, limit rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's rules and messages ---
# Forbidden keywords, in the order they are tested (the first hit is reported).
FORBIDDEN_KEYWORDS = [
    "COMMIT", "ROLLBACK", "TRANSACTION", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER",
    "CREATE", "TRUNCATE", "EXEC", "EXECUTE", "MERGE", "INTO", "GRANT", "REVOKE",
]
# Aggregate calls that make a SELECT without GROUP BY "aggregate-only" (leading space included).
AGGREGATE_CALLS = [" COUNT(", " SUM(", " AVG(", " MIN(", " MAX(", " GROUP_CONCAT(", " STRING_AGG("]
LIMIT_ERROR = "SELECT query without WHERE clause must include LIMIT or TOP."
LIMIT_HINT = "Add LIMIT 10 (MySQL/PostgreSQL/SQLite) or TOP 10 (SQL Server), or add a WHERE clause."
KEYWORD_ERROR = 'Security violation: Keyword "{kw}" is not allowed in read-only mode.'
KEYWORD_HINT = ("Use a read-only SELECT query. Writes (INSERT/UPDATE/DELETE/DDL/transaction commands) "
                "are blocked.")
# Hints for the other failures: of the database, of an argument, and of anything else.
DATABASE_HINT = "Query failed in the database. Verify table/column names and SQL syntax, then retry."
ARGUMENT_HINT = ("Check tool arguments and use values from tools/list (for connections) and resources/list "
                 "(for tables).")
INTERNAL_HINT = ("Temporary internal failure. Retry the same call once; if it still fails, adjust the query or "
                 "inspect server logs.")
# Characters stripped around a statement (PHP trim's default set).
TRIM_CHARS = " \t\n\r\x00\x0b"
# --- end of fixed values ---

# One token per match, in scanning order: an escaped character, a quoted
# string (doubled quote or backslash escapes inside; may run to the end), a
# line comment (-- or #, with its newline), a block comment (may run to the
# end), a statement separator, a run of characters that start none of these,
# or any other single character.  Runs and possessive loops keep Java's matcher
# from recursing once per character, so literals may be of any length.
TOKEN_RE = (r"(?s)(?:\\.|'(?:[^'\\]++|\\.|'')*+'?|\"(?:[^\"\\]++|\\.|\"\")*+\"?|--[^\n]*+\n?|#[^\n]*+\n?"
            r"|/\*.*?(?:\*/|\z)|;|[^'\"\\;#/-]++|.)")

_NOT_WORD = "[^A-Za-z0-9_]"


def keyword_pattern(kw: str) -> str:
    """Whole-word, case-insensitive match; ASCII word characters as in PCRE."""
    return f"(?i)(?:^|{_NOT_WORD}){kw}(?:{_NOT_WORD}|$)"


def token_text(tok: Column) -> Column:
    """What a token contributes to the statement text.

    A line comment leaves its newline (nothing if it ends the script), a closed
    block comment leaves one space, an unclosed one nothing.
    """
    return (F.when(tok.startswith("--") | tok.startswith("#"),
                   F.when(tok.endswith("\n"), F.lit("\n")).otherwise(F.lit("")))
            .when(tok.startswith("/*"),
                  F.when((F.char_length(tok) >= 4) & tok.endswith("*/"), F.lit(" ")).otherwise(F.lit("")))
            .otherwise(tok))


def first_forbidden_keyword(stmt: Column) -> Column:
    """The first forbidden keyword (list order) found anywhere in the text, else null.

    One search for all of them together comes first: most texts hold none.
    """
    some = stmt.rlike(keyword_pattern(f"(?:{'|'.join(FORBIDDEN_KEYWORDS)})"))
    return F.when(some, F.coalesce(*[F.when(stmt.rlike(keyword_pattern(kw)), F.lit(kw)) for kw in FORBIDDEN_KEYWORDS]))


_WS = r"[ \t\n\r\f\x0B]"
# further white space falls into the group, which is only searched for stars
SELECT_FROM_RE = f"(?s)SELECT{_WS}(.*?){_WS}FROM"


def needs_limit(stmt: Column) -> Column:
    """True when a SELECT has no WHERE / LIMIT / TOP / FETCH NEXT and is not aggregate-only.

    Substring tests on the upper-cased, trimmed text, exactly as stated: so
    ``WHERE`` followed by a newline does not count, ``DESKTOP `` counts as
    ``TOP ``, and a WHERE in a subquery counts.
    """
    norm = F.upper(F.btrim(stmt, F.lit(TRIM_CHARS)))
    has_any = lambda subs: F.greatest(*[norm.contains(s) for s in subs]) if len(subs) > 1 else norm.contains(subs[0])
    select_part = F.regexp_extract(norm, SELECT_FROM_RE, 1)
    aggregate_only = (~norm.contains("GROUP BY") & has_any(AGGREGATE_CALLS) & norm.rlike(SELECT_FROM_RE)
                      & ~(select_part.contains("*") & ~select_part.contains("(*)")))
    passes = (~norm.startswith("SELECT") | has_any(["WHERE ", "LIMIT ", "TOP ", "FETCH NEXT"])
              | aggregate_only)
    return ~passes
