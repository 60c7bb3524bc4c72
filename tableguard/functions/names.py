"""Object-name normalisation and match predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's rules ---
MATCH_MODES = ["contains", "prefix", "exact", "glob"]
DETAIL_LEVELS = ["summary", "columns", "full"]
IDENT_TRIM = "\"'`[] "          # stripped around each name part
OUTER_TRIM = " \t\n\r\x00\x0b"  # stripped around the whole value
NEAR_MATCHES = 5
# --- end of fixed values ---

_DOT_SPLIT = r"[ \t\n\r\f\x0B]*\.[ \t\n\r\f\x0B]*"


def normalize_mode(mode: str) -> str:
    m = mode.strip().lower()
    if m not in MATCH_MODES:
        raise ValueError(f'Invalid matchMode value "{mode}". Use one of: {", ".join(MATCH_MODES)}.')
    return m


def normalize_detail(detail: str) -> str:
    d = detail.strip().lower()
    if d not in DETAIL_LEVELS:
        raise ValueError(f'Invalid detail value "{detail}". Use one of: {", ".join(DETAIL_LEVELS)}.')
    return d


def normalize_name(col: Column) -> Column:
    """``struct(canonical, leaf)``: parts split on dots, quotes stripped, lower-cased.

    Blank parts are dropped; with no part left the whole value is normalised
    instead.  A leaf of ``"0"`` falls back to the canonical name.
    """
    trimmed = F.btrim(col, F.lit(OUTER_TRIM))
    parts = F.filter(F.transform(F.split(trimmed, _DOT_SPLIT, -1),
                                 lambda p: F.lower(F.btrim(p, F.lit(IDENT_TRIM)))),
                     lambda p: p != F.lit(""))
    whole = F.lower(F.btrim(trimmed, F.lit(IDENT_TRIM)))
    canonical = F.when(F.size(parts) > 0, F.array_join(parts, ".")).otherwise(whole)
    last = F.element_at(parts, -1)
    leaf = F.when(F.size(parts) > 0, F.when(last == F.lit("0"), canonical).otherwise(last)).otherwise(whole)
    return F.struct(canonical.alias("canonical"), leaf.alias("leaf"))


# an escaped character, a closed bracket expression, or any one character
_GLOB_TOKEN = r"(?s)\\.|\[[!^]?\]?[^\]]*\]|."


def glob_regex(glob: Column) -> Column:
    """Translate an ``fnmatch`` pattern (no flags) into an anchored Java regex.

    ``*``, ``?``, ``[...]``, ``[!...]`` or ``[^...]``, backslash escapes; a bracket
    that is never closed stands for itself, and a range that runs backwards for its
    three characters.
    """
    def piece(tok):
        neg = tok.rlike(r"^\[[!^]")
        body = F.substr(tok, F.when(neg, F.lit(3)).otherwise(F.lit(2)), F.char_length(tok) - F.when(neg, F.lit(3)).otherwise(F.lit(2)))
        backwards = F.exists(F.regexp_extract_all(body, F.lit("(?s).-."), F.lit(0)), lambda r: F.substr(r, F.lit(1), F.lit(1)) > F.substr(r, F.lit(3), F.lit(1)))
        body = F.regexp_replace(body, r"([\\\[\]&^])", r"\\$1")
        body = F.when(backwards, F.regexp_replace(body, "-", r"\\-")).otherwise(body)
        char = F.when(F.char_length(tok) == 2, F.substr(tok, F.lit(2), F.lit(1))).otherwise(tok)
        literal = F.when(char.rlike("^[A-Za-z0-9_]$") | (F.octet_length(char) > 1), char).otherwise(F.concat(F.lit("\\"), char))
        return (F.when(tok == "*", ".*").when(tok == "?", ".")
                .when((F.char_length(tok) > 2) & tok.startswith("["), F.concat(F.lit("["), F.when(neg, "^").otherwise(""), body, F.lit("]")))
                .otherwise(literal))

    tokens = F.regexp_extract_all(glob, F.lit(_GLOB_TOKEN), F.lit(0))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, piece), ""), F.lit("$"))


def glob_literals(glob: Column) -> Column:
    """The runs of plain characters that every match must contain."""
    plain = F.regexp_replace(glob, r"(?s)\\.|\[[!^]?\]?[^\]]*\]", "*")
    return F.regexp_extract_all(plain, F.lit(r"[^*?\[\\]+"), F.lit(0))


def part_matches(name: Column, flt: Column, mode: str) -> Column:
    """Does one part (canonical or leaf) of a name match the same part of a filter?"""
    if mode == "contains":
        return name.contains(flt)
    if mode == "prefix":
        return name.startswith(flt)
    if mode == "exact":
        return name == flt
    return F.regexp_like(name, glob_regex(flt))


def name_matches(name: Column, flt: Column, mode: str) -> Column:
    """Match predicate between two normalised structs (canonical OR leaf)."""
    mode = normalize_mode(mode)
    return part_matches(name["canonical"], flt["canonical"], mode) | part_matches(name["leaf"], flt["leaf"], mode)


def name_distance(name: Column, flt: Column, threshold: int | None = None) -> Column:
    """min(levenshtein of canonical names, levenshtein of leaves).

    With ``threshold`` each distance stops early once it exceeds the
    threshold; such pairs get ``threshold + 1`` (callers keep ``<= threshold``).
    """
    if threshold is None:
        return F.least(F.levenshtein(flt["canonical"], name["canonical"]),
                       F.levenshtein(flt["leaf"], name["leaf"]))
    far = F.lit(threshold + 1)

    def lev(a, b):
        d = F.levenshtein(a, b, threshold)
        return F.when(d < 0, far).otherwise(d)

    return F.least(lev(flt["canonical"], name["canonical"]), lev(flt["leaf"], name["leaf"]))
