"""TOON text encoding of rows, as a column expression and a text sink.

A table of N rows with fields f1..fk becomes a header line ``[N]{f1,...,fk}:``
followed by one line per row, two spaces then the comma-separated values.
Null is ``null``, numbers and booleans are bare, a string is quoted when it is
empty, has outer spaces, holds one of ``, : " \\`` or a control character, or
would read back as a number, boolean or null.  Inside quotes ``\\``, ``"``,
newline, carriage return and tab are backslash-escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableguard.operators.shaping import sequence_rows

_NUMBER_LIKE = r"^-?(?:[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_NEEDS_QUOTES = "[,:\"\\\\\\x00-\\x1f]"


def toon_string(s: Column) -> Column:
    esc = F.regexp_replace(s, r"\\", r"\\\\")
    esc = F.regexp_replace(esc, "\"", "\\\\\"")
    esc = F.regexp_replace(esc, "\n", r"\\n")
    esc = F.regexp_replace(esc, "\r", r"\\r")
    esc = F.regexp_replace(esc, "\t", r"\\t")
    quote = ((s == F.lit("")) | (s != F.btrim(s, F.lit(" "))) | s.rlike(_NEEDS_QUOTES) | s.rlike(_NUMBER_LIKE)
             | F.lower(s).isin("true", "false", "null"))
    return F.when(quote, F.concat(F.lit("\""), esc, F.lit("\""))).otherwise(s)


def toon_number(c: Column) -> Column:
    """A float in plain decimal digits, no exponent, no trailing zeros; not finite: null."""
    text = c.cast("double").cast("string")
    whole = F.regexp_extract(text, r"^-?([0-9]+)", 1)
    part = F.regexp_replace(F.regexp_extract(text, r"[.]([0-9]+)", 1), "0+$", "")
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    digits = F.concat(whole, part)
    point = F.char_length(whole) + power          # where the decimal point stands in the digits
    left = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substr(digits, F.lit(1), F.least(point, F.char_length(digits))), point, "0"))
    right = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(F.substr(digits, point + 1))
    right = F.regexp_replace(right, "0+$", "")
    body = F.concat(left, F.when(right != "", F.concat(F.lit("."), right)).otherwise(""))
    sign = F.when((c < 0) & (body != "0"), "-").otherwise("")
    return F.when(text.rlike("^-?[0-9]"), F.concat(sign, body))


def toon_value(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        v = toon_string(c)
    elif isinstance(dt, T.BooleanType):
        v = F.when(c, F.lit("true")).when(~c, F.lit("false"))
    elif isinstance(dt, (T.IntegralType, T.DecimalType)):
        v = c.cast("string")
    elif isinstance(dt, T.FractionalType):
        v = toon_number(c)
    else:
        v = toon_string(c.cast("string"))
    return F.coalesce(v, F.lit("null"))


def toon_field_name(name: str) -> str:
    if name and all(ch.isalnum() or ch == "_" for ch in name) and not name[0].isdigit():
        return name
    return "\"" + name.replace("\\", "\\\\").replace("\"", "\\\"") + "\""


def toon_rows(df: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """``(line_no, line)``: the header (line 0) and one line per row.

    With ``order_cols`` (unique together) rows are lines 1, 2, ... in that order; the
    numbering is :func:`sequence_rows`, so no task sorts the whole table.  Without, row
    lines are all 1: they have no order.
    """
    header_fields = ",".join(toon_field_name(f.name) for f in df.schema.fields)
    body = F.concat(F.lit("  "), F.concat_ws(",", *[toon_value(F.col(f"`{f.name}`"), f.dataType)
                                                   for f in df.schema.fields]))
    if order_cols:
        keyed = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(order_cols)], body.alias("line"))
        numbered = sequence_rows(keyed, [], [f"__k{i}" for i in range(len(order_cols))], "line_no")
        rows = numbered.select("line_no", "line")
    else:
        rows = df.select(F.lit(1).cast("long").alias("line_no"), body.alias("line"))
    header = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("["), F.col("n").cast("string"),
                                                         F.lit(f"]{{{header_fields}}}:")).alias("line"))
    return header.unionByName(rows)


def write_toon(df: DataFrame, path: str) -> None:
    """Write the TOON lines as text (header file first by name, rows in parallel)."""
    lines = toon_rows(df)
    lines.where("line_no = 0").select("line").write.mode("overwrite").text(f"{path.rstrip('/')}/_header")
    lines.where("line_no > 0").select("line").write.mode("overwrite").text(f"{path.rstrip('/')}/rows")
