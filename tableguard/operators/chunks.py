"""Cutting long texts into chunks at safe boundaries, and redacting long texts
chunk by chunk.

A chunk is at most ``max_len`` characters.  When more text remains, the cut is
made just after the last row separator inside the last 100 characters of the
window, else the last column separator, else the last ``": "``, else the last
whitespace character, else at ``max_len`` exactly.  The chunks concatenate back
to the text.

All of it is one regular expression whose ordered alternatives encode those
priorities (greedy counted repeats pick the *last* separator), applied with
``regexp_extract_all``: one pass per text, no UDF, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableguard.functions.sums import running_sum
from tableguard.operators.spans import explode_rows, redact_with_spans

# --- fixed values: must equal the reference's chunking rules ---
DEFAULT_MAX_LEN = 1800                 # characters per model chunk
LOOK_BACK = 100                        # characters searched back for a boundary
ROW_SEP = " <||ROW_SEP||> "
COL_SEP = " <||SEP||> "
KV_SEP = ": "
WHITESPACE = " \n\t\r"
# --- end of fixed values ---

WINDOW_BEFORE = 100    # characters of the previous chunk a model also sees
WINDOW_AFTER = 200     # characters of the next chunk a model also sees


def _quote(s: str) -> str:
    return "".join("\\" + c if c in r".^$|?*+()[]{}\\" else c for c in s)


def chunk_pattern(max_len: int = DEFAULT_MAX_LEN, row_sep: str = ROW_SEP, col_sep: str = COL_SEP) -> str:
    """The chunking regex for ``max_len`` (Java and RE2 read it alike)."""
    if max_len < 1:
        raise ValueError("max_len must be >= 1")
    m, lo = max_len, max(0, max_len - LOOK_BACK)
    alts = [f".{{1,{m}}}\\z"]
    for sep in (row_sep, col_sep, KV_SEP):
        if m - len(sep) >= lo:
            alts.append(f".{{{lo},{m - len(sep)}}}{_quote(sep)}")
    if m - 1 >= lo:
        alts.append(f".{{{lo},{m - 1}}}[ \\n\\t\\r]")
    alts.append(f".{{{m}}}")
    return "(?s)(?:" + "|".join(alts) + ")"


def chunk_array(text: Column, max_len: int = DEFAULT_MAX_LEN, row_sep: str = ROW_SEP,
                col_sep: str = COL_SEP) -> Column:
    """The chunks of one text, as ``array<string>`` (empty for an empty text)."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(max_len, row_sep, col_sep)), F.lit(0))


def _starts(chunks: Column) -> Column:
    """0-based character start of every chunk (running sum inside the row)."""
    return running_sum(F.transform(chunks, F.char_length))


def chunk_text(df: DataFrame, id_col: str, text_col: str, max_len: int = DEFAULT_MAX_LEN,
               row_sep: str = ROW_SEP, col_sep: str = COL_SEP) -> DataFrame:
    """``(id, chunk_no, start, chunk)``, ``chunk_no`` from 0, ``start`` in characters."""
    staged = df.select(id_col, text_col).select(
        id_col, chunk_array(F.col(text_col), max_len, row_sep, col_sep).alias("__c"))
    staged = staged.select(id_col, F.zip_with("__c", _starts(F.col("__c")),
                                              lambda c, s: F.struct(c.alias("chunk"), s.alias("start"))).alias("__z"))
    numbered = staged.select(id_col, F.transform("__z", lambda z, i: F.struct(i.alias("no"), z.alias("z")))
                             .alias("__n"))
    return (explode_rows(numbered, "__n", "e")
            .select(id_col, F.col("e.no").cast("int").alias("chunk_no"),
                    F.col("e.z.start").alias("start"), F.col("e.z.chunk").alias("chunk")))


def chunk_roundtrip(chunks: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, equal)``: do the chunks, in order, join back to the text?

    Chunks are re-assembled per id (each id's chunks come from one text, so a
    group is bounded by that text's size) and compared with the original.
    """
    joined = (chunks.groupBy(id_col)
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))),
                                            lambda s: s["chunk"]), "").alias("__joined")))
    return (texts.select(id_col, text_col).join(joined, id_col, "left")
            .select(id_col, (F.coalesce(F.col("__joined"), F.lit("")) == F.coalesce(F.col(text_col), F.lit("")))
                    .alias("equal")))


def chunk_windows(df: DataFrame, id_col: str, text_col: str, max_len: int = DEFAULT_MAX_LEN,
                  before: int = WINDOW_BEFORE, after: int = WINDOW_AFTER) -> DataFrame:
    """``(id, chunk_no, start, clen, wstart, window, rest)``: every chunk with context.

    The window is the chunk plus ``before`` characters of the text ahead of it
    and ``after`` behind it, cut from the text inside its own row (no join).
    ``rest`` is what follows the window up to the next blank: a value that touches
    the window's end goes on there.
    """
    texts = df.select(id_col, text_col)
    staged = texts.select(id_col, text_col, chunk_array(F.col(text_col), max_len).alias("__c"))
    staged = staged.select(id_col, text_col, "__c", _starts(F.col("__c")).alias("__s"))
    text = F.col(text_col)

    def window(c, i):
        start = F.element_at(F.col("__s"), i + 1)
        ws = F.greatest(start - before, F.lit(0))
        wend = start + F.char_length(c) + after
        return F.struct(i.alias("chunk_no"), start.alias("start"), F.char_length(c).alias("clen"),
                        ws.alias("wstart"), F.substring(text, ws + 1, wend - ws).alias("window"),
                        F.regexp_extract(F.substr(text, wend + 1), "^[^ \\t\\r\\n]*", 0).alias("rest"))

    per_row = staged.select(id_col, F.transform("__c", window).alias("__w"))
    return explode_rows(per_row, "__w", "w").select(id_col, "w.*")


def redact_long_text(df: DataFrame, id_col: str, text_col: str, max_len: int = DEFAULT_MAX_LEN,
                     labels=None, threshold: float = 0.6) -> DataFrame:
    """Redact texts of any length; ``max_len`` only matters to callers that chunk for a model.

    The detectors read the whole cell, so a value that runs over chunk edges is seen
    and hidden whole, and the result is that of :func:`redact_columns`.  Windows of
    chunks (:func:`chunk_windows`) are for models, which cannot read a whole text.
    """
    return redact_with_spans(df.select(id_col, text_col), text_col, threshold, labels)


__all__ = ["chunk_pattern", "chunk_array", "chunk_text", "chunk_roundtrip", "redact_long_text"]
