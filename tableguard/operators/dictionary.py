"""Dictionary (D) detector: spans for terms of a user-supplied word table.

Names, places, conditions and the like cannot be found by patterns; with a
term table ``(label, term)`` they are found by joining the text's word n-grams
with the terms.  Nothing ships with the package: an empty table finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableguard.functions.pii_patterns import SCORE_DICTIONARY
from tableguard.functions.sums import running_sum
from tableguard.operators.spans import explode_rows
from tableguard.plans.joins import checked_broadcast
from tableguard.session import written

WORD_RE = r"[\p{L}\p{M}\p{N}]+(?:['\-][\p{L}\p{M}\p{N}]+)*"
_WS = r"[ \t\r\n]+"


def normalize_term(col: Column) -> Column:
    """Lower case, runs of whitespace folded to one space, trimmed."""
    return F.lower(F.regexp_replace(F.btrim(col), _WS, " "))


def term_table(dictionary: DataFrame, label_col: str = "label", term_col: str = "term") -> DataFrame:
    """(label, key, first, k): normalised terms with their first word and number of words."""
    words = F.regexp_extract_all("key", F.lit(WORD_RE), F.lit(0))
    return (dictionary.select(F.col(label_col).alias("label"), normalize_term(F.col(term_col)).alias("key"))
            .where(F.col("key") != F.lit("")).distinct()
            .select("label", "key", F.get(words, F.lit(0)).alias("first"), F.size(words).alias("k")).where("k > 0"))


def candidate_grams(df: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(id, start, end, key, value) of the word n-grams that may be a term.

    A prefix table, first word to lengths, says where a term can begin and how long the
    terms that begin there are; only n-grams of those lengths are built.  So a term of
    thirty words adds one n-gram where its first word stands, and nothing elsewhere.
    Words and gaps are cut once into a written table; (row, place, word) records meet
    the prefix table, and the places that remain go back to their rows.
    """
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                     F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0)).alias("w"), F.split(text, WORD_RE, -1).alias("p"))
    rows = written(rows.where(F.size("w") > 0), "dictionary-words")
    begins = terms.groupBy("first").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    places = rows.select("row", F.posexplode(F.transform("w", F.lower)).alias("i", "first"))
    hits = (places.join(checked_broadcast(begins), "first").groupBy("row")
            .agg(F.collect_list(F.struct((F.col("i") + 1).alias("i"), "ks")).alias("hits")))
    # gap and word lengths, one after the other: g1 w1 g2 w2 ...
    lengths = F.flatten(F.zip_with("w", F.slice("p", 1, F.size("w")), lambda w, p: F.array(F.char_length(p), F.char_length(w))))
    found = rows.join(hits, "row").select("id", "w", "p", running_sum(lengths).alias("at"), "hits")

    def gram(i: Column, k: Column) -> Column:
        tail = F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda j: F.concat(F.get("p", i + j - 1), F.get("w", i + j - 1)))
        value = F.concat(F.element_at("w", i), F.when(k > 1, F.array_join(tail, "")).otherwise(F.lit("")))
        start = F.element_at("at", 2 * i)                     # of word i, from 1
        return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), normalize_term(value).alias("key"), value.alias("value"))

    grams = F.flatten(F.transform("hits", lambda h: F.transform(F.filter(h["ks"], lambda k: h["i"] + k - 1 <= F.size("w")), lambda k: gram(h["i"], k))))
    return explode_rows(found.select(F.col("id").alias(id_col), grams.alias("__g")), "__g", "g").select(id_col, "g.*")


def dictionary_spans(df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame,
                     label_col: str = "label", term_col: str = "term") -> DataFrame:
    """``(id, start, end, label, score, value)`` for every dictionary term in the text.

    N-grams that may be a term (:func:`candidate_grams`) are joined with the terms: a
    broadcast when the table is small (checked), a shuffle join otherwise.
    """
    terms = written(term_table(dictionary, label_col, term_col), "dictionary-terms")
    hits = candidate_grams(df, id_col, text_col, terms).join(checked_broadcast(terms.select("label", "key")), "key")
    return hits.select(id_col, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                       "label", F.lit(SCORE_DICTIONARY).alias("score"), "value")
