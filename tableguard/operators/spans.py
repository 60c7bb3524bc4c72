"""PII span detection, filtering and span-based redaction.

A span is ``struct(start int, end int, label string, score double, value string)``
with 0-based character offsets, ``end`` exclusive.  Detection is one
``regexp_extract_all`` per detector on each text; offsets come from
``split(text, pattern, -1)`` (the pieces between matches) summed with the match
lengths inside the row.  Nothing leaves the row, so detection never shuffles and
works unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableguard.functions.pii_labels import DEFAULT_THRESHOLD, GROUP_OF, validate_labels
from tableguard.functions.pii_patterns import (
    SCORE_CHECK_FAIL,
    SCORE_CHECK_PASS,
    Detector,
    detectors_for,
    redaction_token,
)
from tableguard.functions.sums import let, running_max, running_sum

SPAN_STRUCT = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("value", T.StringType()),
])
SPAN_ARRAY = T.ArrayType(SPAN_STRUCT)
FEW = 32            # spans of a cell up to which comparing all of them is the cheapest
CUT = 512           # characters of the blocks that a text with more spans is cut into


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _check_sql(value: str, check: str) -> str:
    """Score of a matched value under its detector's checksum or shape test."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    return (f"CASE WHEN (CASE {check} WHEN 'card' THEN char_length({digits}) <= 19 AND luhn_check({digits}) "
            f"WHEN 'imei' THEN char_length({digits}) = 15 AND luhn_check({digits}) "
            f"WHEN 'vin' THEN char_length({value}) = 17 AND {value} RLIKE '[A-Z]' AND {value} RLIKE '[0-9]' END) "
            f"THEN {SCORE_CHECK_PASS}D ELSE {SCORE_CHECK_FAIL}D END")


def _found_sql(text: str, lowered: str, i: int, d: Detector) -> str:
    """One detector's matches, values and the pieces before them; null if it found nothing.

    A hint is a substring that every match contains, so the shortcut never changes a
    result; it skips the regex scan on texts that cannot match.
    """
    pattern = sql_text(d.pattern)
    values = f"regexp_extract_all({text}, {pattern}, {d.group})" if d.group else "m"
    found = (f"transform(array(regexp_extract_all({text}, {pattern}, 0)), m -> IF(size(m) > 0, named_struct('d', {i}, 'ms', m, "
             f"'vs', {values}, 'ps', slice(split({text}, {pattern}, -1), 1, size(m))), NULL))[0]")
    gate = " OR ".join(f"contains({lowered}, {sql_text(h)})" for h in d.hints)
    return f"IF({gate}, {found}, NULL)" if gate else found


def with_spans(df: DataFrame, text_col: str, out_col: str = "spans", labels=None,
               detectors: list[Detector] | None = None) -> DataFrame:
    """Add ``out_col`` = array of all pattern/context spans found in ``text_col``.

    Three projections, written as SQL text so that building them takes one call each:

    1. ``lower(text)`` once (for the keyword shortcuts);
    2. per detector that found something, its matches, their value groups and the
       pieces of text before them;
    3. the spans: a match starts where the pieces and the matches before it end (running
       sums, linear in the number of matches), and the value, a suffix of the match,
       gives the span.
    """
    dets = detectors if detectors is not None else detectors_for(validate_labels(labels))
    kept = [c for c in df.columns if c != out_col]
    if not dets:
        return df.select(*kept, F.array().cast(SPAN_ARRAY).alias(out_col))
    text, kind = f"`{text_col}`", SPAN_ARRAY.simpleString()
    lowered = df.selectExpr("*", f"lower({text}) AS __lt")
    found = ", ".join(_found_sql(text, "__lt", i, d) for i, d in enumerate(dets))
    staged = lowered.select(*[F.col(f"`{c}`") for c in df.columns], F.expr(f"filter(array({found}), x -> x IS NOT NULL)").alias("__found"))
    names = ", ".join(sql_text(d.label) for d in dets)
    scores = ", ".join(f"{d.score}D" for d in dets)
    checks = ", ".join(sql_text(d.check or "") for d in dets)
    # where a match and the piece before it begin, for every match of a detector
    sizes = "transform(__found, x -> zip_with(x.ms, x.ps, (m, p) -> char_length(p) + char_length(m)))"
    staged = staged.withColumn("__sizes", F.expr(sizes))
    staged = staged.withColumn("__at", F.transform("__sizes", running_sum))
    end = "y.__at[k] + y.__sizes[k]"
    value = "y.__found.vs[k]"
    kind_of = "y.__found.d"
    span = (f"named_struct('start', {end} - char_length({value}), 'end', {end}, 'label', array({names})[{kind_of}], "
            f"'score', IF(array({checks})[{kind_of}] = '', array({scores})[{kind_of}], {_check_sql(value, f'array({checks})[{kind_of}]')}), "
            f"'value', {value})")
    spans = f"flatten(transform(arrays_zip(__found, __at, __sizes), y -> transform(y.__sizes, (z, k) -> {span})))"
    out = F.expr(f"IF({text} IS NULL, cast(array() AS {kind}), {spans})").alias(out_col)
    return staged.select(*[F.col(f"`{c}`") for c in kept], out)


def detect_spans(df: DataFrame, id_col: str, text_col: str, labels=None) -> DataFrame:
    """One row per detected span: ``(id, start, end, label, score, value)``."""
    staged = with_spans(df.select(id_col, text_col), text_col, "__spans", labels)
    return (explode_rows(staged.select(id_col, "__spans"), "__spans", "s")
            .select(id_col, "s.start", "s.end", "s.label", "s.score", "s.value"))


def explode_rows(df: DataFrame, array_col: str, alias: str) -> DataFrame:
    """``explode`` that keeps the array's expression where it was computed.

    An inner ``explode`` makes Catalyst infer ``size(array) > 0`` and push that
    filter below the projection, which inlines the whole span expression (every
    regex) into the filter and evaluates it twice or more.  ``explode_outer``
    plus a null check on the generated column gives the same rows without it.
    """
    keep = [c for c in df.columns if c != array_col]
    return (df.select(*keep, F.explode_outer(array_col).alias(alias))
            .where(F.col(alias).isNotNull()))


def filter_spans(spans: DataFrame, threshold: float = DEFAULT_THRESHOLD, labels=None) -> DataFrame:
    """Keep spans with ``score >= threshold`` and a configured label.

    The label list has at most 64 entries, so it is an ``isin`` on a literal
    set (no join at all).
    """
    labels = validate_labels(labels)
    return spans.where((F.col("score") >= F.lit(threshold)) & F.col("label").isin(labels))


def filter_span_array(spans: Column, threshold: float = DEFAULT_THRESHOLD, labels=None) -> Column:
    labels = validate_labels(labels)
    allowed = F.array(*[F.lit(x) for x in labels])
    return F.filter(spans, lambda s: (s["score"] >= F.lit(threshold)) & F.array_contains(allowed, s["label"]))


def _ranked(spans: Column) -> Column:
    """Spans from the best to the worst."""
    ranked = F.transform(spans, lambda s: F.struct(
        (-s["score"]).alias("k1"), (s["start"] - s["end"]).alias("k2"), s["start"].alias("k3"),
        s["label"].alias("k4"), s.alias("s")))
    return F.transform(F.array_sort(ranked), lambda r: r["s"])


def _best_of_few(spans: Column) -> Column:
    """Every span against every kept one: for the few that can touch each other."""
    return F.aggregate(
        _ranked(spans), F.array().cast(SPAN_ARRAY),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept)
        .otherwise(F.concat(kept, F.array(s))))


def _best_by_run(spans: Column) -> Column:
    """Best of spans sorted by start: only those of a run that hangs together are compared."""
    def of_runs(heads: Column) -> Column:
        def one(b, j):
            run = F.slice(spans, b + 1, F.coalesce(F.get(heads, j + 1), F.size(spans)) - b)
            return let(run, lambda g: F.when(F.size(g) == 1, g).otherwise(_best_of_few(g)))
        return F.flatten(F.transform(heads, one))

    def heads(ends: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= F.get(ends, i))

    return let(let(running_max(F.transform(spans, lambda s: s["end"])), heads), of_runs)


def resolve_overlaps(spans: Column) -> Column:
    """Drop spans that overlap a better one, inside the row.

    Better = higher score, then longer, then earlier, then label order.  Empty
    spans (start >= end) are dropped.  More than ``FEW`` spans are sorted and cut into
    runs that hang together (a sweep with the running end); only spans of one run can
    touch, so the work is linear but for long runs of overlapping spans.
    """
    nonempty = F.filter(spans, lambda s: s["start"] < s["end"])
    return let(F.array_sort(nonempty), lambda s: F.when(F.size(s) <= FEW, _best_of_few(s)).otherwise(_ranked(_best_by_run(s))))


def _redacted(span: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), span["label"], F.lit("]"))


def apply_spans(text: Column, spans: Column, mark: Callable[[Column], Column] = _redacted) -> Column:
    """Replace each span by its mark: the pieces between spans, joined once.

    Spans must not overlap (see :func:`resolve_overlaps`).  Offsets are in
    characters, as produced by :func:`detect_spans`.  A piece of a text with more than
    ``FEW`` spans is cut from blocks of ``CUT`` characters, since ``substr`` counts
    from the beginning of its argument.
    """
    def splice(ordered, cut):
        def piece(s, i):
            before = F.when(i > 0, F.get(ordered, F.greatest(i - 1, F.lit(0)))["end"]).otherwise(F.lit(0))
            return F.concat(cut(before, s["start"]), mark(s))

        return F.concat(F.array_join(F.transform(ordered, piece), ""), cut(F.element_at(ordered, -1)["end"], F.char_length(text)))

    def plain(a, b):
        return F.substr(text, a + 1, b - a)

    def from_blocks(blocks):
        def cut(a, b):
            first, last = F.floor(a / CUT).cast("int"), F.floor((b - 1) / CUT).cast("int")
            over = F.concat(F.substr(F.get(blocks, first), a - first * CUT + 1),
                            F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                            F.substr(F.get(blocks, last), F.lit(1), b - last * CUT))
            return F.when(b <= a, F.lit("")).when(first == last, F.substr(F.get(blocks, first), a - first * CUT + 1, b - a)).otherwise(over)
        return cut

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    # sorted once, bound to a lambda variable
    spliced = let(F.array_sort(spans), lambda ordered: F.when(F.size(ordered) <= FEW, splice(ordered, plain)).otherwise(
        let(blocks, lambda b: splice(ordered, from_blocks(b)))))
    return F.when(F.size(spans) > 0, spliced).otherwise(text)


def redact_with_spans(df: DataFrame, text_col: str, threshold: float = DEFAULT_THRESHOLD,
                      labels=None, out_col: str | None = None) -> DataFrame:
    """Detect, filter, resolve and splice inside each row (no shuffle)."""
    out_col = out_col or text_col
    staged = with_spans(df, text_col, "__spans", labels)
    kept = staged.withColumn("__spans", resolve_overlaps(filter_span_array(F.col("__spans"), threshold, labels)))
    return kept.withColumn(out_col, apply_spans(F.col(text_col), F.col("__spans"))).drop("__spans")


def redact_spans(df: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    """Redact ``text_col`` with spans computed elsewhere (e.g. by a model).

    Spans are grouped per id (map-side partial collect, one shuffle of the span
    rows only), then joined back to the texts.  Catalyst/AQE pick a broadcast
    join when the span side is small, else a sort-merge join on ``id``.  The id
    must be a key of ``df``; one row's spans are bounded by its own text.
    """
    per_row = (spans.groupBy(id_col)
               .agg(F.collect_list(F.struct(
                   F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                   F.col("label"), F.col("score").cast("double").alias("score"),
                   F.col("value"))).alias("__spans")))
    joined = df.join(per_row, on=id_col, how="left")
    kept = joined.withColumn("__spans", resolve_overlaps(F.coalesce(F.col("__spans"), F.array().cast(SPAN_ARRAY))))
    return kept.withColumn(text_col, apply_spans(F.col(text_col), F.col("__spans"))).drop("__spans")


def pii_inventory(df: DataFrame, columns: list[str], threshold: float = DEFAULT_THRESHOLD,
                  labels=None) -> DataFrame:
    """Counts per (column, label): rows holding the label and spans found.

    One scan: the columns are stacked into ``(column, value)`` records (a
    fixed-size explode), detection runs once over them, spans are counted per
    distinct label inside each record, and the aggregate combines map-side
    before its single shuffle.
    """
    labels = validate_labels(labels)
    groups = F.create_map(*[x for lab in labels for x in (F.lit(lab), F.lit(GROUP_OF[lab]))])
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("__t")) for c in columns])).alias("__x"))
    staged = with_spans(stacked.select("__x.column", "__x.__t"), "__t", "__s", labels)
    kept = filter_span_array(F.col("__s"), threshold, labels)
    per_label = F.transform(
        F.array_distinct(F.transform(kept, lambda s: s["label"])),
        lambda lab: F.struct(lab.alias("label"), F.size(F.filter(kept, lambda s: s["label"] == lab)).alias("n")))
    out = explode_rows(staged.select("column", per_label.alias("__pl")), "__pl", "x")
    return (out.groupBy("column", F.col("x.label").alias("label"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("x.n").cast("long").alias("spans"))
            .select("column", groups[F.col("label")].alias("grp"), "label", "rows", "spans"))


__all__ = [
    "SPAN_ARRAY", "with_spans", "detect_spans", "filter_spans", "filter_span_array",
    "resolve_overlaps", "apply_spans", "redact_with_spans", "redact_spans", "pii_inventory",
    "redaction_token",
]
