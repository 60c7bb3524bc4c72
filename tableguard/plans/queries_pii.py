"""Registered PII queries (detection, filtering, redaction, inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableguard.functions.pii_labels import LABELS, GROUP_DESCRIPTION, detector_kind, pii_labels
from tableguard.functions.pii_patterns import SCORE_DICTIONARY
from tableguard.operators.dictionary import WORD_RE, dictionary_spans
from tableguard.operators.redact import redact_columns, redact_enabled
from tableguard.operators.spans import (
    detect_spans,
    filter_spans,
    pii_inventory,
    redact_spans,
)
from tableguard.plans.oracle import (
    duck_group_map,
    duck_redact_ctes,
    duck_spans,
    q,
)
from tableguard.plans.registry import dealt_table, register, table

def _docs(spark, sf_dir):
    return dealt_table(spark, sf_dir, "documents")


def _inventory_oracle(tbl: str, cols: list[str], labels=None) -> str:
    # per detector counts of accepted spans per row; then per (column, label)
    per_row = []
    for c in cols:
        spans = duck_spans(f"(SELECT row_number() OVER () AS __rid, {c} AS __t FROM {tbl})", "__rid", "__t", labels)
        per_row.append(f"SELECT {q(c)} AS \"column\", __rid, label, count(*) AS n FROM ({spans}) "
                       f"WHERE score >= 0.6 GROUP BY __rid, label")
    body = "\nUNION ALL\n".join(per_row)
    return (f"SELECT \"column\", {duck_group_map(labels)} AS grp, label, count(*) AS rows, "
            f"CAST(sum(n) AS BIGINT) AS spans FROM ({body}) GROUP BY \"column\", label")


@register("detect_spans", lambda: duck_spans("documents", "doc_id", "text"))
def q_detect_spans(spark, sf_dir):
    return detect_spans(_docs(spark, sf_dir), "doc_id", "text")


@register("filter_spans", lambda: f"SELECT * FROM ({duck_spans('documents', 'doc_id', 'text')}) WHERE score >= 0.6")
def q_filter_spans(spark, sf_dir):
    return filter_spans(detect_spans(_docs(spark, sf_dir), "doc_id", "text"), 0.6)


def _redact_text_sql() -> str:
    ctes, last = duck_redact_ctes("documents", ["text"])
    return f"WITH {ctes} SELECT doc_id, text FROM {last}"


@register("redact_spans", _redact_text_sql)
def q_redact_spans(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    spans = filter_spans(detect_spans(docs, "doc_id", "text"), 0.6)
    return redact_spans(docs, "doc_id", "text", spans)


def _redact_all_sql() -> str:
    ctes, last = duck_redact_ctes("documents", ["text", "lang", "source"])
    return f"WITH {ctes} SELECT doc_id, text, lang, source, n_chars FROM {last}"


@register("redact_columns", _redact_all_sql)
def q_redact_columns(spark, sf_dir):
    return redact_columns(_docs(spark, sf_dir))


def _enabled_flags(docs):
    # data-derived connection flags: a source is PII-guarded when most of its
    # documents are English
    return (docs.groupBy("source")
            .agg((F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)) * 2 > F.count(F.lit(1)))
                 .alias("pii_enabled")))


def _redact_enabled_sql() -> str:
    ctes, last = duck_redact_ctes("documents", ["text", "lang"])
    return (f"WITH flags AS (SELECT source AS __src, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) * 2 > count(*) "
            f"AS __on FROM documents GROUP BY source), {ctes} "
            f"SELECT r.doc_id, r.text, r.lang, r.source, r.n_chars FROM {last} r JOIN flags f ON r.source = f.__src "
            f"WHERE f.__on UNION ALL SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars FROM documents d "
            f"JOIN flags f ON d.source = f.__src WHERE NOT f.__on")


@register("redact_enabled_sources", _redact_enabled_sql)
def q_redact_enabled(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return redact_enabled(docs, "source", _enabled_flags(table(spark, sf_dir, "documents")), ["text", "lang"])


@register("pii_inventory", lambda: _inventory_oracle("documents", ["text", "source"]))
def q_pii_inventory(spark, sf_dir):
    return pii_inventory(_docs(spark, sf_dir), ["text", "source"])


def _labels_sql() -> str:
    rows = ", ".join(f"({q(lab)}, {q(grp)}, {q(GROUP_DESCRIPTION[grp])}, {q(detector_kind(lab))}, {i + 1})"
                     for i, (lab, grp) in enumerate(LABELS))
    return (f"WITH lab(label, grp, description, detector, label_no) AS (VALUES {rows}), "
            f"inv AS ({_inventory_oracle('documents', ['text'])}) "
            f"SELECT l.label, l.grp, l.description, l.detector, CAST(l.label_no AS INTEGER) AS label_no, "
            f"CAST(coalesce(i.rows, 0) AS BIGINT) AS rows, CAST(coalesce(i.spans, 0) AS BIGINT) AS spans "
            f"FROM lab l LEFT JOIN inv i ON l.label = i.label")


@register("pii_labels", _labels_sql)
def q_pii_labels(spark, sf_dir):
    inv = pii_inventory(_docs(spark, sf_dir), ["text"]).select("label", "rows", "spans")
    return (F.broadcast(pii_labels(spark)).join(inv, "label", "left")
            .select("label", "grp", "description", "detector", "label_no",
                    F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
                    F.coalesce("spans", F.lit(0)).cast("long").alias("spans")))


def _terms(spark, sf_dir):
    """A term table from ``benchmark``: each item's first word and its first two words."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD_RE), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") >= 2)
    return items.select(F.lit("company_name").alias("label"), F.element_at("w", 1).alias("term")).unionByName(
        items.select(F.lit("name").alias("label"), F.concat(F.element_at("w", 1), F.lit("  "), F.upper(F.element_at("w", 2))).alias("term")))


def _dictionary_sql() -> str:
    w = q(WORD_RE)
    start = ("(coalesce(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))), 0) "
             "+ coalesce(list_sum(list_transform(list_slice(w, 1, i - 1), lambda y: length(y))), 0))")
    return f"""
WITH b AS (SELECT regexp_extract_all(text, {w}, 0) AS w FROM benchmark),
t AS (SELECT DISTINCT 'company_name' AS label, lower(w[1]) AS key, 1 AS k FROM b WHERE len(w) >= 2
      UNION SELECT DISTINCT 'name', lower(w[1]) || ' ' || lower(upper(w[2])), 2 FROM b WHERE len(w) >= 2),
d AS (SELECT doc_id, regexp_extract_all(text, {w}, 0) AS w, string_split_regex(text, {w}) AS p FROM documents),
g AS (SELECT doc_id, w, p, unnest(range(1, len(w) + 1)) AS i FROM d),
v AS (SELECT doc_id, w, p, i, 1 AS k, w[i] AS value FROM g
      UNION ALL SELECT doc_id, w, p, i, 2, w[i] || p[i + 1] || w[i + 1] FROM g WHERE i < len(w)),
h AS (SELECT v.*, t.label FROM v JOIN t ON t.k = v.k AND lower(regexp_replace(v.value, '[ \t\r\n]+', ' ', 'g')) = t.key)
SELECT doc_id, CAST({start} AS INTEGER) AS start, CAST({start} + length(value) AS INTEGER) AS "end", label,
       CAST({SCORE_DICTIONARY} AS DOUBLE) AS score, value FROM h"""


@register("dictionary_labels", _dictionary_sql)
def q_dictionary_labels(spark, sf_dir):
    """Dictionary (name-like) labels: terms of a table found in every document."""
    return dictionary_spans(_docs(spark, sf_dir), "doc_id", "text", _terms(spark, sf_dir))
