"""Registered chunking, long-text redaction, model-span, stream and
source/sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tableguard.functions.pii_patterns import DETECTORS
from tableguard.operators.chunks import COL_SEP, KV_SEP, LOOK_BACK, ROW_SEP, chunk_roundtrip, chunk_text, redact_long_text
from tableguard.operators.model import DetectorPredictor, PatternPredictor, model_row_spans, model_spans
from tableguard.plans.layout import dealt_tasks
from tableguard.plans.oracle import duck_redact_ctes, duck_spans, q
from tableguard.plans.registry import dealt_table, register, table
from tableguard.session import scratch_path
from tableguard.sources.catalog import register_source, reload_tables
from tableguard.sources.jdbc import jdbc_scan
from tableguard.sources.toon import toon_rows
from tableguard.streaming.redact import parquet_stream, redact_stream, run_available

RELATIONAL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def _chunks_sql(m: int = 1800) -> str:
    """The chunk rules cut by cut: one step of the recursion takes one chunk off the rest."""
    lo = m - LOOK_BACK

    def after_last(sep: str) -> str:
        """Characters up to and with the last separator that starts at ``lo`` or later (null: none)."""
        found = f"strpos(reverse(tail), reverse({q(sep)}))"
        return f"CASE WHEN {found} > 0 THEN {lo} + length(tail) - {found} + 1 END"

    blank = ", ".join(f"CASE WHEN strpos(reverse(tail), {c}) > 0 THEN {lo} + length(tail) - strpos(reverse(tail), {c}) + 1 END"
                      for c in ("' '", "chr(10)", "chr(9)", "chr(13)"))
    cut = (f"CASE WHEN length(rest) <= {m} THEN length(rest) ELSE coalesce({after_last(ROW_SEP)}, {after_last(COL_SEP)}, "
           f"{after_last(KV_SEP)}, greatest({blank}), {m}) END")
    step = f"(SELECT *, substr(rest, {lo + 1}, {LOOK_BACK}) AS tail FROM {{src}})"
    return f"""
WITH RECURSIVE c AS (
  SELECT doc_id, 0 AS chunk_no, 0 AS start, {cut} AS n, rest FROM {step.format(src="(SELECT doc_id, text AS rest FROM documents WHERE text <> '')")}
  UNION ALL
  SELECT doc_id, chunk_no, start, {cut} AS n, rest FROM {step.format(src="(SELECT doc_id, chunk_no + 1 AS chunk_no, start + n AS start, substr(rest, n + 1) AS rest FROM c WHERE n < length(rest))")}
)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS start, substr(rest, 1, n) AS chunk FROM c"""


@register("chunk_text", _chunks_sql)
def q_chunk_text(spark, sf_dir):
    """Every document cut into chunks of at most 1800 characters."""
    return chunk_text(dealt_table(spark, sf_dir, "documents"), "doc_id", "text", 1800)


@register("chunk_roundtrip", "SELECT doc_id, true AS equal FROM documents")
def q_chunk_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return chunk_roundtrip(chunk_text(docs, "doc_id", "text", 1800), docs, "doc_id", "text")


def _long_sql() -> str:
    ctes, last = duck_redact_ctes("documents", ["text"])
    return f"WITH {ctes} SELECT doc_id, text FROM {last}"


@register("redact_long_text", _long_sql)
def q_redact_long_text(spark, sf_dir):
    return redact_long_text(dealt_table(spark, sf_dir, "documents"), "doc_id", "text", 1800)


def email_predictor():
    """Stand-in predictor: the email pattern, score 0.9 (no model ships here)."""
    pattern = next(d.pattern for d in DETECTORS if d.label == "email")
    return PatternPredictor({"email": pattern}, 0.9)


PATTERN_LABELS = sorted({d.label for d in DETECTORS})


@register("model_spans", lambda: duck_spans("documents", "doc_id", "text", PATTERN_LABELS))
def q_model_spans(spark, sf_dir):
    """All labels that have a detector, found by a predictor in windows of the documents."""
    # the model sees at most 1800 characters at a time, as a 512-token model needs
    return model_spans(dealt_table(spark, sf_dir, "documents"), "doc_id", "text", DetectorPredictor, PATTERN_LABELS,
                       "detectors-1", 256, max_len=1800)


_TALK_ID = "conv_id * 100000 + turn"


@register("model_row_spans", lambda: duck_spans(f"(SELECT {_TALK_ID} AS row_id, text FROM conversations)", "row_id", "text", PATTERN_LABELS))
def q_model_row_spans(spark, sf_dir):
    """The same labels in the turns of all conversations, several turns to a model text."""
    rows = table(spark, sf_dir, "conversations").select(F.expr(_TALK_ID).alias("row_id"), "conv_id", "turn", "text")
    return model_row_spans(rows, "row_id", "text", ["conv_id", "turn"], DetectorPredictor, PATTERN_LABELS, "detectors-1", 256)


def _stream_sql() -> str:
    ctes, last = duck_redact_ctes("documents", ["text", "lang", "source"])
    return f"WITH {ctes} SELECT doc_id, text, lang, source, n_chars FROM {last}"


@register("redact_stream", _stream_sql)
def q_redact_stream(spark, sf_dir):
    """Documents landed as files in a folder, redacted by a streaming query."""
    docs = table(spark, sf_dir, "documents")
    landing = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
    files = max(2, -(-dealt_tasks(docs) // 3))      # of a micro-batch, so that each has work for all cores
    docs.repartition(3 * files).write.mode("overwrite").parquet(landing)
    stream = parquet_stream(spark, landing, docs, max_files_per_trigger=files)     # three micro-batches
    name = uuid.uuid4().hex
    return run_available(redact_stream(stream), scratch_path(spark, f"redacted-{name}"), scratch_path(spark, f"ckpt-{name}"))


def _tables_sql(prefix: str, names: list[str], label: str) -> str:
    return " UNION ALL ".join(f"SELECT {q(label)} AS source, {q(prefix + t)} AS \"table\", count(*) AS rows "
                              f"FROM {t}" for t in names)


@register("source_tables", lambda: _tables_sql("testdata_", RELATIONAL + ["documents", "events"], "testdata"))
def q_source_tables(spark, sf_dir):
    views = register_source(spark, "testdata", {"format": "parquet", "path": sf_dir,
                                                "tables": RELATIONAL + ["documents", "events"]})
    parts = [spark.table(v).agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit("testdata").alias("source"), F.lit(v).alias("table"), "rows") for v in views]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("table_reload", lambda: " UNION ALL ".join(
    f"SELECT {q(t)} AS \"table\", count(*) AS rows FROM {t}" for t in RELATIONAL))
def q_table_reload(spark, sf_dir):
    base = scratch_path(spark, f"reload-{uuid.uuid4().hex}")
    return reload_tables({t: table(spark, sf_dir, t) for t in RELATIONAL}, base)


@register("jdbc_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_jdbc_scan(spark, sf_dir):
    """``customer`` loaded into an embedded in-memory Derby database (no
    server, no port) and read back with four range-partitioned queries."""
    url = f"jdbc:derby:memory:tg{uuid.uuid4().hex[:8]};create=true"
    cust = table(spark, sf_dir, "customer")
    (cust.write.format("jdbc").option("url", url).option("dbtable", "CUSTOMER")
     .option("driver", "org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save())
    df = jdbc_scan(spark, {"url": url}, "CUSTOMER", partition_column="c_custkey", num_partitions=4)
    return df.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _toon_sql() -> str:
    def s(c):
        esc = (f"replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), "
               f"chr(13), '\\r'), chr(9), '\\t')")
        quote = (f"({c} = '' OR {c} <> trim({c}, ' ') OR regexp_matches({c}, {q(chr(91) + ',:' + chr(34) + chr(92) * 2 + chr(92) + 'x00-' + chr(92) + 'x1f]')}) "
                 f"OR regexp_matches({c}, {q('^-?(?:[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?)$')}) "
                 f"OR lower({c}) IN ('true', 'false', 'null'))")
        return f"coalesce(CASE WHEN {quote} THEN '\"' || {esc} || '\"' ELSE {c} END, 'null')"
    body = (f"'  ' || concat_ws(',', coalesce(CAST(conv_id AS VARCHAR), 'null'), "
            f"coalesce(CAST(turn AS VARCHAR), 'null'), coalesce(regexp_replace(CAST(turn / 4.0 AS VARCHAR), '[.]0$', ''), 'null'), "
            f"{s('role')}, {s('text')})")
    return (f"SELECT CAST(0 AS BIGINT) AS line_no, '[' || CAST(count(*) AS VARCHAR) || ']{{conv_id,turn,quarter,role,text}}:' AS line "
            f"FROM conversations UNION ALL SELECT row_number() OVER (ORDER BY conv_id, turn) AS line_no, {body} AS line FROM conversations")


@register("toon_rows", _toon_sql)
def q_toon_rows(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return toon_rows(conv.select("conv_id", "turn", (F.col("turn") / 4.0).alias("quarter"), "role", "text"), ["conv_id", "turn"])
