"""Registered result-shaping queries (masking, tokens, budgets, batches, paging)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableguard.operators.redact import redact_columns
from tableguard.operators.shaping import (
    assign_batches,
    long_text_columns,
    mask_long_text,
    page,
    split_by_budget,
    with_token_estimate,
)
from tableguard.plans.oracle import duck_redact_ctes
from tableguard.plans.registry import register, table


def _mask_sql(src: str, cols: list[str], str_cols: list[str]) -> str:
    stats = ", ".join(f"max(strlen({c})) AS __max_{c}" for c in str_cols)
    sel = ", ".join(
        (f"CASE WHEN s.__n > 1 AND s.__max_{c} > 200 AND t.{c} IS NOT NULL THEN '<TEXT>' ELSE t.{c} END AS {c}"
         if c in str_cols else f"t.{c}") for c in cols)
    return f"SELECT {sel} FROM {src} t, (SELECT count(*) AS __n, {stats} FROM {src}) s"


_CONV = ["conv_id", "turn", "role", "text"]


@register("mask_long_text", lambda: _mask_sql("conversations", _CONV, ["role", "text"]))
def q_mask_long_text(spark, sf_dir):
    return mask_long_text(table(spark, sf_dir, "conversations"))


_ONE_DOC = "(SELECT * FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents))"
_DOC = ["doc_id", "text", "lang", "source", "n_chars"]


@register("mask_single_row", lambda: _mask_sql(_ONE_DOC, _DOC, ["text", "lang", "source"]))
def q_mask_single_row(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    last = docs.agg(F.max("doc_id").alias("__id"))
    one = docs.join(F.broadcast(last), docs["doc_id"] == F.col("__id"), "left_semi")
    return mask_long_text(one)


def _long_cols_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST(max(strlen({c})) AS BIGINT) AS max_bytes, "
             f"count(*) > 1 AND coalesce(max(strlen({c})), 0) > 200 AS is_long FROM conversations"
             for c in ["role", "text"]]
    return " UNION ALL ".join(parts)


@register("long_text_columns", _long_cols_sql)
def q_long_text_columns(spark, sf_dir):
    return long_text_columns(table(spark, sf_dir, "conversations"))


@register("estimate_tokens", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, "
          "CAST(ceil(strlen(text) / 3.5) AS BIGINT) AS est_tokens FROM documents")
def q_estimate_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return with_token_estimate(docs.select("doc_id", "text"), "text").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "est_tokens")


@register("token_budget", "SELECT conv_id, count(*) AS n_rows, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, "
          "CAST(ceil(sum(strlen(text)) / 3.5) AS BIGINT) AS est_tokens, "
          "ceil(sum(strlen(text)) / 3.5) < 2000 AS accepted FROM conversations GROUP BY conv_id")
def q_token_budget(spark, sf_dir):
    return split_by_budget(table(spark, sf_dir, "conversations"), "conv_id", "text", 2000)


_BATCH_SQL = """
WITH s AS (SELECT conv_id, sum(coalesce(strlen(text), 0)) AS total, count(*) AS n FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT r.conv_id, r.turn, r.role,
       CAST(CASE WHEN s.total > 1800 THEN floor((r.rn - 1) / greatest(1, floor(1500 / greatest(ceil(s.total / s.n), 1))))
            ELSE 0 END AS BIGINT) AS batch_no
FROM r JOIN s USING (conv_id)
"""


@register("batch_rows", _BATCH_SQL)
def q_batch_rows(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return assign_batches(conv, "text", ["turn"], ["conv_id"]).select("conv_id", "turn", "role", "batch_no")


@register("page", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
          "ORDER BY l_orderkey, l_linenumber LIMIT 10 OFFSET 20")
def q_page(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return page(li, ["l_orderkey", "l_linenumber"], 10, 20)


def _mask_redact_sql() -> str:
    masked = _mask_sql("conversations", _CONV, ["role", "text"])
    ctes, last = duck_redact_ctes("m", ["role", "text"])
    return f"WITH m AS ({masked}), {ctes} SELECT conv_id, turn, role, text FROM {last}"


@register("mask_then_redact", _mask_redact_sql)
def q_mask_then_redact(spark, sf_dir):
    return redact_columns(mask_long_text(table(spark, sf_dir, "conversations")))
