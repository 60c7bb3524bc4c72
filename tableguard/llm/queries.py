"""The registered digest queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableguard.llm import bottom_k, bpe, jump_shards, language, perspectives, phrase_index, ppm, prefix_trie, secrets, simhash, token_store, warc, whitening
from tableguard.llm.common import crc_mod, shared_path

QueryFn = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered from every participant's perspective."""
    rows = perspectives.render(_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"])
    return rows.select("conv_id", "perspective", "part", "start", "n_messages", "text", mask.alias("mask"), masked.alias("n_masked"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate group of every document."""
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return groups.select("doc_id", "fingerprint", "component_id")


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketch of every document and of its edited text."""
    rows = bottom_k.compare_with_next(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", bottom_k.as_text(F.col("sketch")).alias("fingerprint"),
                       bottom_k.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
                       "kept_in_edited", "kept_in_next", "shingles")


def op4_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    rows = bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in shards 0 to 23 by jump hash of its id."""
    return jump_shards.document_shards(_table(spark, sf_dir, "documents"))


def op6_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = language.identify(docs, language.train(docs.filter(~held_out).select("doc_id", "lang", "text")))
    found = found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score", "evidence", "ambiguous")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "evidence", "ambiguous")


def op7_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words found in every document."""
    found = phrase_index.decontaminate(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by a pretrained PPM model (contexts of ``ppm.DEPTH`` bytes), and a unigram base."""
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    rows = ppm.score_documents(_table(spark, sf_dir, "documents"), ~held_out, depth=ppm.DEPTH)
    return rows.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; values that few owners hold are live."""
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = shared_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path, min_bytes=1000)
    records = warc.read_archives(spark, path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie over the rebuilt conversations."""
    own = prefix_trie.numbered_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(own, every=20, most=3))


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids written to a token store and read back."""
    path = shared_path(spark, "tokens")
    token_store.write_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.with_checksums(token_store.read_tokens(spark, path)).withColumnRenamed("id", "doc_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened on the 32 first components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, QueryFn] = {
    "op1_perspective_chat": op1_perspective_chat,
    "op2_simhash_pivots": op2_simhash_pivots,
    "op3_bottom_k": op3_bottom_k,
    "op4_speculative_bpe": op4_speculative_bpe,
    "op5_jump_shards": op5_jump_shards,
    "op6_ecoc_language": op6_ecoc_language,
    "op7_phrase_index": op7_phrase_index,
    "op8_ppm_score": op8_ppm_score,
    "op9_secret_owners": op9_secret_owners,
    "op10_warc_zstd": op10_warc_zstd,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_store": op12_token_store,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_perspective_chat": """
        WITH m AS (
          SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
        ), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'
        ), e AS (
          SELECT m.*, p.perspective, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = p.perspective THEN 'assistant'
                 ELSE 'user name=' || regexp_replace(speaker, '[\\x00-\\x20<|>]', '_', 'g') END || chr(10) AS header
          FROM m JOIN people p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
        ), s AS (
          SELECT *, header || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS segment,
                 CASE WHEN speaker = perspective THEN length('user name=' || regexp_replace(speaker, '[\\\\x00-\\\\x20<|>]', '_', 'g')) - length('assistant')
                      ELSE 0 END AS longer
          FROM e
        ), r AS (
          SELECT *, sum(length(segment)) OVER w AS stop, sum(length(segment) + longer) OVER w - length(segment) - longer AS place,
                 row_number() OVER w AS message FROM s
          WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, sha256(text) ROWS UNBOUNDED PRECEDING)
        ), b AS (SELECT *, stop - length(segment) AS begins FROM r
        ), q AS (SELECT *, CAST(place // 65536 AS BIGINT) AS part FROM b
        ), f AS (SELECT *, min(begins) OVER (PARTITION BY conv_id, perspective, part) AS base FROM q)
        SELECT conv_id, perspective, part, CAST(min(begins) AS BIGINT) AS start, count(*) AS n_messages,
               string_agg(segment, '' ORDER BY message) AS text,
               coalesce(string_agg(CAST(begins + length(header) - base AS VARCHAR) || ':' || CAST(stop - 1 - base AS VARCHAR), ',' ORDER BY message)
                        FILTER (WHERE speaker = perspective), '') AS mask,
               CAST(coalesce(sum(length(segment) - length(header) - 1) FILTER (WHERE speaker = perspective), 0) AS BIGINT) AS n_masked
        FROM f GROUP BY conv_id, perspective, part""",
    "op10_warc_zstd": """
        WITH p AS (
          SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
        FROM r""",
    # crc32 of the id's decimal text is worked out bit by bit: DuckDB has no such function
    "op11_prefix_trie": r"""
        WITH t AS (
          SELECT conv_id AS c, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                    md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS idx
          FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
          SELECT c, c - c % 20 AS base, count(*) AS n,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                           lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::BIGINT) % 4 AS h
          FROM t GROUP BY c
        ), turns AS (
          SELECT v.c, row_number() OVER (PARTITION BY v.c ORDER BY v.own, v.idx) AS d, v.digest, v.words FROM (
            SELECT k.c, 0 AS own, b.idx, b.digest, b.words FROM convs k JOIN t b ON b.c = k.base AND b.idx <= k.h
            UNION ALL SELECT k.c, 1, t.idx, t.digest, t.words FROM convs k JOIN t ON t.c = k.c AND t.idx > k.h) v
        ), paths AS (
          SELECT c, 0 AS d, '' AS path, 0 AS words FROM convs
          UNION ALL SELECT c, d, md5(string_agg(digest, ',') OVER (PARTITION BY c ORDER BY d)), words FROM turns
        ), sizes AS (SELECT c, max(d) AS size FROM paths GROUP BY c
        ), nodes AS (
          SELECT p.d, p.path, min(p.c) AS conv_id, count(*) AS n_convs, min(p.words) AS words,
                 coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE s.size = p.d), '') AS ends
          FROM paths p JOIN sizes s USING (c) GROUP BY p.d, p.path
        ), up AS (
          SELECT n.*, a.path AS above FROM nodes n LEFT JOIN paths a ON a.c = n.conv_id AND a.d = n.d - 1
        ), kids AS (SELECT d - 1 AS d, above AS path, count(*) AS n_children FROM up WHERE d > 0 GROUP BY 1, 2
        ), below AS (
          SELECT a.d, a.path, CAST(sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
                 CAST(sum((u.n_convs - 1) * u.words) AS BIGINT) AS saved_tokens
          FROM up u JOIN paths a ON a.c = u.conv_id AND a.d <= u.d LEFT JOIN kids k ON k.d = u.d AND k.path = u.path
          GROUP BY a.d, a.path
        )
        SELECT u.conv_id, u.d AS depth, m.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children,
               b.n_leaves, b.saved_tokens, sha256(u.ends) AS ends_sha256
        FROM up u JOIN below b ON b.d = u.d AND b.path = u.path LEFT JOIN kids k ON k.d = u.d AND k.path = u.path
        LEFT JOIN nodes m ON m.d = u.d - 1 AND m.path = u.above""",
}
