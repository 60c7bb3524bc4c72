"""Corpus pipeline: five stages over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept;
its result is written as Parquet and read back as the next stage's documents.

1. language id          documents whose text has no letter, or whose n-grams are not those
                        of any learned language (other scripts, random letters), go; the
                        classifiers are learned from this stage's own documents with a
                        language.  If none has one, only texts without a letter go.
2. simhash near-dedup   one document of each near-duplicate group stays (smallest id).
3. benchmark decontamination  documents that hold a ten-word window of an item go.
4. secret scans         live values are replaced by ``[SECRET]``; every document stays.
5. bpe encoding         token ids of every document, with digests.

The first four stages return the columns of ``documents``.  Rows with null ids, null
texts and repeated rows are treated as the operators say; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableguard.llm import bpe, language, phrase_index, secrets, simhash
from tableguard.llm.common import crc_mod, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = docs.filter(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", "lang", "text")
    found = language.identify(docs, language.train(labelled))
    return found.filter(~language.rejected(F.col("evidence"))).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=4, max_bits=4)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return phrase_index.keep_clean(spark, docs, items, size=10)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language id", identify_language),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", hide_secrets),
    ("bpe encoding", encode),
]

# hashing, classifiers and BPE are beyond SQL; tests/llm/test_pipeline.py has the stages by hand
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
