"""Fixtures and straight-line helpers of the llm tests."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, first_id=1, langs=None, sources=None):
    rows = [(first_id + i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1],
             (langs or ["en"])[i % len(langs or ["en"])], (sources or ["s0", "s1"])[i % len(sources or ["s0", "s1"])], 0)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def prose(rng: random.Random, n: int, stems="ta re mi no lu ka se di po fe gu".split()) -> str:
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def write_tables(df_by_name, folder):
    for name, df in df_by_name.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
