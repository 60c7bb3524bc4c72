import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableguard.llm import jump_shards, queries
from tests.llm.helpers import documents, empty_documents, write_tables


def jump_by_hand(key, n):
    """The published recurrence, one key at a time."""
    shard, nxt, state = -1, 0, key % (1 << 64)
    while nxt < n:
        shard = nxt
        state = (state * 2862933555777941757 + 1) % (1 << 64)
        nxt = int((shard + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return shard


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000])
def test_equals_the_published_recurrence(n):
    keys = [0, 1, -1, 2**63 - 1, -2**63, 10**18, *range(-200, 200), *(k * 7919 ** 3 for k in range(500))]
    assert jump_shards.jump_hash(np.array(keys, np.int64), n).tolist() == [jump_by_hand(k, n) for k in keys]


def test_growing_moves_rows_into_the_new_shard_alone():
    keys = np.arange(50_000, dtype=np.int64) * 104729
    for n in (1, 5, 24):
        before, after = jump_shards.jump_hash(keys, n), jump_shards.jump_hash(keys, n + 1)
        moved = before != after
        assert set(after[moved].tolist()) == {n} and abs(moved.mean() - 1 / (n + 1)) < 0.01
        sizes = np.bincount(before, minlength=n)
        assert sizes.max() < 1.15 * sizes.min()
    with pytest.raises(ValueError):
        jump_shards.jump_hash(keys, 0)


def check(rows, texts):
    by_id, slots = {}, defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode() if r.doc_id in texts else None
        if data is not None:
            assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert r.law == "key" and 0 <= r.shard < 24 and (r.grown_shard == r.shard or r.grown_shard == 24)
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_on_nulls_long_texts_repeats_and_clashing_columns(spark, tmp_path):
    texts = {i: t for i, t in enumerate([None, "", "é漢\U0001F600", "x" * 200_000, "same", "same", *(f"text {k}" for k in range(300))])}
    docs = documents(spark, list(texts.items()) + [(3, texts[3])] * 3 + [(None, "lost"), (None, None)])
    for name in ("_chunk", "_row", "shard", "slot", "size", "law", "_s", "_c", "_shift"):
        docs = docs.withColumn(name, F.lit(1))
    rows = queries.op5_jump_shards(spark, write_tables({"documents": docs}, tmp_path)).collect()
    assert len(rows) == len(texts) + 5
    check(rows, texts)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_a_hot_shard_is_numbered_without_gaps(spark):
    rows = spark.range(5000).select(F.lit(3).alias("shard"), (F.col("id") % 10).alias("k"), F.lit("same").alias("t")).repartition(7)
    got = jump_shards.with_slots(rows, "shard", ["k", "t"], chunks=5)
    assert sorted(r.slot for r in got.collect()) == list(range(5000)) and got.columns == ["shard", "k", "t", "slot"]


def test_slots_keep_columns_of_any_name(spark):
    names = ["_chunk", "_row", "_s", "_c", "_shift", "row", "s", "k0", "chunk", "at", "of", "n", "shift", "place", "shard", "a.b"]
    rows = spark.range(60).select("id", *[(F.col("id") % (i + 2)).alias(n) for i, n in enumerate(names)], F.lit("old").alias("slot"))
    got = jump_shards.with_slots(rows, "shard", ["id"], chunks=4)
    assert got.columns == ["id", *names, "slot"]
    slots = defaultdict(list)
    for r in got.collect():
        assert tuple(r[:-1]) == (r.id, *(r.id % (i + 2) for i in range(len(names))))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_on_disk_and_moved_rows(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    jump_shards.write_shards(rows, str(tmp_path / "s"), "key", 5, max_rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 1000 and {r.shard for r in back.select("shard").distinct().collect()} == set(range(5))
    grown = jump_shards.assign_shards(rows, "key", 5, 6)
    moved = {r.shard: r.rows_in for r in jump_shards.moved_rows(grown).collect()}
    assert set(moved) == {5} and moved[5] == grown.where("shard <> grown_shard").count()


def test_empty_table(spark):
    out = jump_shards.document_shards(empty_documents(spark))
    assert out.count() == 0 and out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
