import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableguard.llm import ppm, queries
from tests.llm.helpers import documents, empty_documents, prose, write_tables


def texts():
    rng = random.Random(6)
    return [None, "", " \n", "One one ONE two", "É é \U0001f600", "\x00\x01", prose(rng, 8000), *[prose(rng, rng.randint(1, 60)) for _ in range(40)], "same text", "same text"]


def deep_trie(sources, depth):
    trie = ppm.AdaptiveTrie(depth)
    for text in sources:
        context = (ppm.END,) * depth
        for s in [*(text or "").encode(), ppm.END]:
            trie.learn(context, s)
            context = (*context, s)[-depth:] if depth else ()
    return trie


def deep_read(trie, text):
    total, context = 0.0, (ppm.END,) * trie.depth
    for s in [*(text or "").encode(), ppm.END]:
        total += trie.cost(context, s)
        context = (*context, s)[-trie.depth:] if trie.depth else ()
    return total


def run_table(sources, depth):
    """(runs of these texts, their probabilities) when they are the training texts."""
    codes, counts = np.unique(np.concatenate([c for t in sources for c in ppm._runs(t, depth)] or [np.zeros(0, np.int64)]), return_counts=True)
    pairs = np.bincount(np.concatenate([c for t in sources for c in ppm._runs(t, 1)] or [np.zeros(0, np.int64)]), minlength=ppm.SYMBOLS ** 2).astype(float)
    return codes, counts, pairs


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("sources", [["abracadabra", "", "banana"], texts()[:12], ["".join(map(chr, range(128))) * 2]])
def test_probabilities_sum_to_one_in_every_context(sources, depth):
    """Every symbol after some contexts of the training texts and some unseen ones."""
    codes, counts, pairs = run_table(sources, depth)
    contexts = np.unique(np.concatenate([codes // ppm.SYMBOLS, (codes // ppm.SYMBOLS) // 3]))[::max(1, len(codes) // 50)]
    every = np.unique((contexts[:, None] * ppm.SYMBOLS + np.arange(ppm.SYMBOLS)[None, :]).ravel())
    all_codes = np.union1d(codes, every)
    n = np.zeros(len(all_codes), np.int64)
    n[np.searchsorted(all_codes, codes)] = counts
    lp = ppm.run_probabilities(all_codes, n, depth, pairs)[np.searchsorted(all_codes, every)]
    assert np.allclose((10.0 ** lp).reshape(-1, ppm.SYMBOLS).sum(axis=1), 1, atol=1e-9)


def test_all_symbols_seen_leaves_no_escape():
    pairs = np.zeros((ppm.SYMBOLS, ppm.SYMBOLS))
    pairs[:, 5] = 1
    pairs[5, :] = 1
    none, one = ppm.short_levels(pairs.ravel())
    lp = ppm._log_probabilities(*one).reshape(ppm.SYMBOLS, ppm.SYMBOLS)
    assert np.allclose((10.0 ** lp).sum(axis=1), 1, atol=1e-9)


@pytest.mark.parametrize("depth", [2, 5])
def test_parts_hold_whole_contexts(depth):
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, ppm.SYMBOLS ** (depth + 1), 5000))
    part = ppm.part_of(codes, depth, 7)
    by = {}
    for c, p in zip((codes // ppm.SYMBOLS) % ppm.SYMBOLS ** 2, part):
        assert by.setdefault(int(c), int(p)) == p
    assert set(part.tolist()) == set(range(7))


def test_adaptive_trie_likes_repeats(spark):
    rng = random.Random(1)
    docs = documents(spark, [None, "", "ab" * 200, "".join(rng.choice("abcdefghijklmnop") for _ in range(400))])
    got = {r.doc_id: r for r in ppm.adaptive_bits(docs).collect()}
    assert got[1].bits == got[2].bits == pytest.approx(math.log2(257))
    assert got[3].bits < 0.2 * got[4].bits and got[3].n_bytes == 400


def by_hand(rows, training):
    learned = [t for (i, t), use in zip(rows, training) if use]
    counts = Counter(w for t in learned for w in ppm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    trie = deep_trie(learned, ppm.DEPTH)
    out = []
    for i, t in rows:
        words = ppm.tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((i, len(words), sum(counts[w] > 0 for w in words), n, base, deep_read(trie, t)))
    return out


@pytest.mark.parametrize("hot_words", [0, 5, 50, 10**6])
def test_scores_match_by_hand_however_many_words_are_broadcast(spark, hot_words):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(t for t in texts() if t is None or len(t) < 5000)]
    training = [i % 3 != 0 for i, _ in enumerate(rows)]
    df = documents(spark, rows).withColumns({"n_chars": F.lit(0).cast("long")})
    flags = spark.createDataFrame([(i, t, u) for (i, t), u in zip(rows, training)], "doc_id bigint, text string, learn boolean").selectExpr(
        "*", "1 AS id", "2 AS key", "3 AS word", "4 AS base", "5 AS score")
    assert df.count() == len(rows)
    got = ppm.score_documents(flags, F.col("learn"), hot_words=hot_words).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[4], 4))
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(mine, sorted(by_hand(rows, training), key=key), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-9), (a, b)


def test_query_on_a_fixture(spark, tmp_path):
    rows = [(i + 1, t) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in queries.QUERIES["op8_ppm_score"](spark, write_tables({"documents": documents(spark, rows)}, tmp_path)).collect()}
    training = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    for (i, *want), use in zip(by_hand(rows, training), training):
        r = got[i]
        assert r.held_out != use and [r.n_tokens, r.n_known, r.train_tokens] == want[:3]
        assert math.isclose(r.base_score, want[3], rel_tol=1e-9) and math.isclose(r.score, want[4], rel_tol=1e-9)


def test_no_training_text_and_no_rows(spark):
    r = ppm.score_documents(documents(spark, ["ab"]), F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and r.score == pytest.approx(3 * -math.log10(257), rel=1e-5)
    assert ppm.score_documents(empty_documents(spark), F.lit(True)).count() == 0


@pytest.mark.parametrize("depth", [0, 1, 5, 6])
def test_scores_equal_the_trie_in_any_blocks(spark, depth):
    sources = [t for t in texts() if t is None or len(t) < 5000] + ["".join(map(chr, range(128))) * 2, "never learned \u4e2d"]
    rows = [(i if i % 9 else None, t, i % 3 != 0) for i, t in enumerate(sources)]
    trie = deep_trie([t for _, t, learn in rows if learn], depth)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, learn boolean")
    dealt = ppm.deal(df.select("text", F.col("learn").alias("training")).coalesce(2), 500)
    assert dealt.select("block").distinct().count() > 4
    pairs = run_table([t for _, t, learn in rows if learn], 1)[2]
    got = sorted((r.text or "", r.score) for r in dealt.join(ppm.model_scores(dealt, pairs, depth), "key").collect())
    want = sorted((t or "", deep_read(trie, t)) for _, t, _ in rows)
    assert len(got) == len(want)
    for (a, x), (b, y) in zip(got, want):
        assert a == b and math.isclose(x, y, rel_tol=1e-9), (a, x, y)


def test_runs_of_long_texts_come_in_pieces(monkeypatch):
    text = "abcdefghij" * 3
    whole = np.concatenate(list(ppm._runs(text, 5)))
    for size in (1, 3, 7, 30, 31):
        monkeypatch.setattr(ppm, "_SLICE", size)
        assert np.array_equal(np.concatenate(list(ppm._runs(text, 5))), whole) and len(whole) == 31
