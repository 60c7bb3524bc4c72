import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableguard.llm import queries, whitening
from tests.llm.helpers import write_tables

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    ids = list(range(len(vectors))) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in zip(ids, vectors)], SCHEMA)


def by_hand(vectors):
    """(x, S, covariance) with Python integers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[n * r[j] - s[j] for j in range(d)] for r in x], object)
    cov = np.array([[float(sum(a * b for a, b in zip(centred[:, i], centred[:, j])) / n ** 3) for j in range(d)] for i in range(d)])
    return x, s, centred, cov


def random_vectors(rng, n, d, spread=None):
    spread = spread or [0.3 / (1 + j) for j in range(d)]
    return [np.float32([rng.gauss(0.1, spread[j]) for j in range(d)]).tolist() for _ in range(n)]


def test_equals_brute_force(spark):
    vectors = random_vectors(random.Random(1), 300, 6)
    x, s, centred, cov = by_hand(vectors)
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    rows = whitening.whiten(table(spark, vectors).repartition(5), components=4).collect()
    assert len(rows) == 300 * 4 and {r.n for r in rows} == {300}
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9
    w = np.array([[0.0] * 4] * 300)
    for r in rows:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == sum(int(v) ** 2 for v in centred[r.vec_id])
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    expected = (centred / 300).astype(float) @ vecs[:, :4] / np.sqrt(values[:4])
    for k in range(4):
        sign = np.sign(w[:, k] @ expected[:, k])
        assert np.allclose(w[:, k], sign * expected[:, k], atol=1e-9, rtol=1e-9)
    assert np.abs(w.T @ w / 300 - np.eye(4)).max() < 1e-9


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    good = random_vectors(rng, 50, 3)
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [1e30, 0.0, 0.0], [1.0, 2.0, 3.0, 4.0]]
    ids = [*range(50), *range(100, 100 + len(odd)), None, 7]
    docs = table(spark, good + odd + [good[0], good[7]], ids).withColumn("_id", F.lit("x")).withColumn("component", F.lit(9))
    rows = queries.op13_whitening(spark, write_tables({"embeddings": docs}, tmp_path)).collect()
    assert rows[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert len(rows) == 52 * 3 and {r.n for r in rows} == {52}
    assert sorted({-1 if r.vec_id is None else r.vec_id for r in rows}) == [-1, *range(50)]
    first = {r.component: r.whitened for r in rows if r.vec_id == 0}
    assert {r.component: r.whitened for r in rows if r.vec_id is None} == first
    assert sum(r.explained for r in rows if r.vec_id == 3) == pytest.approx(1)


def test_no_variance(spark):
    rows = whitening.whiten(table(spark, [[0.5, 1.0]] * 4)).collect()
    assert len(rows) == 8 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in rows)
    flat = whitening.whiten(table(spark, [[k / 4, 2.0, k / 2] for k in range(9)])).collect()  # one direction only
    assert {r.component for r in flat if r.whitened is None} == {2, 3}
    assert {r.explained for r in flat if r.component == 1} == {1.0} and max(r.identity_error for r in flat) < 1e-9


def test_empty_tables_and_too_many_dimensions(spark):
    for vectors in ([], [None, [], [None]]):
        out = whitening.whiten(table(spark, vectors))
        assert out.count() == 0 and out.columns[:2] == ["vec_id", "component"]
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [[0.0] * (whitening.MAX_DIMENSIONS + 1)] * 2))


def test_large_entries_stay_exact(spark):
    rng = random.Random(4)
    vectors = [[rng.uniform(-1e9, 1e9), rng.uniform(-1, 1)] for _ in range(40)]
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id string, embedding array<double>")
    model = whitening.fit(docs)
    _, s, centred, cov = by_hand(vectors)
    exact = [[sum(int(a) * int(b) for a, b in zip(centred[:, i], centred[:, j])) / 40 ** 3 for j in range(2)] for i in range(2)]
    back = (model.vectors * model.values) @ model.vectors.T
    assert np.allclose(back.astype(float), np.array(exact), rtol=1e-15, atol=float(model.values[0]) * 1e-17)
    got = {r.vec_id: r.deviation for r in whitening.whiten(docs).collect()}
    assert got == {str(k): v if (v := sum(int(c) ** 2 for c in centred[k])) < 1 << 63 else None for k in range(40)}


def orthogonal(rng, d):
    return np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)


@pytest.mark.parametrize("values", [
    [9, 5, 2, 1], [1 + 1e-9, 1, 1 - 1e-9, 0.5], [3, 1, 1 - 1e-13, 1 - 2e-13, 1e-8, 1e-9], [2] * 5, [1, 0, 0, 0], [5, 5, 1, 1, 1, 1 + 1e-6, 0, 0]])
def test_clustered_eigenvalues(values):
    """Residual and orthogonality far below float64's rounding, however close the eigenvalues."""
    rng = np.random.default_rng(len(values))
    q = orthogonal(rng, len(values))
    q = q @ (np.longdouble(1.5) * np.eye(len(values)) - np.longdouble(0.5) * (q.T @ q))  # orthogonal in extended precision
    a = (q * np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    assert np.all(np.diff(found.astype(float)) <= 1e-15) and np.allclose(found.astype(float), sorted(values, reverse=True), rtol=0, atol=1e-16 * max(values) * 10)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(a @ x - x * found).max() < 1e-17 * max(values)


def test_float32_alone_would_not_do():
    rng = np.random.default_rng(5)
    q = orthogonal(rng, 20)
    a = (q * np.linspace(1, 2, 20)) @ q.T
    a = (a + a.T) / 2
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    fine, _, _ = whitening.refine(a, rough)
    assert np.abs(rough.T @ rough - np.eye(20)).max() > 1e-9 > 1e-16 > np.abs(fine.T @ fine - np.eye(20)).max()
