"""Embedding whitening by mixed-precision refinement of float32 eigenvectors.

Entries become whole numbers x = floor(64 c) + 1000000, so counts, sums and products are
exact whatever the order of the partial sums:

1. moments: n, sums and ranges by dimension, a partial row set for each task;
2. products: x is centred on the whole number nearest to its mean before multiplying.
   Blocks of ``BLOCK`` rows multiply in float64 without rounding (entries beyond
   ``DIGIT`` bits are split into digits first); the sums are decimals.  The rest of the
   centring, less than half a unit, is exact on the driver.

The covariance (d x d, d at most ``MAX_DIMENSIONS``) is decomposed on the driver: float32
eigenvectors, corrected by Ogita and Aishima's iteration (matrix products only) in
extended precision.  Pairs of eigenvalues too close for the correction form clusters;
each cluster is solved again as a small problem of its own, shifted by its mean and
scaled, by the same method, and the iteration goes on with its result.

3. the whitened rows' own covariance gives ``identity_error``;
4. rows are projected where they lie.  Nothing is shuffled but the partial sums.

Defined results
* Dropped: null vectors; vectors with a null, NaN or infinite entry, or one of 2^46 or
  more (x would not be exact); vectors without entries; vectors of another length than
  the commonest (of equally common lengths, the longer).
* Null ids are kept; repeated rows come back as often as given.
* A component without variance (eigenvalue at most ``NO_VARIANCE`` of the largest times
  the dimensions) has a null ``whitened`` and no part in ``identity_error``; if no
  component has variance, ``identity_error`` and ``explained`` are null.
* Fewer dimensions than components asked for: as many components as dimensions.
* ``deviation`` beyond the range of a long is null.  No usable vector: no rows.
* More than ``MAX_DIMENSIONS`` dimensions raise an error.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
MAX_DIMENSIONS = 1024
LIMIT = 2.0 ** 46
DIGIT = 20          # bits: products of two digits, summed over a block, stay below 2^53
BLOCK = 8192
FLUSH = 512         # blocks whose products an int64 holds
OUT_ROWS = 4096
STEPS = 12
SAFE = 64           # a correction stays below 1 / SAFE, or its pair counts as close
NO_VARIANCE = 2.0 ** -56
_WIDE = np.longdouble


# --------------------------------------------------------------------- vectors

def _lengths(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each usable vector or -1, all values, where each vector begins)."""
    values = pc.fill_null(column.values, float("nan")).to_numpy(zero_copy_only=False)
    cuts = column.offsets.to_numpy().astype(np.int64)
    bad = np.concatenate(([0], np.cumsum(~(np.abs(values) < LIMIT))))
    length = np.diff(cuts)
    length[(bad[cuts[1:]] > bad[cuts[:-1]]) | column.is_null().to_numpy(zero_copy_only=False) | (length == 0)] = -1
    return length, values, cuts[:-1]


def _integers(values: np.ndarray, begin: np.ndarray, dim: int) -> np.ndarray:
    """x of the vectors of ``dim`` entries that begin at ``begin``, a row each."""
    c = values[begin[:, None] + np.arange(dim)[None, :]]
    return np.floor(c * SCALE).astype(np.int64) + SHIFT


def _whole(numbers) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in numbers], pa.decimal128(38, 0))


def moments(vectors: DataFrame) -> DataFrame:
    """(dim, j, n, s, low, high): count, sum and range of x for each length and entry; j = -1 has the count alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            length, values, begin = _lengths(batch.column(0))
            for dim in np.unique(length[length > 0]).tolist():
                mine = begin[length == dim]
                n, s, low, high = seen.setdefault(dim, [0, 0, None, None])
                seen[dim][0] = n + len(mine)
                if dim > MAX_DIMENSIONS:
                    continue
                x = _integers(values, mine, dim)
                # in two halves, so that no sum overflows
                total = (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
                least, most = x.min(axis=0), x.max(axis=0)
                seen[dim][1:] = [total + s, least if low is None else np.minimum(low, least), most if high is None else np.maximum(high, most)]
        for dim, (n, s, low, high) in seen.items():
            k = 0 if low is None else dim
            yield pa.RecordBatch.from_arrays([
                pa.array([dim] * (k + 1), pa.int32()), pa.array([-1, *range(k)], pa.int32()), pa.array([n] * (k + 1), pa.int64()),
                _whole([0, *(s if k else [])]), pa.array([0, *(low.tolist() if k else [])], pa.int64()),
                pa.array([0, *(high.tolist() if k else [])], pa.int64())], ["dim", "j", "n", "s", "low", "high"])

    found = vectors.select("_v").mapInArrow(run, "dim int, j int, n bigint, s decimal(38,0), low bigint, high bigint")
    return found.groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))


def products(vectors: DataFrame, centre: np.ndarray, bound: int) -> DataFrame:
    """(p, q, i, j, v): exact sums of products of the centred entries' digits p <= q.

    ``bound``: largest absolute centred entry.
    """
    dim, digits = len(centre), max(1, -(-bound.bit_length() // DIGIT))
    pairs = [(p, q) for p in range(digits) for q in range(p, digits)]

    def split(d: np.ndarray) -> list[np.ndarray]:
        out = [(d >> (DIGIT * p)) & ((1 << DIGIT) - 1) for p in range(digits - 1)]
        return [x.astype(np.float64) for x in (*out, d >> (DIGIT * (digits - 1)))]

    def rows(sums: dict) -> Iterator[pa.RecordBatch]:
        for (p, q), m in sums.items():
            i, j = np.triu_indices(dim) if p == q else (x.ravel() for x in np.indices((dim, dim)))
            fixed = [pa.array(np.full(len(i), k, np.int32)) for k in (p, q)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], ["p", "q", "i", "j", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, blocks = {pair: np.zeros((dim, dim), np.int64) for pair in pairs}, 0
        for batch in batches:
            length, values, begin = _lengths(batch.column(0))
            mine = begin[length == dim]
            for at in range(0, len(mine), BLOCK):
                parts = split(_integers(values, mine[at:at + BLOCK], dim) - centre)
                for p, q in pairs:
                    sums[p, q] += (parts[p].T @ parts[q]).astype(np.int64)
                blocks += 1
                if blocks % FLUSH == 0:
                    yield from rows(sums)
                    sums = {pair: np.zeros((dim, dim), np.int64) for pair in pairs}
        if blocks % FLUSH:
            yield from rows(sums)

    found = vectors.select("_v").mapInArrow(run, "p int, q int, i int, j int, v bigint")
    return found.groupBy("p", "q", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))


# ------------------------------------------------------------------ eigenvectors

def refine(a: np.ndarray, x: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Ogita and Aishima's correction of approximate eigenvectors ``x`` of ``a``: (x, eigenvalues, least gap it can tell).

    Each step measures how far x is from orthogonal (r) and from diagonalising a (s) and
    corrects both at once; pairs closer than the gap are only made orthogonal.
    """
    size, gap, noise = np.sqrt((a * a).sum()), 0.0, 8 * len(a) * np.finfo(_WIDE).eps
    values = np.diag(a)
    for _ in range(steps):
        r = np.eye(len(a), dtype=_WIDE) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # else rounding, over a small gap, would bend right angles
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        gap = SAFE * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > gap
        e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
        x = x + x @ e
        if np.abs(e).max() <= noise * (1 + size / np.abs(apart[far]).min(initial=size)):
            break  # rounding is all that is left
    for _ in range(2):  # a correction's square bends right angles; the next step would mend them
        x = x + x @ (np.eye(len(a), dtype=_WIDE) - x.T @ x) / 2
    return x, values, float(gap)


def eigen(a: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors) of a symmetric matrix in extended precision, eigenvalues falling.

    A matrix whose entries are all within ``floor`` counts as a multiple of the unit
    matrix: any basis will do.
    """
    a = np.asarray(a, dtype=_WIDE)
    scale = np.abs(a).max() if len(a) else 0
    if len(a) < 2 or scale <= floor:
        return np.diag(a).copy(), np.eye(len(a), dtype=_WIDE)
    unit = a / scale
    x = np.linalg.eigh(unit.astype(np.float32))[1].astype(_WIDE)
    tiny = 16 * len(a) * np.finfo(_WIDE).eps
    for _ in range(STEPS):
        x, values, gap = refine(unit, x)
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        starts = np.flatnonzero(np.concatenate(([True], values[:-1] - values[1:] > gap)))
        runs = [np.arange(i, j) for i, j in zip(starts, [*starts[1:], len(a)]) if j - i > 1]
        solved = False
        for run in runs:
            some = x[:, run]
            small = some.T @ (unit @ some) - values[run].mean() * (some.T @ some)
            small = (small + small.T) / 2
            if np.abs(small - np.diag(np.diag(small))).max() > tiny:
                x[:, run] = some @ eigen(small, tiny)[1]
                solved = True
        if not solved:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    return values * scale, x


# ---------------------------------------------------------------------- model

@dataclass
class Whitening:
    """n vectors of ``dim`` entries; sums of x - ``centre``; eigenvalues and eigenvectors of x's covariance."""

    n: int
    dim: int
    centre: np.ndarray
    rest: list[int]
    bound: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def has_variance(self, k: int) -> np.ndarray:
        return self.values[:k] > self.values[0] * NO_VARIANCE * self.dim if self.dim else np.zeros(0, bool)

    def projection(self, k: int) -> np.ndarray:
        """Columns that whiten x - S/n; NaN for a component without variance."""
        root = np.sqrt(np.where(self.has_variance(k), self.values[:k], np.nan))
        return (self.vectors[:, :k] / root).astype(np.float64)


def _ratio(over: int, under: int):
    """over / under, rounded to extended precision."""
    near = over / under
    a, b = near.as_integer_ratio()
    return _WIDE(near) + _WIDE((over * b - a * under) / (under * b))


def _vectors(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return frame.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))


def fit(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None without any."""
    rows = _vectors(frame, id_col, vector_col)
    found = moments(rows).collect()  # at most MAX_DIMENSIONS rows for each of as many lengths
    counts = {r.dim: r.n for r in found if r.j == -1}
    if not counts:
        return None
    dim = max(counts, key=lambda d: (counts[d], d))
    if dim > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {dim} entries; at most {MAX_DIMENSIONS} can be whitened")
    mine, n = {r.j: r for r in found if r.dim == dim and r.j >= 0}, counts[dim]
    sums = [int(mine[j].s) for j in range(dim)]
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    bound = max(max(mine[j].high - int(centre[j]), int(centre[j]) - mine[j].low) for j in range(dim))
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    total = np.zeros((dim, dim), object)
    for r in products(rows, centre, bound).collect():  # dim x dim for each pair of digits
        v = int(r.v) << (DIGIT * (r.p + r.q))
        total[r.i, r.j] += v
        if r.p != r.q or r.i != r.j:
            total[r.j, r.i] += v
    cov = np.empty((dim, dim), _WIDE)
    for i in range(dim):
        for j in range(i, dim):
            cov[i, j] = cov[j, i] = _ratio(n * total[i, j] - rest[i] * rest[j], n * n)
    values, vectors = eigen(cov)
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(dim)]
    return Whitening(n, dim, centre, rest, bound, values, vectors * np.where(lead < 0, -1, 1), float(np.trace(cov)))


def _whitened(model: Whitening, projection: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the model's vectors in the batch, x - centre, whitened rows)."""
    length, values, begin = _lengths(batch.column("_v"))
    place = np.flatnonzero(length == model.dim)
    d = _integers(values, begin[place], model.dim) - model.centre
    return place, d, (d - np.array([r / model.n for r in model.rest])) @ projection


def identity_error(frame: DataFrame, model: Whitening, components: int, id_col: str = "vec_id", vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    k = min(components, model.dim)
    use = np.flatnonzero(model.has_variance(k))
    if not len(use):
        return None
    projection = model.projection(k)[:, use]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = np.zeros((len(use), len(use))), np.zeros(len(use))
        for batch in batches:
            w = _whitened(model, projection, batch)[2]
            m, s = m + w.T @ w, s + w.sum(axis=0)
        i, j = np.triu_indices(len(use))
        i, j, v = np.concatenate((i, np.arange(len(use)))), np.concatenate((j, np.full(len(use), -1))), np.concatenate((m[i, j], s))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v)], ["i", "j", "v"])

    found = _vectors(frame, id_col, vector_col).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = {r.i: r.v / model.n for r in found if r.j < 0}
    # the rows are centred already: their means are rounding, and what they take off is far below it
    return max(abs(r.v / model.n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in found if r.j >= 0)


def whiten(frame: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = frame.schema[id_col].dataType.simpleString()
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    shape = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(frame, id_col, vector_col)
    if model is None:
        return frame.sparkSession.createDataFrame([], shape).withColumnRenamed("id", id_col)
    k = min(components, model.dim)
    error = identity_error(frame, model, components, id_col, vector_col)
    projection = model.projection(k)
    explained = [float(max(v, 0)) / model.trace if model.trace else None for v in model.values[:k].astype(np.float64)]
    fits = (model.n * (model.bound + 1)) ** 2 * model.dim < 1 << 63
    rest = np.array(model.rest, np.int64 if fits else object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                some = batch.slice(at, OUT_ROWS)
                place, d, w = _whitened(model, projection, some)
                spread = ((model.n * (d if fits else d.astype(object)) - rest) ** 2).sum(axis=1)
                spread = pa.array(spread if fits else [int(x) if x < 1 << 63 else None for x in spread], pa.int64())
                each = pa.array(np.repeat(np.arange(len(place)), k))
                count = len(place) * k
                flat = w.ravel()
                yield pa.RecordBatch.from_arrays([
                    some.column("_id").take(pa.array(place)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(place))),
                    pa.array(np.full(count, model.n, np.int64)), spread.take(each), pa.array(flat, mask=np.isnan(flat)),
                    pa.array(explained * len(place), pa.float64()), pa.array([error] * count, pa.float64())], names)

    return _vectors(frame, id_col, vector_col).mapInArrow(run, shape).withColumnRenamed("id", id_col)
