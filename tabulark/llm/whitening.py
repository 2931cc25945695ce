"""Embedding whitening: leading principal components by a block Jacobi-Davidson method, without a covariance matrix.

The distinct quantised vectors are written once. A product of their covariance with a few columns is one distributed
pass: every task centres its vectors, multiplies them into the columns and back, and gives one block of sums of
the columns' size. The driver holds only what is as long as a vector: a search space of some columns, its products,
the locked eigenvectors. Each round takes the Ritz pairs of the search space, locks those whose residual has reached
double precision, largest eigenvalue first, and extends the space by MINRES solutions of the correction
equations, projected against the locked vectors and the Ritz vector itself. The equations of all open pairs advance
together, so that one step of all of them is one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulark.scratch import cut

Product = Callable[[np.ndarray], np.ndarray]

EPS = float(np.finfo(np.float64).eps)
# Steps of MINRES in a round, and the share of the residual at which they end early.
INNER_STEPS, INNER_SHARE = 12, 1e-3
# Columns of the search space, for each wanted component, before it is restarted.
SPACE = 10
ROUNDS = 200
# Sums of the tasks are added up by so many tasks before the driver adds those.
ADDERS = 8
# Whole numbers up to here keep their value as doubles, and sums of their squares fit 64 bits when so bounded.
LONG = 2**63 - 1


def usable() -> Column:
    """Whether a row has a vector of finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col("embedding").isNotNull() & finite, F.lit(False))


def quantised(scale: float) -> Column:
    """The vector in whole numbers, floor(scale * c); what lies outside 64 bits becomes the nearest long."""
    low, high = float(-(2**63)), float(2**63 - 1024)
    return F.transform(
        "embedding", lambda c: F.floor(F.greatest(F.lit(low), F.least(F.lit(high), c.cast("double") * F.lit(scale)))).cast("bigint")
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sum_exactly(table: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and their sum per dimension, as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            top = max(int(x.max()), -int(x.min()))
            sums = sums + x.sum(axis=0, dtype=np.int64 if top * len(x) <= LONG else object).astype(object)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"n": pa.array([n] * dims, pa.int64()), "i": pa.array(range(dims), pa.int32()), "s": pa.array([Decimal(int(v)) for v in sums], pa.decimal128(38, 0))}
            )

    parts = table.mapInArrow(run, "n bigint, i int, s decimal(38,0)").repartition(ADDERS)
    # Added on the driver: one row per adding task and dimension.
    rows = parts.mapInArrow(_added_exactly, "n bigint, i int, s decimal(38,0)").collect()
    sums = [0] * dims
    for row in rows:
        sums[row["i"]] += int(row["s"])
    return sum(row["n"] for row in rows if row["i"] == 0), sums


def _added_exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, int] = {}
    sums: dict[int, int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            n[row["i"]] = n.get(row["i"], 0) + row["n"]
            sums[row["i"]] = sums.get(row["i"], 0) + int(row["s"])
    if n:
        keys = sorted(n)
        yield pa.RecordBatch.from_pydict(
            {"n": pa.array([n[k] for k in keys], pa.int64()), "i": pa.array(keys, pa.int32()), "s": pa.array([Decimal(sums[k]) for k in keys], pa.decimal128(38, 0))}
        )


def _summed(table: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all blocks of vectors of ``part``; compensated in the tasks, added up in two levels."""

    def total(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        have, high, low = False, np.zeros(shape), np.zeros(shape)
        for block in blocks:
            have, new = True, high + block
            low += np.where(np.abs(high) >= np.abs(block), (high - new) + block, (block - new) + high)
            high = new
        if have:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([(high + low).ravel().tolist()], pa.list_(pa.float64()))})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(part(_matrix(batch.column(0))) for batch in batches if batch.num_rows)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(row.reshape(shape) for batch in batches if batch.num_rows for row in _matrix(batch.column(0)))

    parts = table.mapInArrow(first, "sums array<double>").repartition(ADDERS)
    rows = parts.mapInArrow(second, "sums array<double>").collect()
    return sum((np.array(row["sums"]).reshape(shape) for row in rows), np.zeros(shape))


def covariance_product(table: DataFrame, mean: np.ndarray, n: int) -> Product:
    """V @ columns for the covariance V of the vectors, as one pass over them."""

    def product(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ columns)

        return _summed(table, part, columns.shape) / n

    return product


def minres(product: Product, shifts: np.ndarray, away: list[np.ndarray], rhs: np.ndarray, steps: int, share: float) -> np.ndarray:
    """Approximate solutions t of P (A - shift) P t = rhs, one per column, with P projecting off the columns of ``away``.

    All columns advance together, one product of A with all of them a step; a column whose residual has come down to
    ``share`` of its start, or whose Krylov space is exhausted, rests.
    """

    def off(columns: np.ndarray) -> np.ndarray:
        out = columns.copy()
        for k, q in enumerate(away):
            for _ in range(2):
                out[:, k] -= q @ (q.T @ out[:, k])
        return out

    v = off(rhs)
    beta = np.linalg.norm(v, axis=0)
    start = beta.copy()
    live = beta > 0
    v = v / np.where(live, beta, 1)
    before = np.zeros_like(v)
    d, d_before, x = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    c, c_before = np.ones(len(beta)), np.ones(len(beta))
    s, s_before = np.zeros(len(beta)), np.zeros(len(beta))
    left, link = start.copy(), np.zeros(len(beta))
    for _ in range(steps):
        if not live.any():
            break
        w = np.zeros_like(v)
        w[:, live] = product(v[:, live])
        w = off(w - shifts * v) - link * before
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v
        w = off(w)
        new = np.linalg.norm(w, axis=0)
        # The new column of the tridiagonal matrix under the two last rotations, then its own.
        third = s_before * link
        middle = c_before * link
        second = c * middle + s * alpha
        diagonal = c * alpha - s * middle
        length = np.hypot(diagonal, new)
        turn = live & (length > 0)
        size = np.where(turn, length, 1)
        c_before, s_before = np.where(turn, c, c_before), np.where(turn, s, s_before)
        c, s = np.where(turn, diagonal / size, c), np.where(turn, new / size, s)
        fresh = (v - second * d - third * d_before) / size
        d_before, d = np.where(turn, d, d_before), np.where(turn, fresh, d)
        x = np.where(turn, x + c * left * d, x)
        left = np.where(turn, -s * left, left)
        live = turn & (np.abs(left) > share * start) & (new > EPS * start)
        before, v = v, w / np.where(new > 0, new, 1)
        link = new
    return off(x)


def _onto(basis: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """What the columns add to the span of the orthonormal basis, as orthonormal columns."""
    out = basis
    for column in columns.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - out @ (out.T @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-10 * size:
            column = column / left
            out = np.column_stack([out, column - out @ (out.T @ column)])
            out[:, -1] /= np.linalg.norm(out[:, -1])
    return out[:, basis.shape[1] :]


def jacobi_davidson(product: Product, dims: int, wanted: int, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors of a symmetric positive semidefinite operator.

    ``top`` bounds its norm from above (a trace). A pair is locked when its residual is at most 16 * sqrt(dims) units
    of rounding of the largest eigenvalue, or when two more rounds could not halve a residual below 1e-12 of it, which is the floor that
    rounding in the sums leaves. If neither happens in ROUNDS rounds, that is an error.
    """
    wanted = min(wanted, dims)
    guard = min(dims, wanted + 2)
    random = np.random.default_rng(20)
    space = _onto(np.zeros((dims, 0)), random.standard_normal((dims, guard)))
    images = product(space)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    floor: list[float] = []
    for _ in range(ROUNDS):
        small = space.T @ images
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, image = space @ y, images @ y
        scale = max(float(theta[0]) if len(theta) else 0.0, float(values[0]) if len(values) else 0.0)
        if scale <= EPS * top or not len(theta):
            # Nothing varies in what is left: any basis will do.
            rest = _onto(locked, np.column_stack([ritz, random.standard_normal((dims, dims))]))[:, : wanted - locked.shape[1]]
            return np.concatenate([values, np.zeros(rest.shape[1])]), np.column_stack([locked, rest])
        open_pairs = wanted - locked.shape[1]
        residual = image - ritz * theta
        residual = residual - locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual[:, : min(open_pairs, len(theta))], axis=0)
        floor.append(float(sizes[0]))
        bound = 16 * np.sqrt(dims) * EPS * scale
        done = 0
        while done < len(sizes) and sizes[done] <= bound:
            done += 1
        if not done and len(floor) > 2 and floor[-3] <= 1e-12 * scale and floor[-1] > floor[-3] / 2:
            done = 1
        if done:
            values = np.concatenate([values, theta[:done]])
            locked = np.column_stack([locked, ritz[:, :done]])
            ritz, image, residual, theta, sizes = ritz[:, done:], image[:, done:], residual[:, done:], theta[done:], sizes[done:]
            space, images = ritz, image
            floor = []
            if locked.shape[1] == wanted:
                order = np.argsort(-values, kind="stable")
                return np.maximum(values[order], 0), locked[:, order]
            if not len(theta):
                fresh = _onto(locked, random.standard_normal((dims, guard)))
                space, images = fresh, product(fresh)
                continue
        if space.shape[1] + len(sizes) > max(SPACE * wanted, guard):
            keep = min(len(theta), 3 * guard)
            space, images = ritz[:, :keep], image[:, :keep]
        away = [np.column_stack([locked, ritz[:, k]]) for k in range(len(sizes))]
        corrections = minres(product, theta[: len(sizes)], away, -residual[:, : len(sizes)], INNER_STEPS, INNER_SHARE)
        fresh = _onto(np.column_stack([locked, space]), corrections)
        if not fresh.shape[1] and locked.shape[1] + space.shape[1] < dims:
            fresh = _onto(np.column_stack([locked, space]), random.standard_normal((dims, 1)))
        if fresh.shape[1]:
            space, images = np.column_stack([space, fresh]), np.column_stack([images, product(fresh)])
        else:
            # The space is everything; rounding is all that is left, so its products are made once more.
            space = _onto(locked, np.column_stack([ritz, space]))
            images = product(space)
    raise ArithmeticError("the eigenvectors did not settle")


@dataclass(frozen=True)
class Whitening:
    """A fitted transform of vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def rows(self) -> np.ndarray:
        """Columns that turn a centred vector into its whitened components; those without variance become zero."""
        with np.errstate(divide="ignore"):
            return self.axes * np.where(self.values > 0, 1 / np.sqrt(self.values), 0.0)


def fit(table: DataFrame, dims: int, components: int = 4) -> Whitening:
    """Fit the leading components of a written table with one column of distinct vectors of ``dims`` whole numbers."""
    n, sums = _sum_exactly(table, dims)
    mean = np.array([s / n for s in sums])
    trace = float(_summed(table, lambda x: np.array([((x - mean) ** 2).sum()]), (1,))[0]) / n
    values, axes = jacobi_davidson(covariance_product(table, mean, n), dims, components, trace)
    # A variance within rounding of nothing has no direction to be scaled by.
    values = np.where(values > dims * EPS * trace, values, 0.0)
    made = Whitening(n, sums, values, axes, values / trace if trace else values, 0.0)
    basis = made.rows()

    def part(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ basis
        return white.T @ white

    held = values > 0
    error = _summed(table, part, (len(values), len(values))) / n - np.eye(len(values))
    error = np.abs(error[np.ix_(held, held)]).max() if held.any() else 0.0
    return Whitening(n, sums, values, axes, made.explained, float(error))


WHITE = (
    "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    top = max(int(x.max()), -int(x.min()), 1) * n + max(map(abs, sums))
    if top * top * x.shape[1] <= LONG:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    apart = x.astype(object) * n - np.array(sums, object)
    return (apart * apart).sum(axis=1).tolist()


def _projected(fits: dict[int, Whitening]):
    kind, most = pa.decimal128(38, 0), 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = batch.column(0), pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths[lengths > 0]).tolist():
                at = pa.array(np.nonzero(lengths == dims)[0])
                made, x = fits[dims], _matrix(batch.column(1).take(at))
                white = (x - made.mean()) @ made.rows()
                k = white.shape[1]
                apart = [Decimal(d) if d < most else None for d in _deviations(x, made.n, made.sums)]
                rows = len(x)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(at).take(pa.array(np.repeat(np.arange(rows), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, made.n, np.int64)),
                    "deviation": pa.array(apart, kind).take(pa.array(np.repeat(np.arange(rows), k))),
                    "whitened": pa.array(white.ravel()),
                    "explained": pa.array(np.tile(made.explained, rows)),
                    "identity_error": pa.array(np.full(rows * k, made.identity_error)),
                })

    return run


def whitened(rows: DataFrame, components: int = 4, scale: float = 256.0) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding) and leading component: the whitened coordinate and the fit's figures.

    Rows whose vector is null or holds null or non-finite numbers are dropped. The others become whole numbers
    x = floor(scale * c). The fit list is each distinct x once; a copy does not weigh twice. Output: vec_id,
    component (from 1, by falling variance), n (size of the fit list), deviation (sum of (n * x - S)^2 over the
    dimensions, exact; null beyond 38 digits), whitened, explained (share of the trace), identity_error (largest
    entry of the whitened fit list's covariance minus the identity).

    Vectors of different lengths cannot share a covariance, so each length is fitted on its own list, one
    after the other. Vectors shorter than ``components`` give as many components as they have numbers, empty ones none.
    A component without variance (all vectors equal, or fewer vectors than components) has whitened and
    explained 0.0 and is left out of identity_error. Equal variances leave the choice of axes free. A number
    outside 64 bits after scaling counts as the nearest long. A null vec_id keeps its row, repeated rows stay
    repeated, no rows give none, other columns are not read.
    """
    good = rows.where(usable()).select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(scale).alias("x"))
    listed = cut(good.select("x", F.size("x").alias("dims")).where("dims > 0").distinct(), "fit-list")
    lengths = sorted(row["dims"] for row in listed.select("dims").distinct().collect())
    fits = {dims: fit(listed.where(F.col("dims") == dims).select("x"), dims, components) for dims in lengths}
    return good.mapInArrow(_projected(fits), WHITE)
