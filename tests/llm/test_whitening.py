"""Whitening against dense eigenvectors of the whole covariance, in exact arithmetic where the contract is exact."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tabulark.llm import queries, whitening
from tabulark.llm.common import settled

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, component string, dims int"


def frame(spark, vectors):
    settled(spark)
    return spark.createDataFrame([(i, v, 1, "x", "c", 3) for i, v in vectors], SCHEMA)


def numbers(vector):
    return tuple(math.floor(256.0 * float(np.float32(c))) for c in vector)


def usable(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def check(rows, vectors, components=4):
    """Every figure of the rows of vectors of one length."""
    kept = [(i, numbers(v)) for i, v in vectors if usable(v)]
    listed = sorted({x for _, x in kept})
    n, dims = len(listed), len(listed[0])
    sums = [sum(x[d] for x in listed) for d in range(dims)]
    centred = np.array([[n * x[d] - sums[d] for d in range(dims)] for x in listed], float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    found = defaultdict(list)
    for r in rows:
        found[r.vec_id].append(r)
    want = defaultdict(list)
    for i, x in kept:
        want[i].append(x)
    assert set(found) == set(want)
    assert sum(map(len, found.values())) == len(kept) * min(components, dims)
    signs = {}
    for i, xs in want.items():
        assert {r.n for r in found[i]} == {n}
        assert sorted(int(r.deviation) for r in found[i] if r.component == 1) == sorted(sum((n * x[d] - sums[d]) ** 2 for d in range(dims)) for x in xs)
        for r in found[i]:
            k = r.component - 1
            assert abs(r.explained - e[k] / e.sum()) <= 1e-4 * e[k] / e.sum() + 1e-15
            assert r.identity_error <= 1e-4
            if len(xs) == 1 and e[k] > 1e-9 * e[0]:
                value = float((np.array([n * xs[0][d] - sums[d] for d in range(dims)]) / n) @ axes[:, k] / math.sqrt(e[k]))
                if abs(value) > 1e-3:
                    assert signs.setdefault(k, np.sign(value * r.whitened)) == np.sign(value * r.whitened)
                gap = min(abs(e[k] - e[j]) for j in range(dims) if j != k) / e[0] if dims > 1 else 1
                if gap > 1e-3:
                    assert abs(abs(value) - abs(r.whitened)) <= 1e-8 * (1 + abs(value))


def test_vectors_with_nulls_copies_and_a_steep_spectrum(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 24)) * np.geomspace(3, 0.05, 24)
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(500)] + [(7, vectors[3][1]), (None, vectors[5][1])]
    vectors += [(2000, None), (2001, [*vectors[0][1][:23], None]), (2002, [float("nan"), *vectors[0][1][:23]]), (2003, [float("inf"), *vectors[0][1][:23]])]
    check(whitening.whitened(frame(spark, vectors)).collect(), vectors)


def test_near_equal_variances_settle(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.standard_normal((400, 12)))]
    check(whitening.whitened(frame(spark, vectors)).collect(), vectors)


def test_fewer_vectors_than_components_and_other_lengths(spark):
    vectors = [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [2.0, 1.0, 0.0, 4.0, 5.0]), (3, [1.0, 2.0, 3.0, 4.0, 5.0])]
    rows = whitening.whitened(frame(spark, vectors)).collect()
    check(rows, vectors)
    assert all(r.whitened == 0 and r.explained == 0 for r in rows if r.component > 1)
    # Each length has a fit of its own; equal vectors vary in nothing.
    other = [(10, [0.5, 0.25]), (11, [0.5, -1.0]), (12, [3.0, 3.0]), (13, []), (14, [1.0]), (15, [1.0])]
    rows = whitening.whitened(frame(spark, vectors + other)).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.vec_id].append(r)
    assert {i: len(v) for i, v in by_id.items()} == {1: 4, 2: 4, 3: 4, 10: 2, 11: 2, 12: 2, 14: 1, 15: 1}
    check([r for r in rows if r.vec_id in (10, 11, 12)], other[:3])
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for i in (14, 15) for r in by_id[i]} == {(1, 0, 0.0, 0.0, 0.0)}


def test_no_rows(spark):
    assert whitening.whitened(frame(spark, [(1, None)])).collect() == []
    assert whitening.whitened(frame(spark, []).where("false")).collect() == []


def test_large_numbers_keep_their_exact_deviation(spark):
    vectors = [(1, [1e9, 3.0]), (2, [-1e9, 5.0]), (3, [12345678.0, 7.0]), (4, [0.0, -2.0])]
    check(whitening.whitened(frame(spark, vectors)).collect(), vectors)


def test_eigenpairs_have_residuals_of_double_precision():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((60, 60))
    for shape in (np.geomspace(1, 1e-6, 60), np.array([1.0, 1 - 1e-9, 1 - 2e-9] + [0.5] * 57), np.linspace(1, 0.9, 60)):
        q = np.linalg.qr(a)[0]
        matrix = (q * shape) @ q.T
        matrix = (matrix + matrix.T) / 2
        values, axes = whitening.jacobi_davidson(lambda c: matrix @ c, 60, 4, float(np.trace(matrix)))
        assert np.abs(values - np.sort(shape)[::-1][:4]).max() <= 1e-13
        assert np.abs(axes.T @ axes - np.eye(4)).max() <= 1e-13
        assert np.linalg.norm(matrix @ axes - axes * values, axis=0).max() <= 1e-12


def test_minres_solves_projected_equations():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((30, 30))
    matrix, q = a @ a.T, np.linalg.qr(rng.standard_normal((30, 2)))[0]
    rhs = rng.standard_normal((30, 1))
    rhs = rhs - q @ (q.T @ rhs)
    t = whitening.minres(lambda c: matrix @ c, np.array([1.3]), [q], rhs, 200, 1e-12)
    left = matrix @ t - 1.3 * t
    assert np.linalg.norm(left - q @ (q.T @ left) - rhs) <= 1e-8 * np.linalg.norm(rhs)
    assert np.abs(q.T @ t).max() <= 1e-12


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_query_over_its_table(spark, folder):
    given = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = queries.QUERIES["op11_jacobi_davidson_whitening"](spark, folder).collect()
    check(rows, [(r.vec_id, r.embedding) for r in given])
