"""Whitening against numpy's eigen-solver, exact sums against integers, odd vectors."""

import math

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import spectrum_whitening as sw
from panelspark.llm.queries import QUERIES


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))
    return (q * np.array(values)) @ q.T, q


@pytest.mark.parametrize("seed", range(6))
def test_inertia(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 7, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T - np.diag(np.diag(a) * (seed % 2) * 2)  # also with a zero diagonal, where only pivots of size 2 will do
        want = np.linalg.eigvalsh(a)
        assert sw.negative_pivots(a) == (want < 0).sum()
        for s in (want[:-1] + want[1:]) / 2:
            assert sw.negative_pivots(a - s * np.eye(n)) == (want < s).sum()


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [7], [1e6, 1, 1e-3, 1e-5], [3, 3, 3, 1], [2, 2 - 1e-12, 2 - 2e-12, 1], [1, 1, 1, 1], list(range(1, 65)), [1 + k * 1e-9 for k in range(20)]])
def test_pairs(values):
    v, _ = symmetric(values, len(values))
    e, u = sw.leading_eigenpairs(v, 32)
    want = np.sort(values)[::-1][:32]
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-9, atol=1e-13 * max(values))
    assert (np.diff(e) <= 0).all()
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12
    assert np.abs(v @ u - u * e).max() < 1e-12 * max(values) * len(values)


def test_zero_variance_is_left_out():
    v, _ = symmetric([4, 2, 0, 0])
    assert len(sw.leading_eigenpairs(v, 4)[0]) == 2
    assert len(sw.leading_eigenpairs(np.zeros((3, 3)), 4)[0]) == 0


def frame(spark, vectors, schema="vec_id long, embedding array<double>"):
    return spark.createDataFrame(list(enumerate(vectors)), schema)


def expected(vectors, top=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s).astype(object)
    cov = np.array((z.T @ z).astype(float)) / n**3
    e, u = np.linalg.eigh(cov)
    return n, (z * z).sum(axis=1), (z.astype(float) / n) @ u[:, ::-1][:, :top] / np.sqrt(e[::-1][:top]), e[::-1][:top] / np.trace(cov)


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    vec = (rng.standard_normal((700, 8)) @ rng.standard_normal((8, 8)) * 3).tolist()
    n, dev, white, share = expected(vec, 5)
    rows = sw.whiten(frame(spark, vec).repartition(4), top=5).collect()
    assert len(rows) == 700 * 5
    got = np.zeros((700, 5))
    for r in rows:
        assert r.n == n and int(r.deviation) == dev[r.vec_id] and math.isclose(r.explained, share[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-9
        got[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((got * white).sum(axis=0))
    assert np.allclose(got, white * sign, atol=1e-8)


def test_sums_are_exact_for_large_entries(spark):
    vec = [[float(2**40 + 3 * k), float(-(2**38) * k), float(k)] for k in range(20)]
    rows = sw.whiten(frame(spark, vec)).collect()
    n, dev, _, _ = expected(vec)
    assert {r.vec_id: int(r.deviation) for r in rows} == dict(enumerate(dev))
    assert {r.component for r in rows} >= {1} and max(r.identity_error for r in rows) < 1e-4


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[float(k), float(k * k % 7)] for k in range(9)]
    vec = good + [None, [], [1.0, None], [nan, 1.0], [inf, 0.0], [-inf, 0.0], [1.0], [1.0, 2.0, 3.0], [1e300, 0.0]]
    rows = sw.whiten(frame(spark, vec)).collect()
    assert {r.vec_id for r in rows} == set(range(9)) and {r.n for r in rows} == {9} and len(rows) == 18
    assert rows[0].identity_error < 1e-12
    assert sw.whiten(frame(spark, vec[9:15])).count() == 0
    assert sw.whiten(frame(spark, [[2.0, 3.0]] * 4)).count() == 0  # no variance
    assert sw.whiten(frame(spark, [])).count() == 0


def test_repeated_and_missing_ids_clashing_names(spark):
    rows = [(None, [1.0, 0.0], 7), (1, [0.0, 1.0], 8), (1, [0.0, 5.0], 8), (None, [1.0, 0.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int")
    got = sw.whiten(df).collect()
    assert len(got) == 8 and sorted(r.vec_id or 0 for r in got) == [0] * 4 + [1] * 4
    df = spark.createDataFrame([("a", [1, 2]), ("b", [3, 5]), ("c", [0, 9])], "vec_id string, embedding array<int>")
    assert {r.vec_id for r in sw.whiten(df).collect()} == {"a", "b", "c"}


def test_equal_lengths_the_longest_stays(spark):
    vec = [[1.0, 2.0], [3.0, 1.0], [1.0, 2.0, 3.0], [0.0, 2.0, 9.0]]
    assert {r.vec_id for r in sw.whiten(frame(spark, vec)).collect()} == {2, 3}


def test_reading_slices():
    a = pa.array([[9.0], [1.0, 2.0], None, [3.0, None], [4.0, 5.0]], pa.list_(pa.float64())).slice(1)
    x, n, at = sw.integers(a)
    assert x.tolist() == [1000064, 1000128, 1000256, 1000320] and n.tolist() == [2, 2] and at.tolist() == [0, 3]


def test_given_table(spark, sf):
    got = QUERIES["op13_spectrum_whitening"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["n"] == "bigint" and dict(got.dtypes)["component"] == "int"
    vec = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding}
    ids = sorted(vec)
    n, dev, white, share = expected([vec[i] for i in ids])
    at = {i: k for k, i in enumerate(ids)}
    w = np.zeros_like(white)
    for r in got.collect():
        assert r.deviation == dev[at[r.vec_id]] and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        w[at[r.vec_id], r.component - 1] = r.whitened
    assert np.allclose(w, white * np.sign((w * white).sum(axis=0)), atol=1e-6)
