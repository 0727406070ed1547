"""Whitening of embeddings, with eigenvalues isolated by spectrum slicing.

1. Entries become integers x = floor(scale * c) + shift. One pass gives count and sums; a second the cross products of
   x less the rounded mean, also integers, so that the covariance is exact until it is divided out.
2. An LDL' factorisation of V - s I (symmetric pivots of size 1 and 2) has as many negative pivots as V has eigenvalues
   below s. Bisection over s isolates every leading eigenvalue in an interval of its own.
3. Within its interval Rayleigh quotient iteration, started from a solve at the middle, converges cubically. Counts on
   both sides of the result certify that it is the eigenvalue of that number; if not, the interval is cut further.
   Eigenvalues that no shift tells apart get vectors orthogonal to those found before.
4. A third pass projects all rows, a fourth measures the covariance of the result.

Sums are added as integers by Spark, d (d + 1) / 2 a task; the driver holds one d x d matrix.

Cases: rows whose vector is null, holds a null or non-finite entry or one that does not fit, or has another length than
most vectors (of equally frequent lengths the longest), are dropped; an empty vector likewise; no rows left give no
rows; components of variance zero (below `RANK` of the largest) have no whitened values and are left out; rows that
share an id, or have none, are whitened each for itself; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, SHIFT = 64, 1_000_000
RANK = 1e-12
TOP = 32
FITS = float(2**62)


def integers(column: pa.Array, scale: int = SCALE, shift: int = SHIFT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of all usable rows in a row, their lengths, their row numbers)."""
    lists = column.cast(pa.large_list(pa.float64()))
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    value = lists.values.slice(lists.offsets[0].as_py(), int(n.sum())) if len(lists) else lists.values
    with np.errstate(invalid="ignore", over="ignore"):
        c = np.floor(scale * value.to_numpy(zero_copy_only=False).astype(float))  # nulls become NaN
        bad = ~(np.abs(c) < FITS)
    row = np.repeat(np.arange(len(lists)), n)
    ok = (n > 0) & ~np.asarray(lists.is_null()) & (np.bincount(row[bad], minlength=len(lists)) == 0)
    return c[ok[row]].astype(np.int64) + shift, n[ok], np.flatnonzero(ok)


def _matrices(batches, d: int, scale: int, shift: int):
    """(rows x d integers, row numbers, batch) of each batch, rows of length d alone."""
    for b in batches:
        x, n, at = integers(b.column("vec"), scale, shift)
        keep = n == d
        if keep.any():
            yield x[np.repeat(keep, n)].reshape(-1, d), at[keep], b


def _slots(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(list(map(str, values)), pa.string())], names=["slot", "value"])


def _sum_slots(rows: DataFrame, run, size: int) -> list[int]:
    """Exact sums of integers that every task gives by slot; in two steps, so that no task meets all."""
    each = rows.mapInArrow(run, "slot int, value string").select("slot", F.col("value").cast("decimal(38,0)").alias("value"))
    out = [0] * size
    for r in each.groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[r["slot"]] = int(r["value"])
    return out


def count_and_sums(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, int, list[int]]:
    """(dimension, number of vectors, their sums)."""
    def sizes(batches):
        for b in batches:
            size, many = np.unique(integers(b.column("vec"), scale, shift)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(many, pa.int64())], names=["size", "many"])

    got = (rows.mapInArrow(sizes, "size long, many long").groupBy("size").agg(F.sum("many").alias("many"))
           .orderBy(F.desc("many"), F.desc("size")).first())
    if got is None:
        return 0, 0, []
    d, n = got

    def sums(batches):
        total = [0] * d
        for x, _, _ in _matrices(batches, d, scale, shift):
            wide = int(np.abs(x).max()) * len(x) >= 2**62
            total = [a + int(v) for a, v in zip(total, (x.astype(object) if wide else x).sum(axis=0))]
        yield _slots(total)

    return d, n, _sum_slots(rows, sums, d)


def covariance(rows: DataFrame, d: int, n: int, sums: list[int], scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """Divisor n. Products are of x less the rounded mean and stay integers up to the last division."""
    mid = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(d)

    def products(batches):
        total = np.zeros(len(upper[0]), object)
        for x, _, _ in _matrices(batches, d, scale, shift):
            z = x - mid
            most = float(np.abs(z).max()) ** 2
            step = int(min(len(z), max(1, 2.0**52 / max(most, 1.0))))
            for k in range(0, len(z), step):
                part = z[k:k + step]
                # below 2^53 every partial sum of doubles is exact; larger entries go one by one
                m = (part.T.astype(float) @ part.astype(float)).astype(np.int64) if most < 2.0**52 else part.T.astype(object) @ part.astype(object)
                total = total + m[upper].astype(object)
        yield _slots(total.tolist())

    m = _sum_slots(rows, products, len(upper[0]))
    rest = [s - n * int(c) for s, c in zip(sums, mid)]
    v = np.zeros((d, d))
    for k, (i, j) in enumerate(zip(*(u.tolist() for u in upper))):
        v[i, j] = v[j, i] = (n * m[k] - rest[i] * rest[j]) / (n * n)  # a quotient of integers, rounded once
    return v


# ---- spectrum slicing

def negative_pivots(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix, from its LDL' factors with symmetric pivots of size 1 and 2."""
    a = a.copy()
    limit, count, k, n = (1 + 17**0.5) / 8, 0, 0, len(a)
    while k < n:
        col = np.abs(a[k + 1:, k])
        size = 1
        if len(col) and col.max() > 0:
            r = k + 1 + int(col.argmax())
            top = col[r - k - 1]
            if abs(a[k, k]) < limit * top:
                other = np.abs(a[r, k:])
                other[r - k] = 0
                sigma = other.max()
                if abs(a[k, k]) * sigma >= limit * top * top:
                    pass
                elif abs(a[r, r]) >= limit * sigma:
                    a[[k, r]] = a[[r, k]]
                    a[:, [k, r]] = a[:, [r, k]]
                else:
                    size = 2
                    a[[k + 1, r]] = a[[r, k + 1]]
                    a[:, [k + 1, r]] = a[:, [r, k + 1]]
        if size == 1:
            p = a[k, k]
            count += p < 0
            if p != 0:
                c = a[k + 1:, k]
                a[k + 1:, k + 1:] -= np.outer(c / p, c)
        else:
            p = a[k:k + 2, k:k + 2]
            count += 1  # such a block has one eigenvalue of each sign
            c = a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= c @ np.linalg.solve(p, c.T)
        k += size
    return int(count)


def leading_eigenpairs(v: np.ndarray, top: int, rank: float = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Up to `top` eigenvalues, falling, and unit eigenvectors as columns; those below `rank` of the largest are left out."""
    d = len(v)
    bound = float(np.abs(v).sum(axis=1).max())
    eps = np.finfo(float).eps * bound * d
    if bound == 0:
        return np.zeros(0), np.zeros((d, 0))
    known: dict[float, int] = {}

    def above(s: float) -> int:
        """Eigenvalues above s, with ties of rounding going either way."""
        if s not in known:
            known[s] = d - negative_pivots(v - s * np.eye(d))
        return known[s]

    known[-bound - eps], known[bound + eps] = d, 0
    values, vectors = [], np.zeros((d, 0))
    rng = np.random.default_rng(0)
    for k in range(min(top, d)):
        low = max(s for s, c in known.items() if c > k)
        high = min(s for s, c in known.items() if c <= k and s > low)
        found = None
        while found is None:
            while above(low) - above(high) > 1 and high - low > 4 * eps:
                mid = (low + high) / 2
                low, high = (mid, high) if above(mid) > k else (low, mid)
            found = _rayleigh(v, low, high, vectors, rng, eps)
            if found is None:
                if high - low <= 4 * eps:
                    raise ArithmeticError(f"eigenvalue {k + 1} was not reached from its interval")
                mid = (low + high) / 2
                low, high = (mid, high) if above(mid) > k else (low, mid)
            elif not (above(found[0] - 4 * eps) > k >= above(found[0] + 4 * eps)):
                raise ArithmeticError(f"the counts beside {found[0]} do not number it {k + 1}")
        if found[0] <= rank * (values[0] if values else max(found[0], 0.0)):
            break
        values.append(found[0])
        vectors = np.column_stack([vectors, found[1]])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


def _rayleigh(v, low, high, vectors, rng, eps):
    """The pair that Rayleigh quotient iteration reaches from the interval's middle, None if it leaves the interval."""
    eye = np.eye(len(v))
    less = lambda x: x - vectors @ (vectors.T @ x)
    unit = lambda x: x / np.linalg.norm(x)

    def solve(s, x):
        try:
            return unit(less(np.linalg.solve(v - s * eye, x)))
        except np.linalg.LinAlgError:
            return unit(less(np.linalg.solve(v - (s + eps) * eye, x)))

    x = unit(less(rng.standard_normal(len(v))))
    for _ in range(3):
        x = solve((low + high) / 2, x)
    q = float(x @ v @ x)
    for _ in range(12):
        if not low - 4 * eps <= q <= high + 4 * eps:
            return None
        x = solve(q, x)
        old, q = q, float(x @ v @ x)
        if np.linalg.norm(v @ x - q * x) <= eps and abs(q - old) <= eps:
            return q, unit(less(unit(less(x))))
    return None


# ---- projection

def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error); deviation is decimal(38,0), exact."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    kind = df.schema[vec_id].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation string, whitened double, explained double"
    d, n, sums = count_and_sums(rows, scale, shift)
    if n == 0:
        none = df.sparkSession.createDataFrame([], schema + ", identity_error double")
        return none.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumnRenamed("id", vec_id)
    v = covariance(rows, d, n, sums, scale, shift)
    e, u = leading_eigenpairs(v, top)
    k, trace = len(e), float(np.trace(v))
    mid = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    frac = np.array([(s - n * int(c)) / n for s, c in zip(sums, mid)])
    rest = [s - n * int(c) for s, c in zip(sums, mid)]
    way = u / np.sqrt(e)
    upper = np.triu_indices(k)

    def project(x):
        return ((x - mid).astype(float) - frac) @ way

    def moments(batches):
        total = np.zeros(k + len(upper[0]))
        for x, _, _ in _matrices(batches, d, scale, shift):
            w = project(x)
            total += np.concatenate([w.sum(axis=0), (w.T @ w)[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["slot", "value"])

    error = 0.0
    if k:
        m = np.zeros(k + len(upper[0]))
        for r in rows.mapInArrow(moments, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():
            m[r["slot"]] = r["value"]
        cov = m[k:] / n - m[:k][upper[0]] * m[:k][upper[1]] / (n * n)
        error = float(np.abs(cov - (upper[0] == upper[1])).max())

    def out(batches):
        for x, at, b in _matrices(batches, d, scale, shift):
            z = x - mid
            most = (float(np.abs(z).max()) + 1) * n
            far = (n * z - np.array(rest, np.int64) if most * most * d < 2.0**62 else n * z.astype(object) - np.array(rest, object))
            deviation = (far * far).sum(axis=1)
            step = max(1, 200_000 // max(k, 1))
            w = project(x)
            for i in range(0, len(x), step):
                many = len(w[i:i + step])
                row = pa.array(np.repeat(at[i:i + step], k))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n, np.int64)),
                     pa.array(np.char.mod("%d", deviation[i:i + step]) if deviation.dtype != object else list(map(str, deviation[i:i + step])), pa.string()).take(pa.array(np.repeat(np.arange(many), k))),
                     pa.array(w[i:i + step].ravel()), pa.array(np.tile(e / trace if k else e, many))],
                    names=["id", "component", "n", "deviation", "whitened", "explained"])

    return (rows.mapInArrow(out, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
            .withColumn("identity_error", F.lit(error)).withColumnRenamed("id", vec_id))
