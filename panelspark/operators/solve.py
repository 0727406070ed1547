"""Solving small symmetric systems whose columns may depend on each other."""

from __future__ import annotations

import numpy as np

REL_TOL = 1e-12


def independent(m: np.ndarray, scale: np.ndarray | None = None, tol: float = REL_TOL) -> list[int]:
    """Columns to keep, in the given order: each adds to those before it.

    `m` holds cross products. A column is left out when what the kept ones do not explain of it is at
    most `tol` of `scale` (its sum of squares before factors were taken out, or m's own diagonal).
    """
    scale = np.diag(m) if scale is None else np.asarray(scale, float)
    keep: list[int] = []
    rows: list[np.ndarray] = []  # rows of the triangular factor, over all columns
    for j in range(len(m)):
        left = m[j] - sum((r[j] * r for r in rows), np.zeros(len(m)))
        if left[j] > tol * max(scale[j], np.finfo(float).tiny):
            keep.append(j)
            rows.append(left / np.sqrt(left[j]))
    return keep


def inverse_of(m: np.ndarray, keep: list[int]) -> np.ndarray:
    """Inverse over the kept columns, zero elsewhere."""
    out = np.zeros_like(m)
    at = np.ix_(keep, keep)
    out[at] = np.linalg.inv(m[at])
    return out
