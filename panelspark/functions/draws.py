"""Seeded draws as a pure function of row keys.

A draw depends only on its seed and keys, so it does not change when data are
repartitioned or a lost task is run again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_uniform(seed, *cols) -> Column:
    """Uniform on (0, 1) from the first 52 digest bits of seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2 ** 52))


def hash_normal2(seed, rho: float, *cols) -> tuple[Column, Column]:
    """Two standard normals with the given correlation."""
    radius = F.sqrt(F.log(hash_uniform(f"{seed}a", *cols)) * -2)
    angle = hash_uniform(f"{seed}b", *cols) * F.lit(2 * math.pi)
    e1, z = radius * F.cos(angle), radius * F.sin(angle)
    return e1, e1 * F.lit(float(rho)) + z * F.lit(math.sqrt(1 - rho * rho))
