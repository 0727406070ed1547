"""Normal law as Spark columns (no Python in the tasks) and as numpy helpers.

The rational approximations are published: Hart's form for the distribution
function, Wichura's algorithm for its inverse. Each is written once over a tiny
set of operations, so that columns and numpy arrays share one text.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Hart's distribution-function coefficients (highest power first).
HART_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_SPLIT = 7.07106781186547

# Wichura's quantile coefficients (lowest power first).
W_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
       1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
       3.3430575583588128105e4, 2.5090809287301226727e3)
W_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
       2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
       5.2264952788528545610e3)
W_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
       3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
       2.27238449892691845833e-2, 7.74545014278341407640e-4)
W_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
       1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
       1.05075007164441684324e-9)
W_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
       2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
       2.71155556874348757815e-5, 2.01033439929228813265e-7)
W_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
       7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
       2.04426310338993978564e-15)

SQRT_2PI = math.sqrt(2 * math.pi)
BVN_NODES = 24


def horner(z, coefs):
    """Polynomial with the highest power first."""
    acc = coefs[0]
    for c in coefs[1:]:
        acc = acc * z + c
    return acc


def _tail_fraction(z):
    t = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        t = z + k / t
    return t


# ---- columns ----------------------------------------------------------------
# A column given by name becomes one parsed expression, which is much faster to build than
# a chain of column operations; anything else is built from operations.

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(float(x)))


def _poly_text(z: str, coefs) -> str:
    text = f"{coefs[0]!r}D"
    for c in coefs[1:]:
        text = f"({text} * {z} + {c!r}D)"
    return text


def norm_pdf(x) -> Column:
    x = _c(x)
    return F.exp(x * x * F.lit(-0.5)) / F.lit(SQRT_2PI)


def _cdf_text(x: str) -> str:
    z = f"abs({x})"
    e = f"exp(-0.5D * {x} * {x})"
    tail = f"({z} + 0.65D)"
    for k in (4, 3, 2, 1):
        tail = f"({z} + {k}.0D / {tail})"
    low = (f"CASE WHEN {z} < {HART_SPLIT}D THEN {e} * {_poly_text(z, HART_NUM)} / {_poly_text(z, HART_DEN)} "
           f"WHEN {z} <= 37 THEN {e} / {tail} / {SQRT_2PI!r}D ELSE 0.0D END")
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1 - {low} ELSE {low} END)"


def norm_cdf(x) -> Column:
    """Standard normal distribution function, near double precision."""
    if isinstance(x, str):
        return F.expr(_cdf_text(f"`{x}`"))
    x = _c(x)
    z = F.abs(x)
    e = F.exp(z * z * F.lit(-0.5))
    lower = (F.when(z < HART_SPLIT, e * horner(z, HART_NUM) / horner(z, HART_DEN))
             .when(z <= 37, e / _tail_fraction(z) / F.lit(SQRT_2PI))
             .otherwise(F.lit(0.0)))
    return F.when(x.isNull(), None).when(x > 0, 1 - lower).otherwise(lower)


def _tail_text(z: str) -> str:
    t = f"({z} + 0.65D)"
    for k in (4, 3, 2, 1):
        t = f"({z} + {k}.0D / {t})"
    return t


def log_norm_cdf(x: str) -> Column:
    """Log of the distribution function of a named column, also where the function itself rounds to zero."""
    c = f"`{x}`"
    return F.expr(f"CASE WHEN {c} > -{HART_SPLIT}D THEN ln({_cdf_text(c)}) "
                  f"ELSE -0.5D * {c} * {c} - ln({_tail_text(f'(-{c})')} * {SQRT_2PI!r}D) END")


def norm_hazard(x: str) -> Column:
    """Density over distribution function of a named column, also where both round to zero."""
    c = f"`{x}`"
    return F.expr(f"CASE WHEN {c} > -{HART_SPLIT}D THEN exp(-0.5D * {c} * {c}) / ({SQRT_2PI!r}D * {_cdf_text(c)}) "
                  f"ELSE {_tail_text(f'(-{c})')} END")


def norm_inv(p: str) -> Column:
    """Standard normal quantile of a named column; missing outside (0, 1)."""
    x = f"`{p}`"
    q, up = f"({x} - 0.5D)", lambda cs: tuple(reversed(cs))
    mid = f"(0.180625D - {q} * {q})"
    r = f"sqrt(-ln(least({x}, 1 - {x})))"
    near, far = f"({r} - 1.6D)", f"({r} - 5.0D)"
    ratio = lambda z, n, d: f"{_poly_text(z, up(n))} / {_poly_text(z, up(d))}"
    tail = f"CASE WHEN {r} <= 5 THEN {ratio(near, W_C, W_D)} ELSE {ratio(far, W_E, W_F)} END"
    return F.expr(f"CASE WHEN {x} <= 0 OR {x} >= 1 THEN NULL WHEN abs({q}) <= 0.425D THEN {q} * {ratio(mid, W_A, W_B)} "
                  f"ELSE sign({q}) * {tail} END")


def bvn_cdf(h: str, k: str, rho) -> Column:
    """P(X <= h, Y <= k) of named columns, by Gauss-Legendre over the angle.

    The correlation is a number or a named column.
    """
    a, b = f"`{h}`", f"`{k}`"
    if isinstance(rho, str):
        x, wt = np.polynomial.legendre.leggauss(BVN_NODES)
        half = f"asin(`{rho}`) / 2"
        rule = [(f"{half} * {float(wi / (2 * math.pi))!r}D", f"sin({half} * {float(xi + 1)!r}D)") for xi, wi in zip(x, wt)]
    else:
        rule = [(f"{w!r}D", f"{s!r}D") for w, s in bvn_rule(rho)]
    terms = [f"{w} * exp(-({a} * {a} + {b} * {b} - 2 * {a} * {b} * ({s})) / (2 * (1 - ({s}) * ({s}))))" for w, s in rule]
    return F.expr(f"{_cdf_text(a)} * {_cdf_text(b)} + " + " + ".join(terms))


def bvn_rule(rho: float) -> list[tuple[float, float]]:
    """(weight, sine) pairs of the angle integral from 0 to asin(rho)."""
    x, w = np.polynomial.legendre.leggauss(BVN_NODES)
    half = math.asin(rho) / 2
    return [(float(wi * half / (2 * math.pi)), float(math.sin(half * (xi + 1))))
            for xi, wi in zip(x, w)]


# ---- numpy, for small arrays inside tasks and on the driver ------------------

def np_pdf(x):
    return np.exp(-0.5 * x * x) / SQRT_2PI


def np_cdf(x):
    x = np.asarray(x, float)
    z = np.minimum(np.abs(x), 38.0)
    e = np.exp(-0.5 * z * z)
    near = e * horner(z, HART_NUM) / horner(z, HART_DEN)
    far = e / _tail_fraction(z) / SQRT_2PI
    lower = np.where(z < HART_SPLIT, near, np.where(z <= 37, far, 0.0))
    return np.where(x > 0, 1 - lower, lower)


def np_log_cdf(x):
    """Log of the distribution function, also where the function itself rounds to zero."""
    x = np.asarray(x, float)
    z = np.maximum(-x, HART_SPLIT)
    far = -0.5 * z * z - np.log(_tail_fraction(z) * SQRT_2PI)
    return np.where(x < -HART_SPLIT, far, np.log(np.where(x < -HART_SPLIT, 1.0, np_cdf(x))))


def np_inv(p: float) -> float:
    """Quantile of one probability by Newton steps on the distribution function."""
    x = 0.0
    for _ in range(60):
        step = (float(np_cdf(x)) - p) / float(np_pdf(np.float64(x)))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return x


def np_bvn(h, k, rho: float):
    """Bivariate distribution function of arrays at one correlation."""
    out = np_cdf(h) * np_cdf(k)
    for w, s in bvn_rule(rho):
        out = out + w * np.exp(-(h * h + k * k - 2 * s * h * k) / (2 * (1 - s * s)))
    return np.clip(out, 1e-300, 1.0)
