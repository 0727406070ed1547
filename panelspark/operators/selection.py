"""Bivariate probit with sample selection, for factors with any number of levels.

The outcome is seen only for selected rows; the errors of the two equations are correlated. Newton steps maximise the
likelihood. The effects of the factor with the most levels stay in a table: a level's block of the information is 2 x 2,
so tasks take it out of the equations of all other parameters (a Schur complement from sums by level), the driver
solves those, and the levels' own steps follow level by level. All other parameters, the levels of further factors included, make one
dense matrix on the driver.

Several specifications are fitted together: each step reads the rows once and evaluates every specification still open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.normal import log_norm_cdf, norm_cdf, np_bvn, np_cdf, np_log_cdf, np_pdf
from panelspark.operators.clean import conditional_update
from panelspark.operators.keys import cut_lineage, release
from panelspark.operators.linear import Fit
from panelspark.operators.solve import independent, inverse_of

OUT, SEL = "outcome", "select"


@dataclass
class Wide:
    """The factor whose effects are kept in a table.

    effects: (level, out, sel), the base included; parts: (level, vals) with the inverse block (3 numbers) and both rows of
    block^-1 x cross block; cells: (cluster, level, g0, g1), score sums of the two effects.
    """
    name: str
    effects: DataFrame
    parts: DataFrame
    cells: DataFrame | None = None


@dataclass
class Model:
    """Coefficients of both equations by (equation, term, level); level is None for a column."""
    x: list[str]
    z: list[str]
    levels: dict[str, list] = field(default_factory=dict)
    coef: dict[tuple, float] = field(default_factory=dict)
    athrho: float = 0.0
    names: list[tuple] = field(default_factory=list)
    cov: np.ndarray | None = None
    wide: Wide | None = None
    unit: np.ndarray | None = None    # own units = unit @ units of the search
    bread: np.ndarray | None = None   # inverse information in units of the search, levels of `wide` taken out
    scores: DataFrame | None = None   # (cluster, vals): score sums in units of the search, levels of `wide` taken out
    stats: dict[str, float] = field(default_factory=dict)
    omitted: set[int] = field(default_factory=set)  # positions of parameters that the data do not identify

    @property
    def rho(self) -> float:
        return math.tanh(self.athrho)

    def get(self, eq: str, term: str, level=None) -> float:
        return self.coef.get((eq, term, level), 0.0)

    def fit(self) -> Fit:
        """All parameters but the effects of `wide` (see `level_table`), the transformed correlation last, in table form."""
        terms = [f"{eq}:{t}" + ("" if lv is None else f"={lv}") for eq, t, lv in self.names]
        vals = np.array([self.athrho if n[0] == "athrho" else self.coef[n] for n in self.names])
        return Fit(terms, vals, self.cov, {**self.stats, "rho": self.rho}, {terms[i] for i in self.omitted})


@dataclass
class Spec:
    """One specification. `update` lists (column, condition, value) changes that it alone sees."""
    y: str
    x: list[str]
    select: str
    z: list[str]
    factors: list[str] = field(default_factory=list)
    cluster: str | None = None
    where: Column | None = None
    update: list[tuple] = field(default_factory=list)


def usable(y: str, x: list[str], select: str, z: list[str], factors: list[str] | None = None, where: Column | None = None) -> Column:
    """Whether a row enters the fit: selection known, outcome known if selected, all columns and factors present."""
    ok = F.col(select).isNotNull() & ((F.col(select) == 0) | F.col(y).isNotNull())
    for c in dict.fromkeys([*x, *z, *(factors or [])]):
        ok = ok & F.col(c).isNotNull()
    return F.coalesce(ok if where is None else ok & where, F.lit(False))


def index_columns(df: DataFrame, model: Model, xb: str = "xb", zg: str = "zg") -> DataFrame:
    """Add both linear indices; level effects are joined from tables.

    A row whose level is missing or was not in the fit stays, with missing indices.
    """
    spark = df.sparkSession
    parts = {OUT: F.lit(model.get(OUT, "_cons")), SEL: F.lit(model.get(SEL, "_cons"))}
    for eq, cols in ((OUT, model.x), (SEL, model.z)):
        for c in cols:
            parts[eq] = parts[eq] + F.col(c) * F.lit(model.get(eq, c))
    drop = []
    for f, levels in model.levels.items():
        rows = [(lv, model.get(OUT, f, lv), model.get(SEL, f, lv)) for lv in levels]
        df = df.join(spark.createDataFrame(rows, f"{f} {dict(df.dtypes)[f]}, _o_{f} double, _s_{f} double"), f, "left")
        drop.append(f)
    if model.wide:
        f = model.wide.name
        eff = model.wide.effects.select(F.col("level").alias("_level"), F.col("out").alias(f"_o_{f}"), F.col("sel").alias(f"_s_{f}"))
        df = df.join(eff, F.col(f).cast("string") == F.col("_level"), "left").drop("_level")
        drop.append(f)
    for f in drop:
        parts[OUT], parts[SEL] = parts[OUT] + F.col(f"_o_{f}"), parts[SEL] + F.col(f"_s_{f}")
    return df.withColumns({xb: parts[OUT], zg: parts[SEL]}).drop(*[f"{p}{f}" for f in drop for p in ("_o_", "_s_")])


def selection_predict(df: DataFrame, model: Model, kinds: list[str]) -> DataFrame:
    """Add predictions: xb, xbsel, psel, pmargin, pcond; the last from logarithms, so that it holds where psel rounds to zero."""
    d = index_columns(df, model, "_xb", "_zg")
    put: dict[str, Column] = {
        "xb": F.col("_xb"), "xbsel": F.col("_zg"), "psel": norm_cdf("_zg"), "pmargin": norm_cdf("_xb"),
        "pcond": F.exp(log_joint_column(F.col("_xb"), F.col("_zg"), model.rho) - log_norm_cdf("_zg"))}
    return d.withColumns({k: put[k] for k in kinds}).drop("_xb", "_zg")


def selection_loglik(df: DataFrame, model: Model, y: str, select: str) -> DataFrame:
    """(loglik, n, n_selected, n_unusable) of a model on rows, by column expressions.

    Unusable rows have probability zero to rounding, or no prediction; they are counted, not added.
    """
    d = index_columns(df, model, "_xb", "_zg").withColumn("_mzg", -F.col("_zg"))
    # a small joint probability is the difference of two large ones: logarithms of it come from its own tail
    side = F.when(F.col(y) == 1, 1.0).otherwise(-1.0)
    d = d.withColumn("_ll", F.when(F.col(select) == 0, log_norm_cdf("_mzg"))
                     .otherwise(log_joint_column(F.col("_xb"), F.col("_zg"), model.rho, side)))
    ok = F.coalesce(F.exp("_ll") > 0, F.lit(False))
    return d.agg(F.sum(F.when(ok, F.col("_ll"))).alias("loglik"), F.count("*").alias("n"),
                 F.sum(select).cast("long").alias("n_selected"), F.count(F.when(~ok, 1)).alias("n_unusable"))


# ---- likelihood inside tasks --------------------------------------------------

LOG_ROOT_2PI = math.log(2 * math.pi) / 2
LAGUERRE = np.polynomial.laguerre.laggauss(40)
SMALL = 1e-9  # below it, the plain rule for the joint probability loses digits


def _log_pdf(v):
    return -v * v / 2 - LOG_ROOT_2PI


def log_joint(a: np.ndarray, k: np.ndarray, r: float) -> np.ndarray:
    """log P(X <= a, Y <= k) at correlation r, also far out.

    Small values are the integral over the rarer variable's tail, by Laguerre nodes in logarithms.
    """
    f = np_bvn(a, k, r)
    out = np.log(f)
    far = np.flatnonzero(f < SMALL)
    if len(far):
        s, t = np.minimum(a[far], k[far]), np.maximum(a[far], k[far])
        rt = math.sqrt(1 - r * r)
        b = (t - r * s) / rt
        fall = -s - r / rt * np.exp(_log_pdf(b) - np_log_cdf(b))
        rate = np.maximum(fall, 1.0)[:, None]
        x, w = LAGUERRE
        at = s[:, None] - x / rate
        terms = np.log(w) + x + _log_pdf(at) + np_log_cdf(((t[:, None] - r * at) / rt).ravel()).reshape(at.shape)
        top = terms.max(axis=1)
        out[far] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1)) - np.log(rate[:, 0])
    return out


def log_joint_column(x: Column, z: Column, r: float, side: Column | None = None) -> Column:
    """`log_joint` of two columns, missing where either is; with `side` -1 the row has x and the correlation negated."""
    @F.pandas_udf("double")
    def go(a: pd.Series, k: pd.Series, q: pd.Series) -> pd.Series:
        a, k, q = a.to_numpy(float), k.to_numpy(float), q.to_numpy(float)
        out = np.full(len(a), np.nan)
        for v in (1.0, -1.0):
            at = np.flatnonzero((q == v) & np.isfinite(a) & np.isfinite(k))
            if len(at):
                out[at] = log_joint(v * a[at], k[at], v * r)
        return pd.Series(out)
    return go(x, z, F.lit(1.0) if side is None else side)


def _pieces(xb, zg, y, s, tau, second: bool):
    """Log-likelihood and its derivatives in (xb, zg, tau) per row."""
    rho = math.tanh(tau)
    n = len(s)
    ll = np.zeros(n)
    g = np.zeros((n, 3))
    h = np.zeros((n, 6)) if second else None  # xx, xz, xt, zz, zt, tt
    un = s == 0
    k = zg[un]
    logp = np_log_cdf(-k)
    m = np.exp(_log_pdf(k) - logp)
    ll[un] = logp
    g[un, 1] = -m
    if second:
        h[un, 3] = m * (k - m)
    for val, q in ((1, 1.0), (0, -1.0)):
        at = (s == 1) & (y == val)
        if not at.any():
            continue
        a, k, r = q * xb[at], zg[at], q * rho
        s2 = 1 - r * r
        rt = math.sqrt(s2)
        logf = log_joint(a, k, r)
        ll[at] = logf
        # ratios to the probability, from logarithms, so that value and derivatives agree far out too
        la = np.exp(_log_pdf(a) + np_log_cdf((k - r * a) / rt) - logf)
        lk = np.exp(_log_pdf(k) + np_log_cdf((a - r * k) / rt) - logf)
        lr = np.exp(-(a * a + k * k - 2 * r * a * k) / (2 * s2) - math.log(2 * math.pi * rt) - logf)
        dr = q * (1 - rho * rho)
        g[at, 0], g[at, 1], g[at, 2] = q * la, lk, lr * dr
        if second:
            lrr = lr * ((r * s2 + (1 + r * r) * a * k - r * (a * a + k * k)) / (s2 * s2))
            h[at, 0] = -a * la - r * lr - la * la
            h[at, 1] = q * (lr - la * lk)
            h[at, 2] = q * (-(a - r * k) / s2 * lr - la * lr) * dr
            h[at, 3] = -k * lk - r * lr - lk * lk
            h[at, 4] = (-(k - r * a) / s2 * lr - lk * lr) * dr
            h[at, 5] = (lrr - lr * lr) * dr * dr + lr * (-2 * rho * (1 - rho * rho) * q)
    return ll, g, h


class _Layout:
    """Positions of columns, constant and factor levels of one equation."""

    def __init__(self, cols: list[str], factors: dict[str, int], start: int):
        self.cols, self.start = cols, start
        self.at, pos = {}, start + len(cols) + 1
        for f, n in factors.items():
            self.at[f] = (pos, n)
            pos += n
        self.stop = pos

    def index(self, theta, dense, codes):
        out = dense @ theta[self.start:self.start + dense.shape[1]]
        for f, (pos, _) in self.at.items():
            out = out + theta[pos + codes[f]]
        return out

    def sums(self, dense, codes, w, inv, n) -> np.ndarray:
        """Design-weighted sums of `w` by group: n x parameters of the equation."""
        out = np.zeros((n, self.stop - self.start))
        for j in range(dense.shape[1]):
            out[:, j] = np.bincount(inv, w * dense[:, j], n)
        for f, (pos, m) in self.at.items():
            out[:, pos - self.start:pos - self.start + m] = np.bincount(inv * m + codes[f], w, n * m).reshape(n, m)
        return out


def _gram(la: _Layout, da, lb: _Layout, db, codes, w, out):
    """Add the weighted cross products of two equations' designs to `out`, by level counts."""
    ka, kb = da.shape[1], db.shape[1]
    out[la.start:la.start + ka, lb.start:lb.start + kb] += da.T @ (w[:, None] * db)
    for f, (pos, n) in lb.at.items():
        for j in range(ka):
            out[la.start + j, pos:pos + n] += np.bincount(codes[f], w * da[:, j], n)
    for f, (pos, n) in la.at.items():
        for j in range(kb):
            out[pos:pos + n, lb.start + j] += np.bincount(codes[f], w * db[:, j], n)
        for g, (pos2, n2) in lb.at.items():
            out[pos:pos + n, pos2:pos2 + n2] += np.bincount(codes[f] * n2 + codes[g], w, n * n2).reshape(n, n2)


class _Side:
    """One specification inside a task: where its columns are, and the design of a batch."""

    def __init__(self, k: int, x, z, y, sel, sizes: dict[str, int], wide: str | None, base, mean, sd, cluster):
        self.k, self.x, self.z, self.y, self.sel, self.wide, self.base, self.cluster = k, x, z, y, sel, wide, base, cluster
        self.mean, self.sd = mean, sd
        self.lx = _Layout(x, sizes, 0)
        self.lz = _Layout(z, sizes, self.lx.stop)
        self.p = self.lz.stop + 1

    def rows(self, pdf: pd.DataFrame):
        pdf = pdf[pdf[f"_m{self.k}"].to_numpy(bool)]
        dense = lambda cols: np.column_stack([(pdf[c].to_numpy(float) - self.mean[c]) / self.sd[c] for c in cols] + [np.ones(len(pdf))])
        codes = {f: pdf[f"_c_{f}"].to_numpy() for f in self.lx.at}
        return pdf, dense(self.x), dense(self.z), codes

    def effects(self, pdf) -> tuple:
        if not self.wide:
            return 0.0, 0.0
        return tuple(pdf[f"_{e}{self.k}"].fillna(0.0).to_numpy(float) for e in "ab")

    def derivatives(self, pdf, dx, dz, codes, theta, second):
        a, b = self.effects(pdf)
        return _pieces(self.lx.index(theta, dx, codes) + a, self.lz.index(theta, dz, codes) + b, pdf[self.y].to_numpy(float),
                       pdf[self.sel].to_numpy(float), theta[-1], second)

    def by_level(self, pdf) -> tuple[np.ndarray, np.ndarray]:
        """(levels, index of each row's, -1 for the base level)."""
        code, names = pd.factorize(pdf[f"_f_{self.wide}"])
        at = np.flatnonzero(names.to_numpy() == self.base)
        names = names.to_numpy().astype(object)
        if len(at):
            code = np.where(code == at[0], -1, np.where(code > at[0], code - 1, code))
            names = np.delete(names, at[0])
        return names, code


def _partials(sides: list[tuple[_Side, np.ndarray]]):
    """Sums of each specification: a row (key, spec, level, a, b, vals) per level that the task meets, and one without a level.

    vals of a level: gradient (2), information (3), counts (2), cross block (2 x parameters); without: log-likelihood, gradient, information.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {s.k: [0.0, np.zeros(s.p), np.zeros((s.p, s.p))] for s, _ in sides}
        held: list[pd.DataFrame] = []
        n_held = 0
        for pdf in batches:
            for s, theta in sides:
                rows, dx, dz, codes = s.rows(pdf)
                if not len(rows):
                    continue
                ll, g, h = s.derivatives(rows, dx, dz, codes, theta, True)
                h = -h
                one, zero = total[s.k], np.zeros(len(rows), np.int64)
                one[0] += ll.sum()
                one[1][s.lx.start:s.lx.stop] += s.lx.sums(dx, codes, g[:, 0], zero, 1)[0]
                one[1][s.lz.start:s.lz.stop] += s.lz.sums(dz, codes, g[:, 1], zero, 1)[0]
                one[1][-1] += g[:, 2].sum()
                info = np.zeros((s.p, s.p))
                _gram(s.lx, dx, s.lx, dx, codes, h[:, 0], info)
                _gram(s.lx, dx, s.lz, dz, codes, h[:, 1], info)
                _gram(s.lz, dz, s.lz, dz, codes, h[:, 3], info)
                info[s.lx.start:s.lx.stop, -1] = s.lx.sums(dx, codes, h[:, 2], zero, 1)[0]
                info[s.lz.start:s.lz.stop, -1] = s.lz.sums(dz, codes, h[:, 4], zero, 1)[0]
                info[-1, -1] = h[:, 5].sum()
                one[2] += info
                if s.wide:
                    names, code = s.by_level(rows)
                    own = np.flatnonzero(code >= 0)
                    n, inv = len(names), code[own]
                    if not n:
                        continue
                    pick = {f: c[own] for f, c in codes.items()}
                    put = lambda w: np.bincount(inv, w[own], n)
                    sel = rows[s.sel].to_numpy(float)
                    cross = [np.column_stack([s.lx.sums(dx[own], pick, h[own, i], inv, n), s.lz.sums(dz[own], pick, h[own, j], inv, n), put(h[:, t])])
                             for i, j, t in ((0, 1, 2), (1, 3, 4))]
                    vals = np.column_stack([put(g[:, 0]), put(g[:, 1]), put(h[:, 0]), put(h[:, 1]), put(h[:, 3]), put(sel), put(np.ones(len(rows))), *cross])
                    at = np.zeros(n, np.int64)
                    at[inv] = own
                    a, b = (e[at] for e in s.effects(rows))
                    held.append(pd.DataFrame({"key": pd.util.hash_array(names, categorize=False).view("int64"), "spec": s.k, "level": names, "a": a, "b": b, "vals": list(vals)}))
                    n_held += n
            if n_held > 4096:
                yield _added(held)
                held, n_held = [], 0
        if held:
            yield _added(held)
        for k, (ll, grad, info) in total.items():
            vals = np.concatenate([[ll], grad, info[np.triu_indices(len(grad))]])
            yield pd.DataFrame({"key": [TaskContext.get().partitionId()], "spec": [k], "level": [None], "a": [0.0], "b": [0.0], "vals": [vals]})
    return run


def _added(held: list[pd.DataFrame]) -> pd.DataFrame:
    """Rows of equal specification and level added up."""
    d = pd.concat(held, ignore_index=True).sort_values(["spec", "level"], kind="stable")
    first = np.flatnonzero((d["spec"].to_numpy()[1:] != d["spec"].to_numpy()[:-1]) | (d["level"].to_numpy()[1:] != d["level"].to_numpy()[:-1])) + 1
    start = np.concatenate([[0], first])
    out = d.iloc[start].copy()
    width = d["vals"].map(len).to_numpy()[start]
    if len(set(width)) == 1:
        out["vals"] = list(np.add.reduceat(np.vstack(d["vals"].to_list()), start, axis=0))
    else:  # specifications with different numbers of parameters
        out["vals"] = [np.sum(d["vals"].iloc[i:j].to_list(), axis=0) for i, j in zip(start, np.append(start[1:], len(d)))]
    return out


PROBIT_INFORMATION = 2 / math.pi  # of one row at the start, where both indices are zero
TIE = 1e-9                        # least share of the start's information that identifies an effect


def _blocks(vals: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inverse blocks n x 2 x 2, their products with the gradient n x 2, and with the cross block n x 2 x p).

    Directions without information are left out; where the likelihood curves the wrong way the sign is turned, so steps go uphill.
    """
    n = len(vals)
    scale = np.sqrt(np.maximum(vals[:, 5:7] * PROBIT_INFORMATION, np.finfo(float).tiny))
    d = np.empty((n, 2, 2))
    d[:, 0, 0], d[:, 0, 1], d[:, 1, 0], d[:, 1, 1] = vals[:, 2], vals[:, 3], vals[:, 3], vals[:, 4]
    e, q = np.linalg.eigh(d / scale[:, :, None] / scale[:, None, :])
    with np.errstate(divide="ignore"):
        inv = np.where(np.abs(e) > TIE, 1 / np.abs(e), 0.0)
    inverse = (q * inv[:, None, :]) @ q.transpose(0, 2, 1) / scale[:, :, None] / scale[:, None, :]
    cross = vals[:, 7:].reshape(n, 2, p)
    return inverse, np.einsum("nij,nj->ni", inverse, vals[:, :2]), inverse @ cross


def _width(p: int) -> int:
    return 2 + 2 * p + p * (p + 1) // 2


def _diagonal(p: int) -> np.ndarray:
    """Where the diagonal lies in the upper triangle written row by row."""
    i = np.arange(p)
    return i * p - i * (i - 1) // 2


def _merge(sizes: dict[int, int]):
    """Adds up rows of equal (spec, level), which come sorted; takes the levels out of the other sums.

    Out: (spec, level, a, b, vals) with vals = inverse block (3), own step (2), block^-1 x cross block; and without a level
    the log-likelihood, the reduced gradient and information, the levels' share of the step's gain, and the information's
    diagonal before the levels were taken out.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        last = None

        def reduce(d: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for k, part in d.groupby("spec"):
                p = sizes[k]
                vals = np.vstack(part["vals"].to_list())
                inverse, own, slope = _blocks(vals, p)
                cross = vals[:, 7:].reshape(len(vals), 2, p)
                out = total.setdefault(k, np.zeros(_width(p)))
                out[1:1 + p] -= np.einsum("nip,ni->p", cross, own)
                out[1 + p:-1 - p] -= np.einsum("nip,niq->pq", cross, slope)[np.triu_indices(p)]
                out[-1 - p] += (own * vals[:, :2]).sum()
                packed = np.column_stack([inverse[:, 0, 0], inverse[:, 0, 1], inverse[:, 1, 1], own, slope.reshape(len(vals), -1)])
                yield pd.DataFrame({"spec": k, "level": part["level"], "a": part["a"], "b": part["b"], "vals": list(packed)})

        for pdf in batches:
            none = pdf["level"].isna().to_numpy()
            for k, v in zip(pdf.loc[none, "spec"], pdf.loc[none, "vals"]):
                p = sizes[k]
                out = total.setdefault(k, np.zeros(_width(p)))
                out[:len(v)] += v
                out[-p:] += v[1 + p:][_diagonal(p)]
            d = pdf[~none]
            if not len(d):
                continue
            d = _added([d] if last is None else [last, d])
            last = d.iloc[-1:]
            yield from reduce(d.iloc[:-1])
        if last is not None:
            yield from reduce(last)
        for k, v in total.items():
            yield pd.DataFrame({"spec": [k], "level": [None], "a": [0.0], "b": [0.0], "vals": [v]})
    return run


PART = "key long, spec int, level string, a double, b double, vals array<double>"
MERGED = "spec int, level string, a double, b double, vals array<double>"


class _Search:
    """Newton steps of one specification."""

    def __init__(self, side: _Side, base_levels: list[int], tol: float, max_iter: int):
        self.side, self.tol, self.left = side, tol, max_iter
        self.theta = self.trial = np.zeros(side.p)
        self.free = np.array([i for i in range(side.p) if i not in base_levels])
        self.ll, self.joint, self.size, self.step = -math.inf, False, 1.0, np.zeros(side.p)
        self.scale = self.table = None
        self.converged = self.done = False

    def identified(self, idx: np.ndarray) -> np.ndarray:
        """Those of the parameters that add to the others, the constants first."""
        cons = [lay.start + len(lay.cols) for lay in (self.side.lx, self.side.lz)]
        idx = np.array([*cons, *[i for i in idx if i not in cons]])
        return np.sort(idx[independent(self.info[np.ix_(idx, idx)], self.scale[idx], tol=TIE)])

    def effects(self) -> DataFrame | None:
        """(level, a, b) of the trial."""
        if not self.side.wide or self.table is None:
            return None
        p = self.side.p
        step = F.array(*[F.lit(float(v)) for v in self.step])
        own = lambda at, first: F.element_at("vals", at) - F.aggregate(
            F.zip_with(F.slice("vals", first, p), step, lambda u, v: u * v), F.lit(0.0), lambda u, v: u + v)
        return (self.table.where((F.col("spec") == self.side.k) & F.col("level").isNotNull())
                .select("level", (F.col("a") + self.size * own(4, 6)).alias(f"_a{self.side.k}"), (F.col("b") + self.size * own(5, 6 + p)).alias(f"_b{self.side.k}")))

    def take(self, table: DataFrame, sums: np.ndarray) -> None:
        """Accept or shorten the trial, given its sums; then the next step."""
        p = self.side.p
        if sums[0] <= self.ll - 1e-12 or not np.isfinite(sums[0]):
            self.size /= 2
            self.done = self.size < 1e-6  # no step in this direction is uphill: the search ends without a gain below tol
            self.trial = self.theta + self.size * self.step
            return
        info = np.zeros((p, p))
        info[np.triu_indices(p)] = sums[1 + p:-1 - p]
        self.info = info + np.triu(info, 1).T
        self.theta, self.ll, self.table, self.grad = self.trial, sums[0], table, sums[1:1 + p]
        if self.scale is None:
            # at zero the two probits are apart, and their information is the weighted cross products of the columns
            self.scale = sums[-p:]
            self.free = np.append(self.identified(self.free[:-1]), p - 1)
        while True:
            idx = self.free if self.joint else self.free[self.free != p - 1]
            a = self.info[np.ix_(idx, idx)]
            low = np.linalg.eigvalsh(a)[0]
            part = np.linalg.solve(a + (1e-6 - low if low <= 1e-10 else 0.0) * np.eye(len(idx)), self.grad[idx])
            self.step = np.zeros(p)
            self.step[idx] = part
            self.left -= 1
            self.converged = float(part @ self.grad[idx]) + sums[-1 - p] < self.tol
            if self.converged and not self.joint:
                self.joint = True
                continue
            break
        self.done = self.converged or self.left <= 0
        self.size = min(1.0, 0.5 / abs(part[-1])) if self.joint and abs(part[-1]) > 0.5 else 1.0
        self.trial = self.theta + self.size * self.step


def fit_selections(df: DataFrame, specs: list[Spec], tol: float = 1e-8, max_iter: int = 60) -> list[Model]:
    """Maximum likelihood of each specification, with factors in both equations and cluster-robust covariance.

    Columns are centred and scaled for the search. The two probits at zero correlation come first; then the correlation (by
    its inverse hyperbolic tangent) is freed. Parameters that the data do not identify (collinear columns, levels without
    variation) are marked in `omitted` and have no error; `converged` in the statistics says whether the last step gained less
    than `tol`. The first level of a factor is its base.
    """
    spark = df.sparkSession
    d, names = df, []
    for k, s in enumerate(specs):
        own = {}
        for col, cond, value in s.update:
            own.setdefault(col, f"_u{k}_{col}")
        d0 = d.withColumns({new: F.col(c) for c, new in own.items()})
        d = conditional_update(d0, [(own[c], cond, value) for c, cond, value in s.update]) if s.update else d0
        names.append({c: own.get(c, c) for c in [s.y, s.select, *s.x, *s.z, *s.factors]})
    masks = {f"_m{k}": usable(n[s.y], [n[c] for c in s.x], n[s.select], [n[c] for c in s.z], [n[f] for f in s.factors], s.where)
             for k, (s, n) in enumerate(zip(specs, names))}
    cols = sorted({n[c] for s, n in zip(specs, names) for c in [*s.x, *s.z]})
    seen = sorted({n[c] for s, n in zip(specs, names) for c in (s.y, s.select)})
    factors = sorted({n[f] for s, n in zip(specs, names) for f in s.factors})
    clusters = sorted({s.cluster for s in specs if s.cluster})
    d = d.select(*[m.alias(c) for c, m in masks.items()], *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*cols, *seen])],
                 *[F.col(f).alias(f"_f_{f}") for f in factors], *[F.col(c).alias(f"_g_{c}") for c in clusters])
    d = cut_lineage(d.where(" OR ".join(masks)))

    aggs = [F.count_distinct(f"_f_{f}").alias(f"n_{f}") for f in factors]
    for k in range(len(specs)):
        at = F.col(f"_m{k}")
        aggs += [F.count(F.when(at, 1)).alias(f"n{k}")]
        aggs += [e for c in cols for e in (F.avg(F.when(at, F.col(c))).alias(f"m{k}_{c}"), F.stddev_samp(F.when(at, F.col(c))).alias(f"s{k}_{c}"))]
        aggs += [F.min(F.when(at, F.col(f"_f_{f}"))).cast("string").alias(f"b{k}_{f}") for f in factors]
    top = d.agg(*aggs).first()
    wide = [max((n[f] for f in s.factors), key=lambda f: (top[f"n_{f}"], f), default=None) for s, n in zip(specs, names)]
    levels: dict[str, list] = {}
    for f in factors:
        if any(f in [n[g] for g in s.factors] and f != w for s, n, w in zip(specs, names, wide)):
            levels[f] = sorted(r[0] for r in d.select(f"_f_{f}").dropna().distinct().collect())
            code = spark.createDataFrame([(lv, i) for i, lv in enumerate(levels[f])], f"_f_{f} {dict(d.dtypes)[f'_f_{f}']}, _c_{f} int")
            d = d.join(code, f"_f_{f}", "left").withColumn(f"_c_{f}", F.coalesce(f"_c_{f}", F.lit(0)))
    d = d.withColumns({f"_f_{f}": F.col(f"_f_{f}").cast("string") for f in factors})
    if any(wide):
        # rows of a level lie together, in several files if they are many
        order = [F.col(f"_f_{f}") for f in dict.fromkeys(w for w in wide if w)]
        d = d.repartitionByRange(*order, F.xxhash64(*d.columns)).sortWithinPartitions(*order)
    data = cut_lineage(d)

    searches = []
    for k, (s, n, w) in enumerate(zip(specs, names, wide)):
        small = {n[f]: len(levels[n[f]]) for f in s.factors if n[f] != w}
        mean = {c: top[f"m{k}_{c}"] or 0.0 for c in cols}
        sd = {c: top[f"s{k}_{c}"] or 1.0 for c in cols}
        side = _Side(k, [n[c] for c in s.x], [n[c] for c in s.z], n[s.y], n[s.select], small, w, w and top[f"b{k}_{w}"], mean, sd, s.cluster)
        base = [lay.at[f][0] + levels[f].index(_first(levels[f], top[f"b{k}_{f}"])) for lay in (side.lx, side.lz) for f in small]
        searches.append(_Search(side, base, tol, max_iter))
    while open_ := [s for s in searches if not s.done]:
        table, sums = _evaluate(data, open_)
        before = {id(s.table): s.table for s in open_ if s.table is not None}
        for s in open_:
            s.take(table, sums[s.side.k])
        now = {id(s.table) for s in searches}
        release(*[t for i, t in before.items() if i not in now], *([table] if id(table) not in now else []))
    return [_finished(data, s, specs[k], names[k], levels, top) for k, s in enumerate(searches)]


def _first(levels: list, text: str | None):
    return next((lv for lv in levels if str(lv) == text), levels[0])


def _with_effects(data: DataFrame, searches: list[_Search], extra=None) -> DataFrame:
    """Rows next to the effects of their levels; the tables of one factor are put side by side first."""
    by: dict[str, list[DataFrame]] = {}
    for s in searches:
        eff = (extra or _Search.effects)(s)
        if eff is not None:
            by.setdefault(s.side.wide, []).append(eff)
    for f, tables in by.items():
        one = tables[0]
        for t in tables[1:]:
            one = one.join(t, "level", "full_outer")
        data = data.join(one.withColumnRenamed("level", f"_f_{f}"), f"_f_{f}", "left")
    missing = [f"_{e}{s.side.k}" for s in searches if s.side.wide for e in "ab"]
    return data.withColumns({c: F.lit(0.0) for c in missing if c not in data.columns})


def _evaluate(data: DataFrame, searches: list[_Search]) -> tuple[DataFrame, dict[int, np.ndarray]]:
    sizes = {s.side.k: s.side.p for s in searches}
    parts = _with_effects(data, searches).mapInPandas(_partials([(s.side, s.trial) for s in searches]), PART)
    table = cut_lineage(parts.repartition("key").sortWithinPartitions("spec", "level").mapInPandas(_merge(sizes), MERGED))
    sums: dict[int, np.ndarray] = {}
    for r in table.where("level IS NULL").select("spec", "vals").collect():
        sums[r["spec"]] = sums.get(r["spec"], 0.0) + np.array(r["vals"])
    return table, sums


def _scores(side: _Side, theta: np.ndarray):
    """Per batch (kind 0, cluster, vals): score sums, levels taken out; (kind 1, cluster, level, vals): score sums of the effects."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, dx, dz, codes = side.rows(pdf)
            if not len(rows):
                continue
            _, g, _ = side.derivatives(rows, dx, dz, codes, theta, False)
            who, names = pd.factorize(rows[f"_g_{side.cluster}"], use_na_sentinel=False)
            n = len(names)
            t = np.column_stack([side.lx.sums(dx, codes, g[:, 0], who, n), side.lz.sums(dz, codes, g[:, 1], who, n), np.bincount(who, g[:, 2], n)])
            if side.wide:
                has = rows["_slope"].notna().to_numpy()
                if has.any():
                    slope = np.vstack(rows["_slope"][has].to_list()).reshape(-1, 2, side.p)
                    less = np.einsum("nip,ni->np", slope, g[has, :2])
                    np.subtract.at(t, who[has], less)
                code, levels = pd.factorize(rows[f"_f_{side.wide}"])
                cell, inv = np.unique(who[has].astype(np.int64) * len(levels) + code[has], return_inverse=True)
                if len(cell):
                    vals = np.column_stack([np.bincount(inv, g[has, 0]), np.bincount(inv, g[has, 1])])
                    yield pd.DataFrame({"kind": 1, "cluster": np.asarray(names)[cell // len(levels)], "level": np.asarray(levels)[cell % len(levels)], "vals": list(vals)})
            yield pd.DataFrame({"kind": 0, "cluster": np.asarray(names), "level": None, "vals": list(t)})
    return run


def _add_clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per cluster; rows come sorted by cluster."""
    last = None
    for pdf in batches:
        d = pdf if last is None else pd.concat([last, pdf], ignore_index=True)
        code = pd.factorize(d["cluster"], use_na_sentinel=False)[0]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        out = pd.DataFrame({"cluster": d["cluster"].to_numpy()[start], "vals": list(np.add.reduceat(np.vstack(d["vals"].to_list()), start, axis=0))})
        last = out.iloc[-1:]
        if len(out) > 1:
            yield out.iloc[:-1]
    if last is not None:
        yield last


def _outer_sum(scores: DataFrame, p: int) -> tuple[np.ndarray, int]:
    """Sum over clusters of score outer products, and the number of clusters."""
    upper = np.triu_indices(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, n = np.zeros((p, p)), 0
        for pdf in batches:
            if len(pdf):
                v = np.vstack(pdf["vals"].to_list())
                m += v.T @ v
                n += len(v)
        yield pd.DataFrame({"vals": [np.append(m[upper], n)]})

    total = np.zeros(len(upper[0]) + 1)
    # one row a task; added in a second step so that the driver meets a bounded number
    for r in scores.select("vals").mapInPandas(run, "vals array<double>").repartition(16).mapInPandas(_add_rows, "vals array<double>").collect():
        total += np.array(r[0])
    m = np.zeros((p, p))
    m[upper] = total[:-1]
    return m + np.triu(m, 1).T, int(total[-1])


def _add_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = 0.0
    for pdf in batches:
        if len(pdf):
            total = total + np.sum(pdf["vals"].to_list(), axis=0)
    if not np.isscalar(total):
        yield pd.DataFrame({"vals": [total]})


def _finished(data: DataFrame, s: _Search, spec: Spec, names: dict, levels: dict[str, list], top) -> Model:
    side, p = s.side, s.side.p
    spark = data.sparkSession
    # a coefficient that ran off towards infinity leaves no information behind
    keep = s.identified(s.free)
    bread = inverse_of(s.info, list(keep))
    cov, scores, cells, n_cl = bread, None, None, 0
    mine = s.table.where((F.col("spec") == side.k) & F.col("level").isNotNull())
    if spec.cluster:
        at = _Search.effects
        s.step = np.zeros(p)
        s.size = 0.0

        def final(search):
            eff = at(search)
            return None if eff is None else eff.join(mine.select("level", F.slice("vals", 6, 2 * p).alias("_slope")), "level")

        kind = dict(data.dtypes)[f"_g_{spec.cluster}"]
        each = cut_lineage(_with_effects(data, [s], final).mapInPandas(_scores(side, s.theta), f"kind int, cluster {kind}, level string, vals array<double>"))
        scores = cut_lineage(each.where("kind = 0").select("cluster", "vals").repartition("cluster").sortWithinPartitions("cluster")
                             .mapInPandas(_add_clusters, f"cluster {kind}, vals array<double>"))
        if side.wide:
            cells = cut_lineage(each.where("kind = 1").groupBy("cluster", "level").agg(
                F.sum(F.element_at("vals", 1)).alias("g0"), F.sum(F.element_at("vals", 2)).alias("g1")))
        release(each)
        meat, n_cl = _outer_sum(scores, p)
        if n_cl < 2:
            raise ValueError("a cluster covariance needs at least two clusters")
        cov = bread @ meat @ bread * n_cl / (n_cl - 1)

    # back to the columns' own units: value = unit @ theta
    unit = np.eye(p)
    for lay in (side.lx, side.lz):
        cons = lay.start + len(lay.cols)
        for j, c in enumerate(lay.cols):
            unit[lay.start + j, lay.start + j] = 1 / side.sd[c]
            unit[cons, lay.start + j] = -side.mean[c] / side.sd[c]
    back = {v: k for k, v in names.items()}
    labels: list[tuple] = []
    for eq, lay in ((OUT, side.lx), (SEL, side.lz)):
        labels += [(eq, back[c], None) for c in lay.cols] + [(eq, "_cons", None)]
        for f in lay.at:
            labels += [(eq, back[f], lv) for lv in levels[f]]
    labels.append(("athrho", "athrho", None))
    own = unit @ s.theta
    wide = None
    if side.wide:
        base = spark.createDataFrame([(side.base, 0.0, 0.0)], "level string, out double, sel double")
        eff = cut_lineage(mine.select("level", F.col("a").alias("out"), F.col("b").alias("sel")).unionByName(base))
        parts = mine.select("level", F.concat(F.slice("vals", 1, 3), F.slice("vals", 6, 2 * p)).alias("vals"))
        wide = Wide(back[side.wide], eff, parts, cells)
    size = data.where(f"_m{side.k}").agg(F.count("*"), F.sum(side.sel)).first()
    base = {lay.at[f][0] + levels[f].index(_first(levels[f], top[f"b{side.k}_{f}"])) for lay in (side.lx, side.lz) for f in lay.at}
    return Model(list(spec.x), list(spec.z), {back[f]: levels[f] for f in side.lx.at}, {nm: float(v) for nm, v in zip(labels[:-1], own[:-1])},
                 float(s.theta[-1]), labels, unit @ cov @ unit.T, wide, unit, bread, scores,
                 {"n": size[0], "selected": int(size[1]), "loglik": s.ll, "clusters": n_cl, "converged": float(s.converged)},
                 {i for i in range(p) if i not in base and i not in keep})


def selection_probit(df: DataFrame, y: str, x: list[str], select: str, z: list[str], factors: list[str] | None = None,
                     cluster: str | None = None, where: Column | None = None, tol: float = 1e-8, max_iter: int = 60) -> Model:
    """One specification; see `fit_selections`."""
    return fit_selections(df, [Spec(y, x, select, z, list(factors or []), cluster, where)], tol, max_iter)[0]


# ---- effects of the factor in the table ----------------------------------------

def _unpacked(vals, p: int) -> tuple[np.ndarray, np.ndarray]:
    v = np.vstack(vals)
    inverse = np.empty((len(v), 2, 2))
    inverse[:, 0, 0], inverse[:, 0, 1], inverse[:, 1, 0], inverse[:, 1, 1] = v[:, 0], v[:, 1], v[:, 1], v[:, 2]
    return inverse, v[:, 3:].reshape(len(v), 2, p)


def level_table(model: Model) -> DataFrame:
    """(level, out, sel, se_out, se_sel) of the factor kept in a table; errors by cluster if the fit has clusters.

    The base has zero effects and errors; an effect without information has no error.
    """
    w, p, bread = model.wide, len(model.bread), model.bread
    n_cl = model.stats["clusters"]
    meat = None if w.cells is None else _outer_sum(model.scores, p)[0]
    core = bread if meat is None else bread @ meat @ bread

    def base(batches):
        for pdf in batches:
            inverse, slope = _unpacked(pdf["vals"], p)
            var = np.einsum("nip,pq,niq->ni", slope, core, slope)
            if meat is None:
                var = var + np.stack([inverse[:, 0, 0], inverse[:, 1, 1]], axis=1)
            known = np.stack([inverse[:, 0, 0], inverse[:, 1, 1]], axis=1) > 0
            yield pd.DataFrame({"level": pdf["level"], "v0": np.where(known[:, 0], var[:, 0], np.nan), "v1": np.where(known[:, 1], var[:, 1], np.nan)})

    def cell(batches):
        for pdf in batches:
            inverse, slope = _unpacked(pdf["vals"], p)
            x = np.einsum("nij,nj->ni", inverse, pdf[["g0", "g1"]].to_numpy())
            t = np.vstack(pdf["t"].to_list()) @ bread
            var = x * x - 2 * x * np.einsum("nip,np->ni", slope, t)
            yield pd.DataFrame({"level": pdf["level"], "v0": var[:, 0], "v1": var[:, 1]})

    var = w.parts.mapInPandas(base, "level string, v0 double, v1 double")
    if meat is not None:
        more = (w.cells.join(w.parts, "level").join(model.scores.select("cluster", F.col("vals").alias("t")), "cluster")
                .select("level", "g0", "g1", "vals", "t").mapInPandas(cell, "level string, v0 double, v1 double"))
        var = var.unionByName(more)
    scale = n_cl / (n_cl - 1) if meat is not None else 1.0
    var = var.groupBy("level").agg(*[F.sqrt(F.sum(c) * scale).alias(e) for c, e in (("v0", "se_out"), ("v1", "se_sel"))])
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    return (w.effects.join(var, "level", "left")
            .select("level", "out", "sel", F.coalesce(real("se_out"), F.when(F.col("se_out").isNull(), 0.0)).alias("se_out"),
                    F.coalesce(real("se_sel"), F.when(F.col("se_sel").isNull(), 0.0)).alias("se_sel")))


def variances(model: Model, grads: np.ndarray, level_grads: DataFrame | None, mean_parts: DataFrame | None = None) -> np.ndarray:
    """Variance of several functions of the parameters, from their gradients.

    grads: functions x parameters, in own units; level_grads: (level, i, j0, j1), the gradient of function i in the effects of
    a level; mean_parts: (cluster, i, m), what a cluster adds to function i besides the parameters. With clusters the
    variance is the sum of squared cluster influences.
    """
    k, p = grads.shape
    j = grads @ model.unit
    own = None
    if model.wide is not None and level_grads is not None:
        def reduce(batches):
            total = np.zeros((k, p + 1))
            for pdf in batches:
                if len(pdf):
                    inverse, slope = _unpacked(pdf["vals"], p)
                    g = pdf[["j0", "j1"]].to_numpy()
                    np.add.at(total, pdf["i"].to_numpy(), np.column_stack([np.einsum("nip,ni->np", slope, g), np.einsum("ni,nij,nj->n", g, inverse, g)]))
            yield pd.DataFrame({"vals": [total.ravel()]})

        both = level_grads.join(model.wide.parts, "level")
        total = np.zeros(k * (p + 1))
        for r in both.mapInPandas(reduce, "vals array<double>").repartition(16).mapInPandas(_add_rows, "vals array<double>").collect():
            total += np.array(r[0])
        total = total.reshape(k, p + 1)
        j, own = j - total[:, :p], total[:, p]
    w = j @ model.bread
    if model.scores is None:
        return np.einsum("kp,kp->k", w, j) + (0.0 if own is None else own)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(v)) for v in row]).alias("w")) for i, row in enumerate(w)])
    dot = F.aggregate(F.zip_with("vals", "w", lambda u, v: u * v), F.lit(0.0), lambda u, v: u + v)
    psi = model.scores.select("cluster", "vals", F.inline(cells)).select("cluster", "i", dot.alias("m"))
    if own is not None:
        inverse = [F.element_at("vals", n) for n in (1, 2, 3)]
        solved = both.select("level", "i", (inverse[0] * F.col("j0") + inverse[1] * F.col("j1")).alias("y0"), (inverse[1] * F.col("j0") + inverse[2] * F.col("j1")).alias("y1"))
        psi = psi.unionByName(model.wide.cells.join(solved, "level").select("cluster", "i", (F.col("g0") * F.col("y0") + F.col("g1") * F.col("y1")).alias("m")))
    if mean_parts is not None:
        psi = psi.unionByName(mean_parts)
    out = np.zeros(k)
    rows = psi.groupBy("cluster", "i").agg(F.sum("m").alias("m")).groupBy("i").agg(F.sum(F.col("m") * F.col("m")).alias("s"), F.count("*").alias("g")).collect()
    for r in rows:
        out[r["i"]] = r["s"] * r["g"] / (r["g"] - 1)
    return out
