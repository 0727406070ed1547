"""Quantities of a selection model: averages over rows, on grids, with standard errors.

Each quantity is the mean of a row expression of both indices, the correlation and a few coefficients. Where errors are
asked for, the derivatives in all of these are carried along as columns (forward mode), so one pass over the rows gives the
mean and its gradient. Grids are generated inside the tasks and reduced by partial aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable
import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.normal import log_norm_cdf, norm_cdf, norm_hazard, norm_inv, np_inv
from panelspark.operators.keys import cut_lineage, release
from panelspark.operators.linear import Fit
from panelspark.operators.selection import LOG_ROOT_2PI, OUT, SEL, Model, Spec, fit_selections, index_columns, log_joint_column, selection_predict, variances
from panelspark.operators.stats import corr, kde_grid

RHO = ("athrho", "athrho", None)
MOVE = "covariate"
NORMAL_975 = 1.959963984540054


class Dual:
    """A value with its derivatives by name; both are columns, numbers or, for derivatives of derivatives, pairs of a lower level."""

    def __init__(self, v, d: dict, level: int = 0):
        self.v, self.d, self.level = v, d, level

    def __neg__(self):
        return Dual(-self.v, {k: -x for k, x in self.d.items()}, self.level)

    def __add__(self, o):
        return add(self, o)

    def __radd__(self, o):
        return add(o, self)

    def __sub__(self, o):
        return sub(self, o)

    def __rsub__(self, o):
        return sub(o, self)

    def __mul__(self, o):
        return mul(self, o)

    def __rmul__(self, o):
        return mul(o, self)

    def __truediv__(self, o):
        return divide(self, o)

    def __rtruediv__(self, o):
        return divide(o, self)


def _level(x) -> int:
    return x.level if isinstance(x, Dual) else -1


def _parts(x, level: int):
    """Value and derivatives at a level; what is of a lower one is a constant there."""
    return (x.v, x.d) if _level(x) == level else (x, {})


def _sum(a: dict, b: dict) -> dict:
    return a | {k: add(a[k], y) if k in a else y for k, y in b.items()}


def add(a, b):
    n = max(_level(a), _level(b))
    if n < 0:
        return a + b
    (v, c), (w, d) = _parts(a, n), _parts(b, n)
    return Dual(add(v, w), _sum(c, d), n)


def sub(a, b):
    return add(a, -b)


def mul(a, b):
    n = max(_level(a), _level(b))
    if n < 0:
        return a * b
    (v, c), (w, d) = _parts(a, n), _parts(b, n)
    return Dual(mul(v, w), _sum({k: mul(x, w) for k, x in c.items()}, {k: mul(v, y) for k, y in d.items()}), n)


def divide(a, b):
    """a / b, missing where b is zero."""
    n = max(_level(a), _level(b))
    if n < 0:
        return F.try_divide(_col(a), _col(b)) if isinstance(a, Column) or isinstance(b, Column) else a / b
    (v, c), (w, d) = _parts(a, n), _parts(b, n)
    q = divide(v, w)
    return Dual(q, _sum({k: divide(x, w) for k, x in c.items()}, {k: -divide(mul(q, y), w) for k, y in d.items()}), n)


def _open(o):
    return (o.v, o.d) if isinstance(o, Dual) else (o, {})


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


class Ctx:
    """What a row expression may use: both indices, the correlation, a grid value, coefficients, and functions of them.

    `let` stores an intermediate as a column of the frame being built, so that a formula that uses it many times stays
    small. With `errors`, values carry their derivatives in xb, zg, athrho and every coefficient the expression asked for.
    """

    def __init__(self, df: DataFrame, model: Model, xb="_xb", zg="_zg", u="_u", q="_q", errors: bool = False):
        self.df, self.model, self.errors = df, model, errors
        self.stored: dict[int, tuple[str, Column]] = {}  # columns of the frame by their object
        self.made: dict = {}                             # functions by name and arguments, so that none is computed twice
        mark = (lambda v, k: Dual(v, {k: 1.0})) if errors else (lambda v, k: v)
        self.xb, self.zg, self.u, self.q = mark(self._ref(xb), "xb"), mark(self._ref(zg), "zg"), F.col(u), F.col(q)
        rho = math.tanh(model.athrho)
        self.rho = Dual(rho, {RHO: 1 - rho * rho}) if errors else rho
        root = math.sqrt(1 - rho * rho)
        self.root = Dual(root, {RHO: -rho * (1 - rho * rho) / root}) if errors else root

    def let(self, *cols: Column) -> list[str]:
        """Names of new columns that hold the given values."""
        n = len(self.df.columns)
        names = [f"_l{n + i}" for i in range(len(cols))]
        self.df = self.df.withColumns(dict(zip(names, cols)))
        return names

    def _ref(self, name: str) -> Column:
        c = F.col(name)
        self.stored[id(c)] = (name, c)
        return c

    def _name(self, x: Column) -> str:
        return self.stored[id(x)][0] if id(x) in self.stored else self.let(x)[0]

    def _key(self, x):
        """What identifies a value whose parts are columns of the frame; None for others."""
        if isinstance(x, Dual):
            parts = [self._key(x.v), *[(str(k), self._key(d)) for k, d in x.d.items()]]
            return None if parts[0] is None or any(p[1] is None for p in parts[1:]) else (x.level, parts[0], tuple(sorted(parts[1:])).__str__())
        if isinstance(x, Column):
            return self.stored[id(x)][0] if id(x) in self.stored else None
        return float(x)

    def _once(self, what: str, args: tuple, make):
        key = (what, *map(self._key, args))
        if None in key:
            return make()
        if key not in self.made:
            self.made[key] = self.keep(make())
        return self.made[key]

    def keep(self, x):
        """The same value with its parts stored as columns; numbers and what is stored stay as they are."""
        parts: dict[int, Column] = {}

        def gather(v):
            if isinstance(v, Dual):
                gather(v.v)
                for d in v.d.values():
                    gather(d)
            elif isinstance(v, Column) and id(v) not in self.stored:
                parts[id(v)] = v

        gather(x)
        new = {k: self._ref(n) for k, n in zip(parts, self.let(*parts.values()))} if parts else {}
        back = lambda v: Dual(back(v.v), {k: back(d) for k, d in v.d.items()}, v.level) if isinstance(v, Dual) else new.get(id(v), v)
        return back(x)

    def coef(self, eq: str, term: str):
        v = self.model.get(eq, term)
        return Dual(v, {(eq, term, None): 1.0}) if self.errors and (eq, term, None) in self.model.coef else v

    def _known(self, x, value, s):
        """A function of x: its value, and its slope times the derivatives of x."""
        return Dual(value, {k: mul(s, d) for k, d in x.d.items()}, x.level)

    def exp(self, x):
        if not isinstance(x, Dual):
            return F.exp(_col(x))
        e = self.keep(self.exp(x.v))
        return self._known(x, e, e)

    def pdf(self, x):
        x = self.keep(x)
        return self._once("pdf", (x,), lambda: mul(self.exp(mul(mul(x, x), -0.5)), 1 / math.sqrt(2 * math.pi)))

    def cdf(self, x):
        x = self.keep(x)
        if not isinstance(x, Dual):
            return self._once("cdf", (x,), lambda: norm_cdf(self._name(_col(x))))
        return self._once("cdf", (x,), lambda: self._known(x, self.cdf(x.v), self.pdf(x.v)))

    def inv(self, p):
        p = self.keep(p)
        if not isinstance(p, Dual):
            return norm_inv(self._name(_col(p)))
        v = self.keep(self.inv(p.v))
        return self._known(p, v, self.keep(divide(1.0, self.pdf(v))))

    def log_cdf(self, x):
        x = self.keep(x)
        if not isinstance(x, Dual):
            return self._once("log_cdf", (x,), lambda: log_norm_cdf(self._name(_col(x))))
        return self._once("log_cdf", (x,), lambda: self._known(x, self.log_cdf(x.v), self.hazard(x.v)))

    def hazard(self, x):
        """Density over distribution function, the derivative of `log_cdf`."""
        x = self.keep(x)
        if not isinstance(x, Dual):
            return self._once("hazard", (x,), lambda: norm_hazard(self._name(_col(x))))
        h = self.hazard(x.v)
        return self._once("hazard", (x,), lambda: self._known(x, h, self.keep(mul(-h, add(x.v, h)))))

    def log_joint(self, x, z, r):
        """log P(X <= x, Y <= z) at correlation r, a number with or without derivatives; holds where P rounds to zero."""
        x, z = self.keep(x), self.keep(z)
        return self._once("log_joint", (x, z, r), lambda: self._log_joint(x, z, r))

    def _log_joint(self, x, z, r):
        n = max(map(_level, (x, z, r)))
        if n < 0:
            return log_joint_column(_col(x), _col(z), float(r))
        (xv, xd), (zv, zd), (rv, rd) = (_parts(v, n) for v in (x, z, r))
        one = sub(1.0, mul(rv, rv))
        root = _root(one)
        log = self.log_joint(xv, zv, rv)
        # each slope over P, from logarithms
        part = lambda v, w: self.keep(self.exp(sub(sub(self.log_cdf(divide(sub(w, mul(rv, v)), root)), mul(mul(v, v), 0.5)), add(log, LOG_ROOT_2PI))))
        sx, sz = part(xv, zv), part(zv, xv)
        square = sub(mul(mul(rv, 2.0), mul(xv, zv)), add(mul(xv, xv), mul(zv, zv)))
        sr = self.keep(mul(self.exp(sub(mul(square, divide(0.5, one)), log)), divide(1 / (2 * math.pi), root)))
        d: dict = {}
        for s, parts in ((sx, xd), (sz, zd), (sr, rd)):
            d = _sum(d, {k: mul(s, v) for k, v in parts.items()})
        return Dual(log, d, n)


def _root(v):
    """Square root of a number that may carry derivatives."""
    if not isinstance(v, Dual):
        return math.sqrt(v)
    r = _root(v.v)
    return Dual(r, {k: mul(d, divide(0.5, r)) for k, d in v.d.items()}, v.level)


Expr = Callable[[Ctx], "Column | Dual"]


def psel(c: Ctx):
    return c.cdf(c.zg)


def pmargin(c: Ctx):
    return c.cdf(c.xb)


def log_pcond(c: Ctx):
    x, z = c.keep(c.xb), c.keep(c.zg)
    return c.keep(sub(c.log_joint(x, z, c.rho), c.log_cdf(z)))


def pcond(c: Ctx):
    return c.exp(log_pcond(c))


def mte(c: Ctx):
    """Outcome probability at unobserved resistance u."""
    return c.cdf((c.xb - c.rho * c.q) / c.root)


def supply(c: Ctx):
    """Selection probability at unobserved outcome risk u."""
    return c.cdf((c.zg + c.rho * c.q) / c.root)


# logarithms of the probabilities: their derivatives hold where the probability rounds to zero
LOGS = {psel: lambda c: c.log_cdf(c.zg), pmargin: lambda c: c.log_cdf(c.xb), pcond: log_pcond,
        mte: lambda c: c.log_cdf((c.xb - c.rho * c.q) / c.root), supply: lambda c: c.log_cdf((c.zg + c.rho * c.q) / c.root)}


def slope(expr: Expr, term: str, elasticity: bool = False) -> Expr:
    """The derivative of one of the probabilities in a covariate, through both indices; or its elasticity."""
    def run(c: Ctx):
        xb, zg = c.xb, c.zg
        c.xb, c.zg = Dual(xb, {MOVE: c.coef(OUT, term)}, 1), Dual(zg, {MOVE: c.coef(SEL, term)}, 1)
        e = c.keep((LOGS[expr] if elasticity else expr)(c))
        c.xb, c.zg = xb, zg
        return mul(e.d[MOVE], F.col(term)) if elasticity else e.d[MOVE]
    return run


def _spread(df: DataFrame, grid: list[float]) -> DataFrame:
    """Rows by grid values: `_u` and its normal quantile `_q`."""
    pts = [(float(v), np_inv(v) if 0 < v < 1 else None) for v in grid]
    g = F.explode(F.array(*[F.struct(F.lit(v).alias("u"), F.lit(q).cast("double").alias("q")) for v, q in pts]))
    return df.withColumn("_g", g).withColumns({"_u": F.col("_g.u"), "_q": F.col("_g.q")}).drop("_g")


def margins(df: DataFrame, model: Model, expr: Expr, grid: list[float] | None = None, at: str | None = None,
            where: Column | None = None, vce: str = "delta", cluster: str | None = None,
            nodes: list[tuple[float, float]] | None = None) -> DataFrame:
    """(u, estimate, se, n): the mean of `expr`, per grid value if a grid is given.

    `at` sets a covariate to the grid value in both indices. Standard errors are by the delta method, from the covariance of
    the fit (by cluster if it has clusters); `vce='unconditional'` adds the sampling of rows, by cluster. With `nodes`
    (value, weight) the expression is summed over `_x`, weighted: a row and node make one row of the pass.
    """
    rows = [r[1:] for r in _means(df, model, [expr], grid, at, where, vce, cluster, nodes)]
    out = df.sparkSession.createDataFrame(rows, "_u double, estimate double, se double, n bigint")
    return out.drop("_u") if grid is None else out.withColumnRenamed("_u", "u")


def _means(df: DataFrame, model: Model, exprs: list[Expr], grid=None, at=None, where=None, vce="delta", cluster=None, nodes=None) -> list[tuple]:
    """(number of the expression, u, mean, error, n) of several expressions in one pass."""
    errors = model.cov is not None
    d = _spread(index_columns(df if where is None else df.where(where), model, "_xb", "_zg"), grid if grid is not None else [0.0])
    if at:
        d = d.withColumns({"_xb": F.col("_xb") + (F.col("_u") - F.col(at)) * F.lit(model.get(OUT, at)),
                           "_zg": F.col("_zg") + (F.col("_u") - F.col(at)) * F.lit(model.get(SEL, at))})
        d = d.withColumn(at, F.col("_u"))
    if nodes:
        d = d.withColumn("_n", F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in nodes])))
        d = d.withColumns({"_x": F.col("_n.x"), "_w": F.col("_n.w")}).drop("_n")
    per = len(nodes) if nodes else 1
    weigh = (lambda x: _col(x) * F.col("_w")) if nodes else _col
    c = Ctx(d, model, errors=errors)
    made, keys = {}, []
    for k, expr in enumerate(exprs):
        v, parts = _open(expr(c))
        made[f"_e{k}"] = weigh(v)
        keys.append({key: f"_d{k}_{i}" for i, key in enumerate(parts)})
        made |= {f"_d{k}_{i}": weigh(x) for i, x in enumerate(parts.values())}
    d = c.df.withColumns(made)
    aggs = []
    for k, own in enumerate(keys):
        aggs += [(F.count(f"_e{k}") / per).alias(f"n{k}"), F.sum(f"_e{k}").alias(f"e{k}")]
        for key, cols in (("xb", model.x), ("zg", model.z)):
            if key in own:
                aggs += [F.sum(F.col(own[key]) * F.col(t)).alias(f"{key}{k}_{t}") for t in cols]
        aggs += [F.sum(x).alias(f"s{x}") for x in own.values()]
    ends = [(k, eq, own[key]) for k, own in enumerate(keys) for key, eq in (("xb", OUT), ("zg", SEL)) if key in own]
    # the rows' values cost most, so one pass adds them up by grid value, and by grid value and each factor, wide level and cluster
    dims = {f"_f{i}": F.col(f) for i, f in enumerate(model.levels)} if errors else {}
    if errors and model.wide is not None and ends:
        dims["_level"] = F.col(model.wide.name).cast("string")
    if errors and vce == "unconditional" and model.scores is not None:
        dims["_cluster"] = F.col(cluster)
    sets = [[], *[[x] for x in dims]]
    alone = {x: sum(1 << (len(dims) - 1 - i) for i, y in enumerate(dims) if y != x) for x in [None, *dims]}  # grouping_id of each set
    d = d.withColumns(dims) if dims else d
    cells = cut_lineage(d.groupingSets([["_u", *x] for x in sets], "_u", *dims).agg(F.grouping_id().alias("_set"), *aggs))
    part = lambda x: cells.where(F.col("_set") == alone[x])
    top = sorted(part(None).collect(), key=lambda r: r["_u"])
    cases = [(k, i) for k in range(len(exprs)) for i in range(len(top))]
    if not errors:
        return [(k, float(top[i]["_u"]), top[i][f"e{k}"] / top[i][f"n{k}"] if top[i][f"n{k}"] else None, None, int(top[i][f"n{k}"])) for k, i in cases]
    pos = {n: i for i, n in enumerate(model.names)}
    at_u = {r["_u"]: i for i, r in enumerate(top)}
    grads = np.zeros((len(cases), len(pos)))
    for row, (k, i) in enumerate(cases):
        r, n = top[i], top[i][f"n{k}"] or 1  # without rows there is no mean and no error
        for key, x in keys[k].items():
            total = (r[f"s{x}"] or 0.0) / n
            if key in ("xb", "zg"):
                eq, cols = (OUT, model.x) if key == "xb" else (SEL, model.z)
                grads[row, pos[(eq, "_cons", None)]] += total
                for t in cols:
                    grads[row, pos[(eq, t, None)]] += (r[f"{key}{k}_{t}"] or 0.0) / n
            else:
                grads[row, pos[key]] += total
    for f, name in zip(model.levels, dims):
        for r in part(name).select("_u", name, *[f"s{x}" for _, _, x in ends]).collect():
            i = at_u[r["_u"]]
            for k, eq, x in ends:
                grads[k * len(top) + i, pos[(eq, f, r[name])]] += (r[f"s{x}"] or 0.0) / (top[i][f"n{k}"] or 1)
    number = F.element_at(F.create_map(*[x for u, i in at_u.items() for x in (F.lit(float(u)), F.lit(i))]), F.col("_u"))
    size = [F.element_at(F.create_map(*[x for r in top for x in (F.lit(float(r["_u"])), F.lit(float(r[f"n{k}"] or 1)))]), F.col("_u")) for k in range(len(exprs))]
    by_level = mean = None
    if "_level" in dims:
        half = lambda k, key: F.coalesce(f"s{keys[k][key]}", F.lit(0.0)) / size[k] if key in keys[k] else F.lit(0.0)
        each = F.array(*[F.struct((number + k * len(top)).alias("i"), half(k, "xb").alias("j0"), half(k, "zg").alias("j1")) for k in range(len(exprs))])
        by_level = part("_level").select(F.col("_level").alias("level"), F.inline(each))
    if "_cluster" in dims:
        centre = [F.element_at(F.create_map(*[x for r in top for x in (F.lit(float(r["_u"])), F.lit((r[f"e{k}"] or 0.0) / (r[f"n{k}"] or 1)))]), F.col("_u")) for k in range(len(exprs))]
        each = F.array(*[F.struct((number + k * len(top)).alias("i"), ((F.col(f"e{k}") - F.col(f"n{k}") * centre[k]) / size[k]).alias("m")) for k in range(len(exprs))])
        mean = part("_cluster").select(F.col("_cluster").alias("cluster"), F.inline(each))
    var = variances(model, grads, by_level, mean)
    release(cells)
    mean_of = lambda k, r: r[f"e{k}"] / r[f"n{k}"] if r[f"n{k}"] else None
    return [(k, float(top[i]["_u"]), mean_of(k, top[i]), math.sqrt(max(var[row], 0.0)) if top[i][f"n{k}"] else None, int(top[i][f"n{k}"]))
            for row, (k, i) in enumerate(cases)]


def margins_slopes(df: DataFrame, model: Model, terms: list[str], where: Column | None = None) -> DataFrame:
    """(prediction, term, kind, estimate, se, n): mean derivative and elasticity of both predictions in each term, in one pass a prediction."""
    rows = []
    for name, expr in (("psel", psel), ("pcond", pcond)):
        cells = [(t, kind) for t in terms for kind in ("dydx", "eyex")]
        got = _means(df, model, [slope(expr, t, kind == "eyex") for t, kind in cells], where=where)
        rows += [(name, *cells[k], m, s, n) for k, _, m, s, n in got]
    return df.sparkSession.createDataFrame(rows, "prediction string, term string, kind string, estimate double, se double, n bigint")


def mte_curve(df, model, grid, where=None) -> DataFrame:
    return margins(df, model, mte, grid, where=where)


def labor_supply_curve(df, model, grid, at, where=None) -> DataFrame:
    """Selection probability by quantile of private risk; `at` is set to the grid value too."""
    return margins(df, model, supply, grid, at=at, where=where)


def elasticity_grid(df: DataFrame, model: Model, col: str, grid: list[float], cluster: str | None = None) -> DataFrame:
    """Elasticity of supply in `col` by risk quantile, with the share of rows whose index is above it."""
    m = margins(df, model, slope(supply, col, elasticity=True), grid, vce="unconditional", cluster=cluster)
    pts = F.explode(F.array(*[F.lit(float(v)) for v in grid]))
    share = (index_columns(df, model, "_xb", "_zg").select("_xb", pts.alias("u"))
             .groupBy("u").agg(F.avg((F.col("_xb") >= F.col("u")).cast("int")).alias("share_above")))
    return m.join(share, "u")


def surface_rows(df: DataFrame, model: Model, n_u: int, p_step: float, where: Column | None = None) -> DataFrame:
    """Rows by resistance points above the smallest propensity: (psel, bin, u, mte)."""
    d = selection_predict(df if where is None else df.where(where), model, ["xb", "psel"]).select("xb", "psel")
    low = d.agg(F.min("psel")).scalar()
    d = _spread(d.withColumn("_low", low), [k / (n_u + 1) for k in range(1, n_u + 1)]).where(F.col("_u") > F.col("_low"))
    c = Ctx(d, model, "xb", "xb")
    e = mte(c)
    per = round(1 / p_step)
    return c.df.select("psel", (F.floor(F.col("psel") * per) / per).alias("bin"), F.col("_u").alias("u"), e.alias("mte"))


def mte_surface(df, model, n_u: int = 99, p_step: float = 0.01, where=None) -> DataFrame:
    return surface_rows(df, model, n_u, p_step, where).groupBy("u", "bin").agg(
        (F.avg("mte") * 100).alias("mte_pct"), F.count("*").alias("n"))


def variance_share(df: DataFrame, model: Model, n_u: int = 99, where: Column | None = None) -> DataFrame:
    """R-squared of the effect on u and propensity, jointly and alone, missing if one does not vary; and the analytic share."""
    s = surface_rows(df, model, n_u, 0.01, where)
    r = s.agg(corr("mte", "u").alias("a"), corr("mte", "psel").alias("b"), corr("u", "psel").alias("c"))
    r2 = F.try_divide(F.col("a") ** 2 + F.col("b") ** 2 - F.col("a") * F.col("b") * F.col("c") * 2, 1 - F.col("c") ** 2)
    grid = r.select(r2.alias("r2_both"), (F.col("a") ** 2).alias("r2_u"), (F.col("b") ** 2).alias("r2_p"))
    ix = selection_predict(df if where is None else df.where(where), model, ["xb", "xbsel"])
    seen = F.col("_c") ** 2 * F.col("_v")
    one = ix.agg(corr("xb", "xbsel").alias("_c"), F.var_samp("xb").alias("_v")).select(
        (seen / (seen + model.rho ** 2)).alias("share_observed"), (F.lit(model.rho ** 2) / (seen + model.rho ** 2)).alias("share_private"))
    return grid.withColumns({c: one.select(c).scalar() for c in one.columns})


def bound_integral(df: DataFrame, model: Model, lo: float = 0.01, hi: float = 0.98, step: float = 0.01,
                   where: Column | None = None) -> DataFrame:
    """Integral of the mean effect curve over u by a sum whose last point counts half."""
    k = round((hi - lo) / step) + 1
    us = [round(lo + i * step, 10) for i in range(k)]
    c = Ctx(_spread(index_columns(df if where is None else df.where(where), model, "_xb", "_zg").select("_xb", "_zg"), us), model)
    e = mte(c)
    weight = F.when(F.col("_u") == us[-1], step / 2).otherwise(step)
    return c.df.select(e.alias("_e"), weight.alias("_w")).agg(
        (F.sum(F.col("_e") * F.col("_w")) / (F.count("*") / k)).alias("integral"), (F.count("*") / k).cast("long").alias("n"))


# Five-point Gauss-Hermite rule.
NODES = (-2.02018, -0.958572, 0.0, 0.958572, 2.02018)
NODE_WEIGHTS = (0.0199532, 0.393619, 0.945309, 0.393619, 0.0199532)


def _value_node(c: Ctx, wage: str, p: float, x, hours: float):
    """One node's part of the pay that offsets a small rise p in outcome risk."""
    rate = c.coef(OUT, wage) - c.rho * c.coef(SEL, wage)
    a = c.keep((c.xb - c.rho * x) / c.root)
    gap = (a - c.inv(c.cdf(a) + p)) * c.root
    return divide(mul(gap, -hours / math.pi), rate)


def quadrature_value(df: DataFrame, model: Model, wage: str, ms: list[float], nodes=NODES, weights=NODE_WEIGHTS,
                     where: Column | None = None, hours: float = 8.0) -> DataFrame:
    """(m, wtp, wtp_se, total, total_se, n): mean pay for one avoided event spread over all rows, and times N.

    The value is linear in m, so one pass serves all; the nodes are rows of the pass, which keeps its code small. Rows with a
    node whose raised risk passes 1 have no value and are left out.
    """
    d = df if where is None else df.where(where)
    n = d.count()
    far = max(abs(x) for x in nodes)
    rho, root = math.tanh(model.athrho), math.sqrt(1 - math.tanh(model.athrho) ** 2)

    def expr(c: Ctx):
        # the riskiest node decides for the row
        risk = c.let((_open(c.xb)[0] + abs(rho) * far) / root)[0]
        ok = F.col(c.let(norm_cdf(risk) + 1.0 / n < 1)[0])
        return _where(ok, _value_node(c, wage, 1.0 / n, F.col("_x"), hours))

    r = margins(d, model, expr, nodes=list(zip(nodes, weights)))
    return r.select(F.explode(F.array(*[F.lit(float(m)) for m in ms])).alias("m"), "*").select(
        "m", (F.col("estimate") * F.col("m")).alias("wtp"), (F.col("se") * F.col("m")).alias("wtp_se"),
        (F.col("estimate") * n * F.col("m")).alias("total"), (F.col("se") * n * F.col("m")).alias("total_se"), "n")


def _where(ok: Column, x):
    if isinstance(x, Dual):
        return Dual(_where(ok, x.v), {k: _where(ok, d) for k, d in x.d.items()}, x.level)
    return F.when(ok, _col(x))


def row_values(df: DataFrame, model: Model, wage: str, n: int, out: str = "value", nodes=NODES, weights=NODE_WEIGHTS,
               hours: float = 8.0) -> DataFrame:
    """The value per row, for its density."""
    c = Ctx(index_columns(df, model, "_xb", "_zg"), model)
    total = None
    for x, w in zip(nodes, weights):
        part = F.col(c.let(_value_node(c, wage, 1.0 / n, x, hours) * w)[0])
        total = part if total is None else total + part
    return c.df.withColumn(out, total).select(*df.columns, out)


def value_density(df, model, wage, n, points: int) -> DataFrame:
    return kde_grid(row_values(df, model, wage, n, "value").select("value"), "value", points)


def fe_components(df: DataFrame, model: Model, bars: list[str]) -> DataFrame:
    """Time-constant parts of both indices: variances, correlation, and the joint correlation."""
    part = lambda eq: sum((F.col(c) * F.lit(model.get(eq, c)) for c in bars), F.lit(0.0))
    d = df.select(part(SEL).alias("_w"), part(OUT).alias("_i")).dropna()
    r = d.agg(F.count("*").alias("n"), F.avg("_w").alias("mean_work"), F.var_samp("_w").alias("var_work"),
              F.avg("_i").alias("mean_inj"), F.var_samp("_i").alias("var_inj"), corr("_w", "_i").alias("corr"))
    cov = F.col("corr") * F.sqrt(F.col("var_work") * F.col("var_inj"))
    return r.withColumn("joint_corr", (F.lit(model.rho) + cov) / F.sqrt((1 + F.col("var_work")) * (1 + F.col("var_inj"))))


def lincom_nlcom(model: Model, eq: str, term: str, fn: str = "identity") -> tuple[float, float]:
    """A coefficient, or a smooth function of it, with its delta-method standard error."""
    name = (eq, term, None)
    v = model.athrho if eq == "athrho" else model.coef[name]
    i = model.names.index(name)
    se = math.sqrt(model.cov[i, i])
    value, slope_ = {"identity": (v, 1.0), "tanh": (math.tanh(v), 1 - math.tanh(v) ** 2), "exp": (math.exp(v), math.exp(v))}[fn]
    return value, abs(slope_) * se


def rho_interval(model: Model, q: float = NORMAL_975) -> tuple[float, float]:
    """Interval of the correlation, lower end first."""
    se = lincom_nlcom(model, "athrho", "athrho")[1]
    return math.tanh(model.athrho - q * se), math.tanh(model.athrho + q * se)


def model_sweep(df: DataFrame, specs: list[dict]) -> DataFrame:
    """One result row per specification: instrument, correlation and mean outcome, with errors.

    A spec has name, y, x, select, z, instrument, and optionally factors, cluster, where,
    update (column, condition, value) and average (row filter of the mean). All are fitted together: a Newton
    step reads the rows once.
    """
    models = fit_selections(df, [Spec(s["y"], s["x"], s["select"], s["z"], s.get("factors", []), s.get("cluster"), s.get("where"), s.get("update", []))
                                 for s in specs])
    rows = []
    for s, m in zip(specs, models):
        used = df if s.get("where") is None else df.where(s["where"])
        mean = margins(used.dropna(subset=[*s["x"], *s["z"]]), m, pmargin, where=s.get("average")).first()
        coef, rho = lincom_nlcom(m, SEL, s["instrument"]), lincom_nlcom(m, "athrho", "athrho", "tanh")
        rows.append((s["name"], *map(float, coef), *map(float, rho), float(mean["estimate"]), float(mean["se"]), int(m.stats["n"])))
    return df.sparkSession.createDataFrame(
        rows, "name string, instrument double, se_i double, rho double, se_r double, margin double, se_m double, n bigint")


def selection_table(model: Model, terms: list[str]) -> Fit:
    """The listed terms of both equations, for a model table."""
    keep = [i for i, n in enumerate(model.names) if n[1] in terms or n[0] == "athrho"]
    f = model.fit()
    lo, hi = rho_interval(model)
    return Fit([f.terms[i] for i in keep], f.coef[keep], f.cov[np.ix_(keep, keep)],
               {"n": model.stats["n"], "rho": model.rho, "rho_low": lo, "rho_high": hi})
