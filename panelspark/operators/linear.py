"""Linear estimators: Spark adds up rows, the driver solves a small system.

Factors (division, day, person) are partialled out first, so that only the listed
regressors enter the cross products: coefficients and cluster covariances of those
regressors are the same as with a full set of dummies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.functions.normal import np_cdf
from panelspark.operators.keys import attach, cut_lineage, large, release
from panelspark.operators.components import components
from panelspark.operators.solve import independent, inverse_of

ROUNDS = 50


@dataclass
class Fit:
    """Coefficients with covariance, and scalar results."""
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    stats: dict[str, float] = field(default_factory=dict)
    omitted: set[str] = field(default_factory=set)  # terms that the others explain, coefficient 0

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    def __getitem__(self, term: str) -> float:
        return float(self.coef[self.terms.index(term)])


def model_table(spark: SparkSession, models: dict[str, Fit]) -> DataFrame:
    """Tidy rows (model, term, coef, se, z, p, stars) plus one row per scalar result."""
    rows = []
    for name, m in models.items():
        for t, b, s in zip(m.terms, m.coef, m.se):
            z = float(b / s) if s > 0 else None
            p = None if z is None else float(2 * np_cdf(-abs(z)))
            stars = "omitted" if t in m.omitted else "" if p is None else "*" * sum(p < c for c in (0.1, 0.05, 0.01))
            rows.append((name, t, float(b), float(s), z, p, stars))
        rows += [(name, f"[{k}]", float(v), None, None, None, "") for k, v in m.stats.items()]
    return spark.createDataFrame(rows, "model string, term string, coef double, se double, z double, p double, stars string")


def cross_products(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, int]:
    """Sums of products of all column pairs and the row count, in one aggregate."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(F.count("*"), *[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).first()
    m = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row[1:]):
        m[i, j] = m[j, i] = v or 0.0
    return m, int(row[0])


def complete(df: DataFrame, cols: list[str], where: Column | None = None) -> DataFrame:
    """Rows with all of `cols` present, and only those columns."""
    d = df if where is None else df.where(where)
    uniq = list(dict.fromkeys(cols))
    return d.select(*uniq).dropna()


def absorb(df: DataFrame, cols: list[str], factors: list[str], tol: float = 1e-12, max_iter: int = 1000) -> tuple[DataFrame, int]:
    """Replace `cols` by their residuals on the factors; also the rank the factors use.

    No factor: less the mean. One: less group means. More: rows are added up once to the cells of levels that occur together, the
    normal equations of the level effects are solved by conjugate gradients on tables of levels, and the effects are
    taken off the rows. So the rows are read twice, at any number of levels.
    """
    if not factors:
        means = [df.agg(F.avg(c)).scalar() for c in cols]
        return df.withColumns({c: F.col(c) - m for c, m in zip(cols, means)}), 1
    if len(factors) == 1:
        return _less_means(df, cols, factors[0]), df.select(factors[0]).distinct().count()
    keys = [f"_k{i}" for i in range(len(factors))]
    keyed = df.select(*[F.col(f).cast("string").alias(k) for f, k in zip(factors, keys)], *cols)
    cells = cut_lineage(keyed.groupBy(*keys).agg(F.count("*").cast("double").alias("_n"), *[F.sum(c).alias(f"_s{j}") for j, c in enumerate(cols)]))
    levels, rank = _level_effects(cells, keys, len(cols), tol, max_iter)
    out, many = df, _many_levels(levels)
    for i, f in enumerate(factors):
        eff = levels.where(F.col("f") == i).select(F.col("level").alias("_level"), *[F.col(f"x{j}").alias(f"_x{j}") for j in range(len(cols))])
        out = out.join(large(eff) if i in many else eff, F.col(f).cast("string") == F.col("_level")).drop("_level")
        out = out.withColumns({c: F.col(c) - F.col(f"_x{j}") for j, c in enumerate(cols)}).drop(*[f"_x{j}" for j in range(len(cols))])
    return out, rank


MANY = 20_000  # levels; a factor that has more (persons) is merged step by step, never broadcast


def _many_levels(table: DataFrame) -> set[int]:
    """The factors of a level table with many levels."""
    return {r["f"] for r in table.groupBy("f").count().collect() if r["count"] > MANY}


def _by_level(cells: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Cell values added up for every level of every factor: (f, level, ...)."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(k).alias("level")) for i, k in enumerate(keys)]))
    return (cells.select(*[c.alias(n) for n, c in sums.items()], each.alias("_e")).groupBy("_e.f", "_e.level")
            .agg(*[F.sum(n).alias(n) for n in sums]))


def _level_effects(cells: DataFrame, keys: list[str], n_cols: int, tol: float, max_iter: int) -> tuple[DataFrame, int]:
    """(f, level, n, x0, x1, ...) that solve the normal equations of the level dummies, and the dummies' rank.

    Conjugate gradients with the counts as preconditioner, all columns side by side: one pass over the cells a step. The rank is
    the number of levels less the dimension of what the dummies cannot tell apart: two factors lose one for every component they
    hang together in; for more, random level vectors are solved along, and what is left of them spans that space.
    """
    if len(keys) == 2:
        ends = [F.concat(F.lit(f"{i}/"), F.col(k)) for i, k in enumerate(keys)]
        links = cells.select(ends[0].alias("u"), ends[1].alias("v"))
        levels = _conjugate(cells, keys, n_cols, tol, max_iter)
        apart = components(links, bool(_many_levels(levels))).select("root").distinct().count()
        return levels, _count_levels(cells, keys) - apart
    probes = len(keys) + 1
    while True:
        draw = lambda f, level, j: (F.pmod(F.xxhash64(f, level, F.lit(j)), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1.0)
        more = {f"_s{n_cols + j}": F.col("_n") * sum((draw(F.lit(i), F.col(k), j) for i, k in enumerate(keys)), F.lit(0.0)) for j in range(probes)}
        levels = _conjugate(cells.withColumns(more), keys, n_cols + probes, tol, max_iter)
        left = [draw(F.col("f"), F.col("level"), j) - F.col(f"x{n_cols + j}") for j in range(probes)]
        pairs = [(a, b) for a in range(probes) for b in range(a, probes)]
        row = levels.agg(F.count("*"), *[F.sum(F.col("n") * left[a] * left[b]) for a, b in pairs], *[F.sum(F.col("n") * draw(F.col("f"), F.col("level"), 0) ** 2)]).first()
        g = np.zeros((probes, probes))
        for (a, b), v in zip(pairs, row[1:]):
            g[a, b] = g[b, a] = v
        null = int((np.linalg.eigvalsh(g) > 1e-9 * row[-1]).sum())
        if null < probes:
            return levels, row[0] - null
        probes *= 2


def _count_levels(cells: DataFrame, keys: list[str]) -> int:
    return sum(cells.agg(*[F.count_distinct(k) for k in keys]).first())


def _conjugate(cells: DataFrame, keys: list[str], n_cols: int, tol: float, max_iter: int) -> DataFrame:
    cols = range(n_cols)
    start = _by_level(cells, keys, {"n": F.col("_n"), **{f"r{j}": F.col(f"_s{j}") for j in cols}})
    table = cut_lineage(start.select("f", "level", "n", *[F.lit(0.0).alias(f"x{j}") for j in cols], *[f"r{j}" for j in cols],
                                     *[(F.col(f"r{j}") / F.col("n")).alias(f"p{j}") for j in cols]))
    first, many = None, _many_levels(table)
    for _ in range(max_iter):
        moved = cells.select("_n", *keys)
        for i, k in enumerate(keys):
            p = table.where(F.col("f") == i).select(F.col("level").alias(k), *[F.col(f"p{j}").alias(f"p{i}_{j}") for j in cols])
            moved = moved.join(large(p) if i in many else p, k)
        q = _by_level(moved, keys, {f"q{j}": F.col("_n") * sum((F.col(f"p{i}_{j}") for i in range(len(keys))), F.lit(0.0)) for j in cols})
        new = cut_lineage(table.join(large(q) if many else q, ["f", "level"]))
        dots = new.agg(*[F.sum(e).alias(f"{n}{j}") for j in cols for n, e in (
            ("pq", F.col(f"p{j}") * F.col(f"q{j}")), ("rr", F.col(f"r{j}") ** 2 / F.col("n")),
            ("rq", F.col(f"r{j}") * F.col(f"q{j}") / F.col("n")), ("qq", F.col(f"q{j}") ** 2 / F.col("n")))]).first()
        first = first or [dots[f"rr{j}"] or 0.0 for j in cols]
        open_ = [j for j in cols if (dots[f"rr{j}"] or 0.0) > tol * tol * first[j] and (dots[f"pq{j}"] or 0.0) > 0]
        step = {j: dots[f"rr{j}"] / dots[f"pq{j}"] if j in open_ else 0.0 for j in cols}
        after = {j: max(dots[f"rr{j}"] - 2 * step[j] * dots[f"rq{j}"] + step[j] ** 2 * dots[f"qq{j}"], 0.0) if j in open_ else 0.0 for j in cols}
        turn = {j: after[j] / dots[f"rr{j}"] if j in open_ else 0.0 for j in cols}
        residual = {j: F.col(f"r{j}") - F.col(f"q{j}") * step[j] for j in cols}
        old, table = table, new.select("f", "level", "n", *[(F.col(f"x{j}") + F.col(f"p{j}") * step[j]).alias(f"x{j}") for j in cols],
                                       *[residual[j].alias(f"r{j}") for j in cols],
                                       *[(residual[j] / F.col("n") + F.col(f"p{j}") * turn[j]).alias(f"p{j}") for j in cols])
        release(old)
        table._scratch_path = new._scratch_path
        if not open_:
            return table
    raise RuntimeError(f"the level effects did not settle in {max_iter} steps")


def _less_means(df: DataFrame, cols: list[str], factor: str) -> DataFrame:
    d = attach(df, [factor], {f"_m_{c}": F.avg(c) for c in cols})
    return d.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def _score_meat(df: DataFrame, zs: list[str], resid: Column, cluster: str) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer product of cluster score sums."""
    d = df.withColumn("_e", resid)
    sums = d.groupBy(cluster).agg(*[F.sum(F.col(z) * F.col("_e")).alias(z) for z in zs])
    return cross_products(sums, zs)


def _spread(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Sums of squares about the mean, the yardstick for what factors and other columns leave of a column."""
    row = df.agg(*[F.var_pop(c) * F.count(c) for c in cols]).first()
    return np.array([v or 0.0 for v in row], float)


def _clusters(g: int) -> float:
    if g < 2:
        raise ValueError("a cluster covariance needs at least two clusters")
    return g / (g - 1)


def _less_fit(y: str, xs: list[str], b: np.ndarray) -> Column:
    out = F.col(y)
    for x, v in zip(xs, b):
        out = out - F.col(x) * F.lit(float(v))
    return out


def ols(df: DataFrame, y: str, x: list[str], factors: list[str] | None = None,
        cluster: str | None = None, where: Column | None = None) -> Fit:
    """Least squares with optional factors and cluster-robust covariance.

    Cluster covariance carries (N-1)/(N-k) * G/(G-1); `F` tests all kept slopes. A column that factors and
    earlier columns explain is omitted: coefficient and error 0, marked in `omitted`.
    """
    factors = factors or []
    d = complete(df, [y, *x, *factors, *([cluster] if cluster else [])], where)
    d = d.withColumns({c: F.col(c).cast("double") for c in [y, *x]})
    if cluster in x or cluster in factors:
        d = d.withColumn("_cl", F.col(cluster))
        cluster = "_cl"
    d = cut_lineage(d)
    means = None if factors else d.agg(*[F.avg(c) for c in [y, *x]]).first()
    r, rank = absorb(d, [y, *x], factors)
    r = cut_lineage(r)
    m, n = cross_products(r, [y, *x])
    sxx, sxy = m[1:, 1:], m[1:, 0]
    keep = independent(sxx, _spread(d, x))
    inv = inverse_of(sxx, keep)
    b = inv @ sxy
    k = len(keep) + rank
    rss = m[0, 0] - b @ sxy
    stats = {"n": n, "r2_within": 1 - rss / m[0, 0], "rmse": math.sqrt(rss / (n - k))}
    if cluster:
        meat, g = _score_meat(r, x, _less_fit(y, x, b), cluster)
        cov = inv @ meat @ inv * (n - 1) / (n - k) * _clusters(g)
        stats["clusters"] = g
    else:
        cov = inv * rss / (n - k)
    # with fewer clusters than slopes the covariance has fewer ranks than slopes
    tested = [keep[i] for i in independent(cov[np.ix_(keep, keep)])]
    if tested:
        stats["F"] = float(b[tested] @ np.linalg.solve(cov[np.ix_(tested, tested)], b[tested]) / len(tested))
    if means is not None:
        stats["constant"] = means[0] - float(b @ np.array(means[1:]))
    return Fit(list(x), b, cov, stats, {x[i] for i in range(len(x)) if i not in keep})


def ols_factor(df: DataFrame, y: str, x: list[str], factors: list[str], where: Column | None = None) -> Fit:
    return ols(df, y, x, factors, None, where)


def ols_cluster(df: DataFrame, y: str, x: list[str], cluster: str, factors: list[str] | None = None,
                where: Column | None = None) -> Fit:
    return ols(df, y, x, factors, cluster, where)


def fe_within(df: DataFrame, y: str, x: str, fes: list[str], where: Column | None = None) -> Fit:
    """Slope with one or two sets of fixed effects."""
    return ols(df, y, [x], fes, None, where)


def residualize(df: DataFrame, y: str, controls: list[str], factors: list[str], keep: list[str],
                out: str = "resid") -> DataFrame:
    """Residuals of y on controls and factors, for complete rows, next to `keep` columns.

    Controls that factors and earlier controls explain play no part.
    """
    d = df.select(*keep, *[F.col(c).cast("double").alias(f"_v_{c}") for c in [y, *controls]],
                  *[F.col(f).alias(f"_f_{f}") for f in factors]).dropna(
                      subset=[f"_v_{c}" for c in [y, *controls]] + [f"_f_{f}" for f in factors])
    cols = [f"_v_{c}" for c in [y, *controls]]
    d = cut_lineage(d)
    r = cut_lineage(absorb(d, cols, [f"_f_{f}" for f in factors])[0])
    if controls:
        m, _ = cross_products(r, cols)
        b = inverse_of(m[1:, 1:], independent(m[1:, 1:], _spread(d, cols[1:]))) @ m[1:, 0]
        r = r.withColumn(out, _less_fit(cols[0], cols[1:], b))
    else:
        r = r.withColumn(out, F.col(cols[0]))
    return r.select(*keep, out)


def iv_2sls(df: DataFrame, y: str, endog: str, instrument: str, x: list[str], factors: list[str] | None = None,
            cluster: str | None = None, where: Column | None = None) -> Fit:
    """Two-stage least squares with one endogenous regressor and one excluded instrument.

    Covariance without a small-sample factor. Statistics: `lm` (cluster-robust
    underidentification score test), `cdf` and `rkf` (first-stage Wald F, homoskedastic and
    cluster-robust), `j` = 0 (exactly identified).
    """
    factors = factors or []
    d = complete(df, [y, endog, instrument, *x, *factors, *([cluster] if cluster else [])], where)
    cols = [y, endog, instrument, *x]
    d = d.withColumns({c: F.col(c).cast("double") for c in cols})
    if cluster in factors:
        d = d.withColumn("_cl", F.col(cluster))
        cluster = "_cl"
    d = cut_lineage(d)
    r, rank = absorb(d, cols, factors)
    r = cut_lineage(r)
    m, n = cross_products(r, cols)
    # controls first: an instrument or an endogenous column that they explain identifies nothing
    order, scale = [*range(3, len(cols)), 2], _spread(d, cols)
    kept = [order[i] for i in independent(m[np.ix_(order, order)], scale[order])]
    if 2 not in kept or not independent(m[1:2, 1:2], scale[1:2]):
        raise ValueError("the instrument or the endogenous column has nothing left besides controls and factors")
    left = {cols[i] for i in range(3, len(cols)) if i not in kept}
    x, cols = [c for c in x if c not in left], [c for c in cols if c not in left]
    m = m[np.ix_(at := [0, 1, 2, *[i for i in kept if i != 2]], at)]
    ix, iz = [1, *range(3, len(cols))], [2, *range(3, len(cols))]
    zx_inv = np.linalg.inv(m[np.ix_(iz, ix)])
    b = zx_inv @ m[iz, 0]
    zz_inv = np.linalg.inv(m[np.ix_(iz, iz)])
    pi = zz_inv @ m[iz, 1]
    k = len(iz) + rank
    first_rss = m[1, 1] - pi @ m[iz, 1]
    xs, zs = [cols[i] for i in ix], [cols[i] for i in iz]
    stats = {"n": n, "first_stage": float(pi[0]), "cdf": float(pi[0] ** 2 / (zz_inv[0, 0] * first_rss / (n - k))), "j": 0.0}
    if cluster:
        meat, g = _score_meat(r, zs, _less_fit(y, xs, b), cluster)
        cov = zx_inv @ meat @ zx_inv.T
        fmeat, _ = _score_meat(r, zs, _less_fit(endog, zs, pi), cluster)
        fcov = zz_inv @ fmeat @ zz_inv * (n - 1) / (n - k) * _clusters(g)
        stats.update(clusters=g, rkf=float(pi[0] ** 2 / fcov[0, 0]))
        # score test: instrument and endogenous, both less the other regressors
        w = m[3:, 3:]
        gz = np.linalg.solve(w, m[3:, 2]) if len(x) else np.zeros(0)
        gd = np.linalg.solve(w, m[3:, 1]) if len(x) else np.zeros(0)
        d2 = r.withColumn("_z", _less_fit(instrument, x, gz))
        part, _ = _score_meat(d2, ["_z"], _less_fit(endog, x, gd), cluster)
        num = m[2, 1] - (gz @ m[3:, 1] if len(x) else 0.0)
        stats["lm"] = float(num ** 2 / part[0, 0])
    else:
        e = m[0, 0] - 2 * b @ m[ix, 0] + b @ m[np.ix_(ix, ix)] @ b
        cov = zx_inv @ m[np.ix_(iz, iz)] @ zx_inv.T * e / n
    if left:  # back in as zeros
        pad = np.zeros((len(xs) + len(left),) * 2)
        pad[: len(xs), : len(xs)] = cov
        xs, b, cov = [*xs, *sorted(left)], np.append(b, np.zeros(len(left))), pad
    return Fit(xs, b, cov, stats, left)


def _glm_frame(df: DataFrame, y: str, x: list[str], factors: list[str], where: Column | None):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    d = complete(df, [y, *x, *factors], where)
    d = cut_lineage(d.withColumns({c: F.col(c).cast("double") for c in [y, *x]}))
    cols, names = list(x), list(x)
    for f in factors:
        d = d.withColumn(f"_t_{f}", F.col(f).cast("string"))
        ix = StringIndexer(inputCol=f"_t_{f}", outputCol=f"_i_{f}", stringOrderType="alphabetDesc").fit(d)
        d = OneHotEncoder(inputCol=f"_i_{f}", outputCol=f"_o_{f}").fit(ix.transform(d)).transform(ix.transform(d))
        cols.append(f"_o_{f}")
        names += [f"{f}={v}" for v in ix.labels[:-1]]
    return VectorAssembler(inputCols=cols, outputCol="_x").transform(d), names


def binary_fit(df: DataFrame, y: str, x: list[str], link: str, factors: list[str] | None = None,
               where: Column | None = None) -> Fit:
    """Probit or logit by iterated weighted least squares on Spark; factors become dummies.

    With factors, keep only levels where the outcome varies.
    """
    from pyspark.ml.regression import GeneralizedLinearRegression
    d, names = _glm_frame(df, y, x, factors or [], where)
    m = GeneralizedLinearRegression(family="binomial", link=link, labelCol=y, featuresCol="_x",
                                    maxIter=ROUNDS, tol=1e-10).fit(d)
    if m.summary.numIterations >= ROUNDS:
        raise RuntimeError(f"the {link} fit did not converge in {ROUNDS} rounds")
    b = np.append(m.coefficients.toArray(), m.intercept)
    se = np.array(m.summary.coefficientStandardErrors)
    return Fit([*names, "_cons"], b, np.diag(se ** 2), {"n": d.count(), "deviance": m.summary.deviance})


def probit(df: DataFrame, y: str, x: list[str], where: Column | None = None) -> tuple[Fit, DataFrame]:
    """Binary probit and average marginal effects (term, effect)."""
    from panelspark.functions.normal import norm_pdf
    fit = binary_fit(df, y, x, "probit", None, where)
    xb = sum((F.col(c).cast("double") * F.lit(float(v)) for c, v in zip(x, fit.coef)), F.lit(float(fit.coef[-1])))
    d = complete(df, [y, *x], where).withColumn("_xb", xb)
    mean_pdf = d.agg(F.avg(norm_pdf("_xb")).alias("_p"))
    effects = F.array(*[F.struct(F.lit(t).alias("term"), (F.col("_p") * F.lit(float(v))).alias("effect"))
                        for t, v in zip(x, fit.coef)])
    return fit, mean_pdf.select(F.inline(effects))


def logit_fe(df: DataFrame, y: str, x: list[str], factors: list[str], where: Column | None = None, tol: float = 1e-10,
             max_iter: int = 60) -> tuple[Fit, DataFrame]:
    """Logit with fixed effects, on factor levels where the outcome varies: (slopes, (level, effect, se)).

    Newton steps. The effects of the factor with the most levels stay in a table: rows are added up by level, each level is taken out of the
    equations of the slopes by its own count, and its step follows from theirs. Levels of further factors are columns.
    """
    from panelspark.operators.ordered import group_variation_flag
    d = complete(df, [y, *x, *factors], where)
    for f in factors:
        d = group_variation_flag(cut_lineage(d), [f], y, "_v").where(F.col("_v") == 1).drop("_v")
    d = cut_lineage(d)
    counts = d.agg(*[F.count_distinct(f) for f in factors]).first()
    wide = max(zip(counts, factors))[1]
    cols = {c: F.col(c).cast("double") for c in x}
    for f in factors:
        if f != wide:
            for lv in sorted(r[0] for r in d.select(f).distinct().collect())[1:]:
                cols[f"{f}={lv}"] = (F.col(f) == F.lit(lv)).cast("double")
    names, p = list(cols), len(cols)
    spread = d.agg(*[e for c in cols.values() for e in (F.avg(c), F.stddev_samp(c))]).first()
    scale = [(spread[2 * j] or 0.0, spread[2 * j + 1] or 1.0) for j in range(p)]
    data = cut_lineage(d.select(F.col(wide).cast("string").alias("level"), F.col(y).cast("double").alias("_y"),
                                *[((c - m) / s).alias(f"z{j}") for j, (c, (m, s)) in enumerate(zip(cols.values(), scale))]))
    slope, table, ll = np.zeros(p), None, -math.inf
    step, size = np.zeros(p), 1.0
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(max_iter):
        trial = slope + size * step
        if table is None:
            eff = data.select("level").distinct().withColumn("a", F.lit(0.0))
        else:
            own = F.try_divide(F.col("g") - sum((F.col(f"b{j}") * float(step[j]) for j in range(p)), F.lit(0.0)), F.col("d"))
            eff = table.select("level", (F.col("a") + size * F.coalesce(own, F.lit(0.0))).alias("a"))
        eta = F.col("a") + sum((F.col(f"z{j}") * float(trial[j]) for j in range(p)), F.lit(0.0))
        r = data.join(eff, "level").withColumn("_eta", eta).withColumn("_p", 1 / (1 + F.exp(-F.col("_eta"))))
        # log(1 + exp(eta)) without overflow
        r = r.withColumns({"_u": F.col("_y") - F.col("_p"), "_w": F.col("_p") * (1 - F.col("_p")),
                           "_l": F.col("_y") * F.col("_eta") - F.greatest("_eta", F.lit(0.0)) - F.log1p(F.exp(-F.abs("_eta")))})
        new = cut_lineage(r.groupBy("level").agg(
            F.max("a").alias("a"), F.sum("_l").alias("ll"), F.count("*").alias("n"), F.sum("_u").alias("g"), F.sum("_w").alias("d"),
            *[F.sum(F.col("_w") * F.col(f"z{j}")).alias(f"b{j}") for j in range(p)], *[F.sum(F.col("_u") * F.col(f"z{j}")).alias(f"s{j}") for j in range(p)],
            *[F.sum(F.col("_w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in upper]))
        less = lambda a, b: F.coalesce(F.try_divide(F.col(a) * F.col(b), F.col("d")), F.lit(0.0))
        sums = new.agg(F.sum("ll").alias("ll"), F.sum("n").alias("n"), F.sum(less("g", "g")).alias("gain"),
                       *[F.sum(F.col(f"s{j}") - less(f"b{j}", "g")).alias(f"s{j}") for j in range(p)],
                       *[F.sum(F.col(f"h{i}_{j}") - less(f"b{i}", f"b{j}")).alias(f"h{i}_{j}") for i, j in upper],
                       *[F.sum(f"h{j}_{j}").alias(f"v{j}") for j in range(p)]).first()
        if sums["ll"] < ll - 1e-12:
            release(new)
            size /= 2
            if size < 1e-6:
                raise RuntimeError("the logit fit found no step uphill")
            continue
        if table is not None:
            release(table)
        slope, table, ll, size = trial, new, sums["ll"], 1.0
        info = np.zeros((p, p))
        for i, j in upper:
            info[i, j] = info[j, i] = sums[f"h{i}_{j}"]
        keep = independent(info, np.array([sums[f"v{j}"] for j in range(p)]), 1e-10)
        inv, grad = inverse_of(info, keep), np.array([sums[f"s{j}"] for j in range(p)])
        step = inv @ grad
        if float(step @ grad) + sums["gain"] < tol:
            break
    else:
        raise RuntimeError(f"the logit fit did not converge in {max_iter} rounds")
    unit = np.array([1 / s for _, s in scale])
    fit = Fit(names, slope * unit, inv * np.outer(unit, unit), {"n": sums["n"], "loglik": ll}, {names[j] for j in range(p) if j not in keep})
    # effects belong to centred columns; a column's mean moves all of them
    shift = float(sum(b * m for b, (m, _) in zip(fit.coef, scale)))
    lean = [F.col(f"b{j}") / F.col("d") + m / s for j, (m, s) in enumerate(scale)]
    var = 1 / F.col("d") + sum((lean[i] * lean[j] * float(inv[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))
    return fit, table.select("level", (F.col("a") - shift).alias("effect"), F.sqrt(var).alias("se"))
