"""Selection model: derivatives, recovery of known parameters, margins against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.normal import np_bvn, np_cdf, np_log_cdf
from panelspark.operators import effects as E
from panelspark.operators.selection import (OUT, SEL, Model, Spec, _pieces, fit_selections, level_table, log_joint, selection_loglik, selection_predict,
                                            selection_probit, usable)


def test_derivatives_match_differences():
    rng = np.random.default_rng(1)
    n = 60
    xb, zg = rng.normal(-0.5, 1, n), rng.normal(0.3, 1, n)
    s, y = (rng.random(n) < 0.7).astype(int), (rng.random(n) < 0.4).astype(float)
    tau, h = -0.7, 1e-5
    _, g, hess = _pieces(xb, zg, y, s, tau, True)
    f = lambda dx, dz, dt: _pieces(xb + dx, zg + dz, y, s, tau + dt, False)[:2]
    steps = [(h, 0, 0), (0, h, 0), (0, 0, h)]
    for i, d in enumerate(steps):
        up, dn = f(*d), f(*[-v for v in d])
        assert np.allclose((up[0] - dn[0]) / (2 * h), g[:, i], atol=1e-5)
        num = (up[1] - dn[1]) / (2 * h)
        for j in range(3):
            at = {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 4, (2, 2): 5}[tuple(sorted((i, j)))]
            assert np.allclose(num[:, j], hess[:, at], atol=2e-4)


def simulate(n=12000, rho=-0.6, seed=3):
    rng = np.random.default_rng(seed)
    x, w = rng.normal(size=n), rng.normal(2, 3, size=n)
    day = rng.integers(0, 5, n)
    z = rng.normal(size=n)
    e = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], n)
    dy, ds = np.array([0, .2, -.2, .1, .3]), np.array([0, -.3, .2, .1, -.1])
    work = (0.4 + 0.8 * z + 0.3 * x - 0.05 * w + ds[day] + e[:, 1] > 0).astype(int)
    inj = (-0.5 + 0.5 * x + 0.1 * w + dy[day] + e[:, 0] > 0).astype(int)
    pdf = pd.DataFrame({"inj": np.where(work == 1, inj, 0), "work": work, "x": x, "w": w, "z": z, "day": day, "cl": np.arange(n) // 10})
    return pdf


@pytest.fixture(scope="module")
def fitted(spark):
    pdf = simulate()
    df = spark.createDataFrame(pdf).cache()
    m = selection_probit(df, "inj", ["x", "w"], "work", ["z", "x", "w"], ["day"], "cl")
    return pdf, df, m


def dummies(pdf, df):
    """The same model with the days as columns of both equations: nothing is taken out."""
    cols = [f"d{k}" for k in range(1, 5)]
    wide = df.withColumns({c: (F.col("day") == k + 1).cast("double") for k, c in enumerate(cols)})
    return wide, selection_probit(wide, "inj", ["x", "w", *cols], "work", ["z", "x", "w", *cols], [], "cl")


@pytest.fixture(scope="module")
def full(fitted):
    pdf, df, _ = fitted
    return dummies(pdf, df)


def test_recovery(fitted):
    _, _, m = fitted
    want = {(OUT, "x", None): .5, (OUT, "w", None): .1, (OUT, "_cons", None): -.5, (SEL, "z", None): .8, (SEL, "x", None): .3,
            (SEL, "w", None): -.05, (SEL, "_cons", None): .4}
    se = dict(zip(m.names, m.fit().se))
    for k, v in want.items():
        assert abs(m.coef[k] - v) < 4 * se[k] + 1e-9, (k, m.coef[k], se[k])
    assert abs(m.rho + 0.6) < 4 * E.lincom_nlcom(m, "athrho", "athrho", "tanh")[1]
    assert 0.001 < se[(SEL, "z", None)] < 0.05 and m.stats["converged"] == 1
    lo, hi = E.rho_interval(m)
    assert lo < m.rho < hi
    days = {r.level: r for r in level_table(m).collect()}
    assert abs(days["4"].out - .3) < 4 * days["4"].se_out and abs(days["1"].sel + .3) < 4 * days["1"].se_sel
    assert (days["0"].out, days["0"].sel, days["0"].se_out) == (0.0, 0.0, 0.0)


def test_taking_levels_out_equals_the_full_solve(fitted, full):
    """Coefficients, covariance, effects of levels and their errors, and margins, are those of the model with all columns."""
    _, df, m = fitted
    wide, f = full
    at = [f.names.index(n) for n in m.names]
    assert [m.coef.get(n, m.athrho) for n in m.names] == pytest.approx([f.coef.get(n, f.athrho) for n in m.names], abs=2e-6)
    assert np.allclose(m.cov, f.cov[np.ix_(at, at)], rtol=1e-5, atol=1e-9)
    se = dict(zip(f.names, f.fit().se))
    for r in level_table(m).collect():
        if r.level != "0":
            assert (r.out, r.sel) == pytest.approx((f.coef[(OUT, f"d{r.level}", None)], f.coef[(SEL, f"d{r.level}", None)]), abs=2e-6)
            assert (r.se_out, r.se_sel) == pytest.approx((se[(OUT, f"d{r.level}", None)], se[(SEL, f"d{r.level}", None)]), rel=1e-5)
    for expr in (E.pmargin, E.pcond, E.slope(E.psel, "x", True), E.slope(E.pcond, "w")):
        for how in ({}, {"vce": "unconditional", "cluster": "cl"}):
            a, b = E.margins(df, m, expr, **how).first(), E.margins(wide, f, expr, **how).first()
            assert (a["estimate"], a["se"], a["n"]) == pytest.approx((b["estimate"], b["se"], b["n"]), rel=1e-5)
    # without clusters too
    a, b = selection_probit(df, "inj", ["x"], "work", ["z"], ["day"]), selection_probit(wide, "inj", ["x", *[f"d{k}" for k in range(1, 5)]], "work", ["z", *[f"d{k}" for k in range(1, 5)]])
    at = [b.names.index(n) for n in a.names]
    assert np.allclose(a.cov, b.cov[np.ix_(at, at)], rtol=1e-5, atol=1e-9)
    assert E.margins(df, a, E.pcond).first()["se"] == pytest.approx(E.margins(wide, b, E.pcond).first()["se"], rel=1e-5)
    se = dict(zip(b.names, b.fit().se))
    assert {r.level: r.se_out for r in level_table(a).collect()}["2"] == pytest.approx(se[(OUT, "d2", None)], rel=1e-5)


def test_two_factors(spark, fitted):
    """The smaller factor stays among the parameters."""
    pdf, df, _ = fitted
    d = df.withColumns({"grp": (F.col("cl") % 3).cast("int"), "g1": (F.col("cl") % 3 == 1).cast("int"), "g2": (F.col("cl") % 3 == 2).cast("int")})
    a = selection_probit(d, "inj", ["x"], "work", ["z"], ["grp", "day"], "cl")
    b = selection_probit(d, "inj", ["x", "g1", "g2"], "work", ["z", "g1", "g2"], ["day"], "cl")
    assert a.wide.name == "day" and a.coef[(OUT, "grp", 0)] == 0.0
    assert a.coef[(OUT, "grp", 2)] == pytest.approx(b.coef[(OUT, "g2", None)], abs=1e-6) and a.stats["loglik"] == pytest.approx(b.stats["loglik"])
    assert E.margins(d, a, E.pcond).first()["se"] == pytest.approx(E.margins(d, b, E.pcond).first()["se"], rel=1e-5)


def test_many_levels(spark):
    """10,000 levels, one of them with a third of the rows; levels without variation have no error."""
    rng = np.random.default_rng(8)
    n = 200_000
    lv = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 10_000, n))
    eff = rng.normal(0, 0.3, (10_000, 2))
    x, z = rng.normal(size=(2, n))
    e = rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], n)
    work = (0.3 + 0.7 * z + eff[lv, 1] + e[:, 1] > 0).astype(int)
    inj = np.where(work == 1, (0.2 + 0.5 * x + eff[lv, 0] + e[:, 0] > 0).astype(int), 0)
    df = spark.createDataFrame(pd.DataFrame({"inj": inj, "work": work, "x": x, "z": z, "lv": lv}))
    m = selection_probit(df, "inj", ["x"], "work", ["z"], ["lv"], max_iter=60)
    assert m.wide.effects.count() == len(set(lv.tolist())) > 9_900
    # effects of small levels take the slopes up (the incidental parameters), by a little at twenty rows a level
    assert 0.5 < m.coef[(OUT, "x", None)] < 0.62 and 0.7 < m.coef[(SEL, "z", None)] < 0.85
    assert m.stats["n"] == n and m.stats["loglik"] > -n


def test_invariant_to_partitions(spark, fitted):
    pdf, _, m = fitted
    for parts in (1, 64):
        again = selection_probit(spark.createDataFrame(pdf.sample(frac=1, random_state=parts)).repartition(parts), "inj", ["x", "w"], "work",
                                 ["z", "x", "w"], ["day"], "cl")
        for k, v in m.coef.items():
            assert abs(v - again.coef[k]) < 1e-8
        assert np.allclose(m.cov, again.cov, atol=1e-8)


def test_specifications_fitted_together(spark, fitted):
    """Fitting side by side, with different factors, filters and updates, changes nothing."""
    _, df, m = fitted
    d = df.withColumns({"half": F.col("cl") % 2, "grp": (F.col("cl") % 7).cast("int")})
    specs = [Spec("inj", ["x", "w"], "work", ["z", "x", "w"], ["day"], "cl"),
             Spec("inj", ["x"], "work", ["z", "x"], ["grp", "day"], "cl", F.col("half") == 0),
             Spec("inj", ["x"], "work", ["z"], [], "cl", None, [("inj", F.col("w") > 4, F.lit(0))])]
    got = fit_selections(d, specs)
    alone = [selection_probit(d, "inj", ["x", "w"], "work", ["z", "x", "w"], ["day"], "cl"),
             selection_probit(d.where("half = 0"), "inj", ["x"], "work", ["z", "x"], ["grp", "day"], "cl"),
             selection_probit(d.withColumn("inj", F.when(F.col("w") > 4, 0).otherwise(F.col("inj"))), "inj", ["x"], "work", ["z"], [], "cl")]
    for a, b in zip(got, alone):
        assert a.names == b.names and a.stats["n"] == b.stats["n"]
        assert [*a.coef.values()] == pytest.approx([*b.coef.values()], abs=1e-7) and np.allclose(a.cov, b.cov, atol=1e-8)


def test_collinear_columns_are_omitted(spark, fitted):
    """A column that the levels explain, and a copy of another column."""
    _, df, m = fitted
    d = df.withColumns({"by_day": F.col("day") * 2.0, "x2": F.col("x") * 3 + 1})
    a = selection_probit(d, "inj", ["x", "w", "by_day"], "work", ["z", "x", "x2", "w"], ["day"], "cl")
    out = {a.names[i] for i in a.omitted}
    assert out == {(OUT, "by_day", None), (SEL, "x2", None)}
    assert a.coef[(OUT, "x", None)] == pytest.approx(m.coef[(OUT, "x", None)], abs=1e-6)
    assert dict(zip(a.names, a.fit().se))[(OUT, "by_day", None)] == 0


def test_far_out_values_agree_with_their_derivatives():
    rng = np.random.default_rng(2)
    a, k = rng.uniform(-12, 4, (2, 400))
    for r in (-0.95, -0.4, 0.0, 0.6, 0.97):
        f = log_joint(a, k, r)
        assert np.isfinite(f).all()
        near = np_bvn(a, k, r) > 1e-6
        assert np.allclose(f[near], np.log(np_bvn(a, k, r)[near]), atol=1e-6)
        if r == 0:
            assert np.allclose(f, np_log_cdf(a) + np_log_cdf(k), rtol=1e-6)
        h = 1e-4
        slope = (log_joint(a + h, k, r) - log_joint(a - h, k, r)) / (2 * h)
        own = _pieces(a, k, np.ones(400), np.ones(400, int), math.atanh(r), False)[1][:, 0]
        assert np.allclose(slope, own, rtol=2e-3, atol=2e-3)


def test_sample_flag(spark):
    rows = [(1, 0, 1.0, 2.0, "a"), (None, 0, 1.0, 2.0, "a"), (None, 1, 1.0, 2.0, "a"), (1, 1, None, 2.0, "a"), (0, None, 1.0, 2.0, "a"), (1, 1, 1.0, 2.0, None), (0, 1, 1.0, 2.0, "b")]
    d = spark.createDataFrame(rows, "y int, s int, x double, z double, f string")
    assert [r[0] for r in d.select(usable("y", ["x"], "s", ["z"], ["f"])).collect()] == [True, True, False, False, False, False, True]


def test_task_likelihood_equals_column_likelihood(fitted):
    _, df, m = fitted
    r = selection_loglik(df, m, "inj", "work").first()
    assert r["loglik"] == pytest.approx(m.stats["loglik"], rel=1e-10)
    # a maximum: moving any dense coefficient lowers it
    for k in [(OUT, "x", None), (SEL, "z", None)]:
        for s in (-1e-2, 1e-2):
            n = Model(m.x, m.z, m.levels, {**m.coef, k: m.coef[k] + s}, m.athrho, wide=m.wide)
            assert selection_loglik(df, n, "inj", "work").first()["loglik"] < r["loglik"]


def test_margins_match_numpy(fitted, full):
    pdf, df, m = fitted
    wide, f = full
    p = selection_predict(wide, f, ["xb", "xbsel", "psel", "pmargin", "pcond"]).toPandas()
    assert np.allclose(p["psel"], np_cdf(p["xbsel"].to_numpy()))
    assert np.allclose(p["pcond"], np_bvn(p["xb"].to_numpy(), p["xbsel"].to_numpy(), f.rho) / p["psel"], atol=1e-9)
    xb, zg, h = p["xb"].to_numpy(), p["xbsel"].to_numpy(), 1e-4
    design = {eq: {i: np.ones(len(p)) if t == "_cons" else p[t].to_numpy(float) for i, (e, t, _) in enumerate(f.names) if e == eq} for eq in (OUT, SEL)}

    def moved(value, i, s):
        a = xb + s * design[OUT][i] if i in design[OUT] else xb
        b = zg + s * design[SEL][i] if i in design[SEL] else zg
        return value(a, b, math.tanh(f.athrho + (s if f.names[i][0] == "athrho" else 0.0)), (i, s)).mean()

    def gamma(eq, t, move):
        i, s = move
        return f.coef[(eq, t, None)] + (s if f.names[i] == (eq, t, None) else 0.0)

    pdf_ = lambda v: np.exp(-v * v / 2) / math.sqrt(2 * math.pi)

    def pcond_slope(a, b, r, move):
        rt = math.sqrt(1 - r * r)
        joint, sel = np_bvn(a, b, r), np_cdf(b)
        da, db = pdf_(a) * np_cdf((b - r * a) / rt), pdf_(b) * np_cdf((a - r * b) / rt)
        return (da * gamma(OUT, "x", move) + (db - joint / sel * pdf_(b)) * gamma(SEL, "x", move)) / sel

    cases = [(E.pmargin, lambda a, b, r, _: np_cdf(a)), (E.pcond, lambda a, b, r, _: np_bvn(a, b, r) / np_cdf(b)),
             (E.slope(E.psel, "x"), lambda a, b, r, mv: pdf_(b) * gamma(SEL, "x", mv)),
             (E.slope(E.psel, "x", True), lambda a, b, r, mv: pdf_(b) * gamma(SEL, "x", mv) * p["x"].to_numpy() / np_cdf(b)),
             (E.slope(E.pcond, "x"), pcond_slope)]
    for expr, value in cases:
        r = E.margins(wide, f, expr).first()
        none = (0, 0.0)
        assert r["estimate"] == pytest.approx(value(xb, zg, f.rho, none).mean(), rel=1e-6)
        g = np.array([(moved(value, i, h) - moved(value, i, -h)) / (2 * h) for i in range(len(f.names))])
        assert r["se"] == pytest.approx(math.sqrt(g @ f.cov @ g), rel=2e-6)
    u = E.margins(df, m, E.pmargin, vce="unconditional", cluster="cl").first()
    r = E.margins(df, m, E.pmargin).first()
    assert u["estimate"] == pytest.approx(r["estimate"]) and u["se"] > 0.5 * r["se"]


def test_slopes_table(fitted):
    _, df, m = fitted
    got = E.margins_slopes(df, m, ["z", "x", "w"]).collect()
    assert len(got) == 12 and all(r["se"] > 0 for r in got)


def test_grid_quantities(fitted):
    _, df, m = fitted
    c = {round(r["u"], 2): r for r in E.mte_curve(df, m, [0.2, 0.5, 0.8], F.col("day") == 1).collect()}
    assert c[0.2]["estimate"] < c[0.5]["estimate"] < c[0.8]["estimate"]  # rho < 0: effect rises with resistance
    assert all(r["se"] > 0 for r in c.values())
    el = E.elasticity_grid(df, m, "x", [0.3, 0.6], "cl").collect()
    assert len(el) == 2 and all(r["se"] > 0 for r in el)
    v = E.quadrature_value(df, m, "w", [1, 2]).collect()
    v = {r["m"]: r for r in v}
    assert v[2.0]["wtp"] == pytest.approx(2 * v[1.0]["wtp"])
    each = E.row_values(df, m, "w", df.count()).agg(F.avg("value"), F.count("value")).first()
    assert v[1.0]["wtp"] == pytest.approx(each[0], rel=1e-9) and v[1.0]["n"] == each[1] >= df.count() - 5
    bad = tuple([*E.NODES[:4], -E.NODES[4]])
    assert E.quadrature_value(df, m, "w", [1], nodes=bad).first()["wtp"] != pytest.approx(v[1.0]["wtp"])


def test_quadrature_nodes_are_symmetric():
    assert sum(w * x for w, x in zip(E.NODE_WEIGHTS, E.NODES)) == pytest.approx(0)
    assert sum(E.NODE_WEIGHTS) == pytest.approx(math.sqrt(math.pi), abs=1e-4)


def test_margins_read_the_rows_once(fitted):
    """The values of the rows, which cost most, are made in one pass for the mean, the levels and the clusters."""
    _, df, m = fitted
    seen = df.sparkSession.sparkContext.accumulator(0)

    def tell(x):
        seen.add(1)
        return x
    own = dict(vce="unconditional", cluster="cl")
    told = df.withColumn("x", F.udf(tell, "double").asNondeterministic()("x"))
    want, got = E.margins(df, m, E.pcond, **own).first(), E.margins(told, m, E.pcond, **own).first()
    assert seen.value == df.count()
    assert got["estimate"] == pytest.approx(want["estimate"], rel=1e-12) and got["se"] == pytest.approx(want["se"], rel=1e-9)
