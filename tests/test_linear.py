"""Linear estimators against numpy with full dummies."""

import numpy as np
import pandas as pd
import pytest

from panelspark.operators import linear as L


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 1500
    f, g = rng.integers(0, 6, n), rng.integers(0, 25, n)
    z, u, w = rng.normal(size=(3, n))
    d = 0.7 * z + 0.4 * w + u + 0.2 * f + rng.normal(size=n)
    y = 2 * d - w + u + np.sin(g) + rng.normal(size=n)
    pdf = pd.DataFrame({"y": y, "d": d, "z": z, "w": w, "f": f, "g": g, "cl": g})
    return pdf, spark.createDataFrame(pdf).cache()


def design(pdf, x, factors):
    parts = [pdf[x].to_numpy(float)]
    if not factors:
        parts.append(np.ones((len(pdf), 1)))
    for i, f in enumerate(factors):
        parts.append(pd.get_dummies(pdf[f], drop_first=i > 0).to_numpy(float))
    return np.hstack(parts)


def clustered(x, z, e, cl):
    s = np.array([(z[cl == c] * e[cl == c, None]).sum(0) for c in np.unique(cl)])
    return s.T @ s, len(s)


@pytest.mark.parametrize("factors", [[], ["f"], ["f", "g"]])
def test_cluster_covariance_equals_full_dummies(data, factors):
    pdf, df = data
    fit = L.ols_cluster(df, "y", ["d", "w"], "cl", factors)
    x = design(pdf, ["d", "w"], factors)
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ pdf["y"]
    meat, g = clustered(x, x, (pdf["y"] - x @ b).to_numpy(), pdf["cl"].to_numpy())
    v = inv @ meat @ inv * (len(pdf) - 1) / (len(pdf) - x.shape[1]) * g / (g - 1)
    assert fit.coef == pytest.approx(b[:2]) and fit.se == pytest.approx(np.sqrt(np.diag(v))[:2])


@pytest.mark.parametrize("kind", ["three", "apart"])
def test_absorbing_factors_equals_dummies(spark, kind):
    """Residuals to 1e-10 and the rank of the dummies, also where levels are nested or fall apart into components."""
    rng = np.random.default_rng(7)
    n = 3000
    f, g, h = rng.integers(0, 20, n), rng.integers(0, 8, n), rng.integers(0, 4, n)
    if kind == "apart":  # two blocks of levels that never meet, and one factor nested in another
        g, h = g % 4 + 4 * (f % 2), f // 4
    pdf = pd.DataFrame({"f": f, "g": g, "h": h, "y": rng.normal(size=n) + f * 0.1 - g * 0.2, "v": rng.normal(size=n) * 100 + h, "id": np.arange(n)})
    factors = ["f", "g", "h"]
    d = np.hstack([pd.get_dummies(pdf[c]).to_numpy(float) for c in factors])
    got, rank = L.absorb(spark.createDataFrame(pdf).repartition(5), ["y", "v"], factors)
    assert rank == np.linalg.matrix_rank(d)
    out = got.toPandas().sort_values("id")
    for c in ("y", "v"):
        want = pdf[c] - d @ np.linalg.lstsq(d, pdf[c].to_numpy(), rcond=None)[0]
        assert np.abs(out[c].to_numpy() - want.to_numpy()).max() < 1e-10 * max(1, np.abs(pdf[c]).max())


def test_iv_equals_closed_form(data):
    pdf, df = data
    fit = L.iv_2sls(df, "y", "d", "z", ["w"], ["f"], "cl")
    x, z = design(pdf, ["d", "w"], ["f"]), design(pdf, ["z", "w"], ["f"])
    zx = np.linalg.inv(z.T @ x)
    b = zx @ z.T @ pdf["y"]
    meat, _ = clustered(x, z, (pdf["y"] - x @ b).to_numpy(), pdf["cl"].to_numpy())
    assert fit.coef == pytest.approx(b[:2])
    assert fit.se == pytest.approx(np.sqrt(np.diag(zx @ meat @ zx.T))[:2])
    assert fit.stats["rkf"] > 10 and fit.stats["lm"] > 5


def test_exact_line(spark):
    d = spark.createDataFrame([(2.0 * i, float(i), float(i) + (i % 3)) for i in range(30)], "y double, x double, z double")
    assert L.iv_2sls(d, "y", "x", "z", []).coef[0] == pytest.approx(2)


def test_residuals_are_orthogonal(data):
    _, df = data
    r = L.residualize(df, "y", ["w"], ["f", "g"], ["f", "w"]).toPandas()
    assert r.groupby("f")["resid"].sum().abs().max() < 1e-6 and abs((r["w"] * r["resid"]).sum()) < 1e-6


def test_probit_and_logit_recover(spark):
    rng = np.random.default_rng(5)
    n = 6000
    x, day = rng.normal(size=n), rng.integers(0, 4, n)
    eff = np.array([0, .5, -.5, .2])
    p = (0.3 + 0.8 * x + rng.normal(size=n) > 0).astype(int)
    q = (rng.random(n) < 1 / (1 + np.exp(-(x + eff[day])))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "day": day, "p": p, "q": q}))
    fit, eff_df = L.probit(df, "p", ["x"])
    assert fit["x"] == pytest.approx(0.8, abs=0.08)
    assert 0.15 < eff_df.first()["effect"] < 0.3
    lf, days = L.logit_fe(df, "q", ["x"], ["day"])
    days = {r.level: r for r in days.collect()}
    assert lf["x"] == pytest.approx(1.0, abs=0.12) and days["1"].effect - days["0"].effect == pytest.approx(0.5, abs=0.3)


def test_logit_effects_equal_dummies(spark):
    """50 levels, one with a third of the rows, some without variation: slopes, effects and errors of the fit with dummies."""
    rng = np.random.default_rng(6)
    n = 4000
    lv = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 50, n))
    x = rng.normal(size=(n, 2)) * [1, 20] + [0, 100]
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x[:, 0] + 0.03 * (x[:, 1] - 100) + np.sin(lv))))).astype(int)
    y[lv == 7], y[lv == 8] = 1, 0
    grp = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1], "lv": lv, "grp": grp})
    for factors in (["lv"], ["grp", "lv"]):
        fit, eff = L.logit_fe(spark.createDataFrame(pdf).repartition(7), "y", ["a", "b"], factors)
        d = pdf[~pdf["lv"].isin([7, 8])]
        parts = [d[["a", "b"]].to_numpy(float)] + ([pd.get_dummies(d["grp"], drop_first=True).to_numpy(float)] if "grp" in factors else []) + [pd.get_dummies(d["lv"]).to_numpy(float)]
        z = np.hstack(parts)
        t = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ t))
            info = z.T @ (z * (p * (1 - p))[:, None])
            t = t + np.linalg.solve(info, z.T @ (d["y"] - p))
        se, k = np.sqrt(np.diag(np.linalg.inv(info))), len(fit.terms)
        assert fit.coef == pytest.approx(t[:k], abs=1e-6) and fit.se == pytest.approx(se[:k], rel=1e-5)
        got = {int(r.level): r for r in eff.collect()}
        levels = sorted(d["lv"].unique())
        assert sorted(got) == levels
        assert [got[v].effect for v in levels] == pytest.approx(t[k:], abs=1e-5) and [got[v].se for v in levels] == pytest.approx(se[k:], rel=1e-4)


def test_logit_with_many_levels(spark):
    from pyspark.sql import functions as F
    d = spark.range(300_000).select((F.col("id") % 75_000).alias("lv"), F.randn(1).alias("x"), F.rand(2).alias("u"))
    d = d.withColumn("y", (F.col("u") < 1 / (1 + F.exp(-F.col("x") - (F.col("lv") % 5 - 2) / 4))).cast("int"))
    fit, eff = L.logit_fe(d, "y", ["x"], ["lv"])
    assert eff.count() > 45_000 and 1.0 < fit["x"] < 1.6  # four rows a level take the slope up
