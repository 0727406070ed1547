"""Predictions, margins and likelihood where probabilities round to zero."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.normal import np_log_cdf
from panelspark.operators import effects as E
from panelspark.operators.selection import OUT, SEL, Model, log_joint, selection_loglik, selection_predict
from panelspark.operators.stats import corr_pair

M = Model(["x"], ["x", "z"], {}, {(OUT, "_cons", None): 1.0, (OUT, "x", None): 1.0, (SEL, "_cons", None): 0.0, (SEL, "x", None): -0.5, (SEL, "z", None): -1.0},
          math.atanh(-0.6))


@pytest.fixture(scope="module")
def far(spark):
    # selection index from -12 to -160: its probability rounds to zero below -38
    return spark.createDataFrame([(2.0, 11.0), (5.0, 20.0), (12.0, 40.0), (30.0, 145.0)], "x double, z double")


def log_pcond(x, z):
    a, k = 1.0 + x, -0.5 * x - z
    return log_joint(a, k, -0.6) - np_log_cdf(k)


def test_conditional_probability(far):
    got = selection_predict(far, M, ["pcond"]).orderBy("z").toPandas()
    assert got["pcond"].notna().all()
    assert np.allclose(got["pcond"], np.exp(log_pcond(got["x"].to_numpy(), got["z"].to_numpy())), rtol=1e-9, atol=0)


def test_no_row_is_lost_in_margins(far):
    r = E.margins(far, M, E.pcond, [0.0, 100.0], at="z").collect()
    assert [x["n"] for x in r] == [4, 4] and all(x["estimate"] is not None for x in r)


def test_slopes_and_elasticities(far):
    got = {(r["prediction"], r["term"], r["kind"]): r for r in E.margins_slopes(far, M, ["x", "z"]).collect()}
    assert all(r["n"] == 4 and r["estimate"] is not None for r in got.values())
    d = far.toPandas()
    x, z, h = d["x"].to_numpy(), d["z"].to_numpy(), 1e-4
    for t, v, up, down in (("x", x, (x + h, z), (x - h, z)), ("z", z, (x, z + h), (x, z - h))):
        want = (v * (log_pcond(*up) - log_pcond(*down)) / (2 * h)).mean()
        assert got["pcond", t, "eyex"]["estimate"] == pytest.approx(want, rel=1e-5)


def test_errors_of_far_margins(far):
    m = Model(M.x, M.z, {}, M.coef, M.athrho)
    m.names = [*M.coef, E.RHO]
    m.cov = m.bread = np.eye(len(m.names)) * 1e-4
    m.unit = np.eye(len(m.names))
    assert all(r["n"] == 4 and r["se"] is not None and math.isfinite(r["se"]) for r in E.margins_slopes(far, m, ["x", "z"]).collect())
    none = E.margins(far, m, E.pcond, where=F.col("z") < 0).collect()
    assert all(r["estimate"] is None and r["n"] == 0 for r in none)


def test_likelihood_of_rare_outcomes(spark):
    d = spark.createDataFrame([(2.0, 20.0, 1), (5.0, 20.0, 1), (9.0, 9.0, 0)], "x double, z double, y int").withColumn("s", F.lit(1))
    r = selection_loglik(d, M, "y", "s").first()
    x, z, q = np.array([2.0, 5.0, 9.0]), np.array([20.0, 20.0, 9.0]), np.array([1, 1, -1])
    want = sum(float(log_joint(q[i:i + 1] * (1 + x[i:i + 1]), -0.5 * x[i:i + 1] - z[i:i + 1], -0.6 * q[i])[0]) for i in range(3))
    assert r["n_unusable"] == 0 and r["loglik"] == pytest.approx(want, rel=1e-10)


def test_constant_column_has_no_correlation(spark):
    d = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)], "a double, b double")
    assert corr_pair(d, "a", "b").first()["corr"] is None
    assert corr_pair(d.withColumn("c", F.col("a") * -2), "a", "c").first()["corr"] == pytest.approx(-1)


def test_variance_share_without_varying_propensity(spark):
    d = spark.createDataFrame([(float(i), 60.0 + i) for i in range(6)], "x double, z double")
    r = E.variance_share(d, M, 9).first()
    assert r["r2_p"] is None and r["r2_u"] > 0 and 0 < r["share_observed"] < 1
