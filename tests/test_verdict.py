"""Nothing is lost, capped or ended in silence: collinear columns, unseen levels, names with "+", long chains."""

import datetime as dt

import numpy as np
import pytest

from panelspark.functions.normal import np_log_cdf
from panelspark.operators import graph as N
from panelspark.operators import linear as L
from panelspark.operators.keys import cut_lineage, drop_scratch
from panelspark.operators.selection import OUT, SEL, Model, selection_loglik, selection_predict, selection_probit
from panelspark.operators.solve import independent

DAY = dt.date(2024, 1, 1)


def weights(spark, members):
    d = spark.createDataFrame([(DAY, g, n) for g, n in members], "day date, grp string, node bigint")
    return N.contact_weights(d, "day", "grp", "node")


def test_group_name_with_plus(spark):
    w = weights(spark, [("a+b", 1), ("a+b", 2), ("a+b", 3), ("a", 4), ("b", 4), ("a\\", 5), ("\\+", 5)])
    got = {r["node"]: r["centrality"] for r in N.eigen_centrality(w).collect()}
    assert [got[n] for n in (1, 2, 3)] == pytest.approx([1, 1, 1]) and got[4] == got[5] == 0
    assert N.node_classes(w).select("cls").distinct().count() == 3


def test_chain_longer_than_any_round_limit(spark):
    members = [(f"g{i}", n) for i in range(450) for n in (i, i + 1)] + [("alone", 9999)]
    got = N.components(N.class_links(weights(spark, members)))
    assert {r["label"] for r in got.collect()} == {0, 9999}
    assert N.largest_component(weights(spark, members)).agg({"n": "sum"}).first()[0] == 451


def test_cutoff_zero_keeps_every_pair(spark):
    w = weights(spark, [("a", 1), ("a", 2)] + [(f"g{i}", i) for i in range(3, 12)])
    kept, cut = N.threshold_edges(N.contact_edges(w), w, 0.5)
    c = cut.first()
    assert c["cutoff"] == 0 and c["kept_pairs"] == 55 == kept.agg({"n_pairs": "sum"}).first()[0]


def test_centrality_that_does_not_settle_raises(spark):
    w = weights(spark, [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3), ("c", 4)])
    with pytest.raises(RuntimeError):
        N.eigen_centrality(w, tol=1e-14, max_iter=1)


def test_factors_that_do_not_settle_raise(spark):
    d = spark.createDataFrame([(i % 7, (i * i) % 5, float(i)) for i in range(60)], "f int, g int, v double")
    with pytest.raises(RuntimeError):
        L.absorb(d, ["v"], ["f", "g"], max_iter=2)


def test_rank_of_nested_factors(spark):
    d = spark.createDataFrame([(i % 12, (i % 12) // 3, float(i * i % 17)) for i in range(120)], "f int, g int, v double")
    assert L.absorb(d, ["v"], ["f", "g"])[1] == 12


def test_collinear_columns(spark):
    """Age is a sum of person and day effects; the second copy of a column adds nothing."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(20):
        for t in range(15):
            x = float(r.normal())
            rows.append((i, t, 20.0 + i + t / 365, x, 2 * x + 1, 0.5 * x + i - t + float(r.normal())))
    d = spark.createDataFrame(rows, "p int, t int, age double, x double, x2 double, y double")
    m = L.ols(d, "y", ["age", "x", "x2"], ["p", "t"], cluster="p")
    own = L.ols(d, "y", ["x"], ["p", "t"], cluster="p")
    assert m.omitted == {"age", "x2"} and m["age"] == m["x2"] == 0
    assert m["x"] == pytest.approx(own["x"]) and m.se[1] == pytest.approx(own.se[0])
    a = np.array(rows)
    dummies = np.column_stack([a[:, 3]] + [a[:, 0] == k for k in range(20)] + [a[:, 1] == k for k in range(1, 15)])
    assert m["x"] == pytest.approx(np.linalg.lstsq(dummies, a[:, 5], rcond=None)[0][0])
    res = L.residualize(d, "y", ["age", "x", "x2"], ["p", "t"], ["p"])
    assert res.count() == 300 and abs(res.agg({"resid": "sum"}).first()[0]) < 1e-6
    table = {x["term"]: x["stars"] for x in L.model_table(spark, {"m": m}).collect()}
    assert table["age"] == "omitted"


def test_instrument_explained_by_controls(spark):
    r = np.random.default_rng(3)
    rows = [(float(x), float(z), float(x + z + r.normal()), float(r.normal())) for x, z in r.normal(size=(200, 2))]
    d = spark.createDataFrame(rows, "x double, z double, d double, y double").withColumn("zz", 2 * L.F.col("x")).withColumn("x3", 3 * L.F.col("x"))
    with pytest.raises(ValueError):
        L.iv_2sls(d, "y", "d", "zz", ["x"])
    a, b = L.iv_2sls(d, "y", "d", "z", ["x"]), L.iv_2sls(d, "y", "d", "z", ["x", "x3"])
    assert b["d"] == pytest.approx(a["d"]) and b.omitted == {"x3"} and b["x3"] == 0


def test_independent():
    a = np.random.default_rng(1).normal(size=(50, 3))
    full = np.column_stack([a[:, 0], a[:, 0] + a[:, 1], a[:, 1], a[:, 2], np.zeros(50)])
    assert independent(full.T @ full) == [0, 1, 3]


def test_unseen_level_keeps_its_row(spark):
    m = Model(["x"], ["x"], {"f": [1, 2]}, {(OUT, "x", None): 0.5, (SEL, "x", None): 1.0, (SEL, "f", 2): 0.3}, 0.1)
    d = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3), (None, 0.4)], "f int, x double")
    got = selection_predict(d, m, ["psel", "pcond"]).collect()
    assert len(got) == 4 and sum(r["psel"] is None for r in got) == 2


def test_impossible_row_is_counted(spark):
    m = Model(["x"], ["x"], {}, {(OUT, "x", None): 1.0, (SEL, "x", None): 1.0}, 0.0)
    d = spark.createDataFrame([(0.1, 0, 0), (60.0, 0, 0), (None, 0, 0)], "x double, y int, s int")
    r = selection_loglik(d, m, "y", "s").first()
    assert r["n"] == 3 and r["n_unusable"] == 2 and r["loglik"] == pytest.approx(float(np_log_cdf(np.array(-0.1))))


def test_log_cdf_in_the_tail():
    x = np.array([-5.0, -7.0, -7.2, -20.0, -100.0, 3.0])
    want = [-15.064998393988727, -27.384307, -28.850, -203.917155, -5005.524209, -0.00135081]
    assert np_log_cdf(x) == pytest.approx(want, rel=1e-3)


def test_selection_marks_what_it_cannot_identify(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        x, z, e = r.normal(size=3)
        s = int(0.5 * x + z + e > 0)
        rows.append((float(x), float(2 * x), float(z), s, int(0.3 * x + 0.4 * e + r.normal() > 0) if s else None, i % 50))
    d = spark.createDataFrame(rows, "x double, xx double, z double, s int, y int, who int")
    m = selection_probit(d, "y", ["x", "xx"], "s", ["x", "xx", "z"], cluster="who")
    fit = m.fit()
    assert fit.omitted == {"outcome:xx", "select:xx"} and m.stats["converged"] == 1
    assert fit["outcome:xx"] == 0 and abs(fit["select:z"] - 1) < 0.25 and np.isfinite(fit.se).all()


def test_scratch_is_deleted(spark, monkeypatch):
    import os

    from panelspark.operators import keys
    monkeypatch.setattr(keys, "_scratch", {})
    cut_lineage(spark.range(5).toDF("id"))
    [[path]] = keys._scratch.values()
    assert os.path.exists(path) and drop_scratch(spark) == 1 and not os.path.exists(path)
