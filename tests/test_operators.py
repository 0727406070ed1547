"""Edge cases of the panel operators on small frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import dates as D
from panelspark.functions.draws import hash_normal2, hash_uniform
from panelspark.functions.missing import m_div, m_eq, m_ge, m_gt, m_le, m_lt, m_ne, sum0
from panelspark.functions.normal import bvn_cdf, norm_cdf, norm_inv, np_bvn, np_cdf, np_inv
from panelspark.operators import checks, clean, collapse, merge, ordered as O, ranks as R, reshape, stats


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n - 1)


def col(df, order, *names):
    rows = df.orderBy(*order).select(*names).collect()
    return [tuple(r) if len(names) > 1 else r[0] for r in rows]


def test_missing_compares(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 40.0), (3, None)], "i int, x double")
    got = col(d.select("i", m_gt(F.col("x"), 34).alias("gt"), m_lt(F.col("x"), 34).alias("lt"), m_ge(F.col("x"), 40).alias("ge"),
                       m_le(F.col("x"), F.lit(None).cast("double")).alias("le"), m_eq(F.col("x"), F.lit(None)).alias("eq"),
                       m_ne(F.col("x"), 1).alias("ne")), ["i"], "gt", "lt", "ge", "le", "eq", "ne")
    assert got == [(False, True, False, True, False, False), (True, False, True, True, False, True), (True, False, True, True, True, True)]
    assert d.select(m_div(F.lit(1.0), F.lit(0.0))).first()[0] is None
    assert d.where("i = 3").agg(sum0("x")).first()[0] == 0


def test_week_index(spark):
    d = spark.createDataFrame([(dt.date(2015, 12, 31),), (dt.date(2016, 12, 31),), (dt.date(2016, 1, 1),)], "d date")
    assert sorted(r[0] for r in d.select(D.week_index("d")).collect()) == [55 * 52 + 51, 56 * 52, 56 * 52 + 51]
    r = spark.createDataFrame([(dt.date(2024, 1, 7),)], "d date").select(D.dow("d"), D.prior_week_end("d"), D.prior_month_end("d")).first()
    assert tuple(r) == (0, dt.date(2024, 1, 6), dt.date(2023, 12, 31))


def test_fill_cascade(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("a", 3, None), ("a", 4, None), ("b", 1, None)], "k string, t int, v int")
    f = O.fill_cascade(d, ["k"], ["t"], "v", F.lit(None).cast("int"))
    assert col(f, ["k", "t"], "v") == [1, 1, 1, 1, None]
    assert col(O.ffill(d, ["k"], ["t"], ["v"]), ["k", "t"], "v") == [None, 1, 1, 1, None]
    assert col(O.bfill(d, ["k"], ["t"], ["v"]), ["k", "t"], "v") == [1, 1, None, None, None]


@pytest.mark.parametrize("bounded", [True, False])
def test_field_rank_ties(spark, bounded):
    d = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 3.0), (4, None)], "i int, x double").withColumn("g", F.lit(1))
    assert col(R.field_rank(d, ["g"], "x", "r", bounded), ["i"], "r") == [1, 1, 3, None]


@pytest.mark.parametrize("bounded", [True, False])
def test_rank_gaps(spark, bounded):
    rows = list(zip(range(6), [1, 2, 2, 5, None, 3], [0, 1, 1, 1, 1, 0]))
    d = spark.createDataFrame(rows, "i int, r int, f int").withColumn("g", F.lit(None).cast("int"))
    g = R.rank_gap_counts(d, ["g"], "r", F.col("f") == 1, "below", "above", bounded)
    assert col(g, ["i"], "below", "above") == [(3, 0), (1, 0), (1, 0), (0, 2), (0, 3), (1, 2)]


def test_leave_one_out_single(spark):
    d = spark.createDataFrame([(1, "a", 9.0), (2, "b", 0.0), (3, "b", 9.0), (4, None, 9.0), (5, None, 9.0)], "i int, g string, h double")
    s = collapse.leave_one_out_share(d, ["g"], F.col("h") > 0, "s")
    assert col(s, ["i"], "s") == [0.0, 1.0, 0.0, 1.0, 1.0]
    assert col(collapse.leave_one_out_count(d, ["g"], F.col("h") > 0, "c"), ["i"], "c") == [0, 1, 0, 1, 1]


def test_runs_and_modes(spark):
    d = spark.createDataFrame([(1, i, f) for i, f in enumerate([1, 1, 0, 1])], "k int, t int, f int")
    assert col(O.run_length(d, ["k"], ["t"], "f"), ["t"], "run", "run_length") == [(1, 2), (1, 2), (2, 1), (3, 1)]
    m = spark.createDataFrame([(1, v) for v in (2, 2, 3, 3)] + [(2, v) for v in (2, 2, 3)] + [(3, None)], "k int, v int")
    assert {r["k"]: r["m"] for r in collapse.mode_no_ties(m, ["k"], "v", "m").collect()} == {1: None, 2: 2}


def test_percentile_rule(spark):
    d = spark.createDataFrame([("a", float(v)) for v in range(1, 11)] + [("b", float(v)) for v in range(1, 12)], "g string, x double")
    got = {r["g"]: (r["p10"], r["p50"]) for r in stats.percentiles(d, ["x"], [10, 50], ["g"]).collect()}
    assert got == {"a": (1.5, 5.5), "b": (2.0, 6.0)}


def brute_percentile(x, q):
    x, p = np.sort(x), len(x) * q / 100
    if p == int(p):
        return (x[int(p) - 1] + x[min(int(p), len(x) - 1)]) / 2
    return x[int(np.ceil(p)) - 1]


def test_percentiles_of_a_hot_value(spark):
    """A third of the rows hold one value and half sit in one group."""
    rng = np.random.default_rng(0)
    x = np.where(rng.random(6000) < 0.34, 1.25, rng.lognormal(size=6000))
    g = np.where(rng.random(6000) < 0.5, 0, rng.integers(1, 40, 6000))
    d = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    got = stats.percentiles(d, ["x"], [5, 50, 95], ["g"]).collect()
    assert len(got) == len(set(g))
    for r in got:
        for q in (5, 50, 95):
            assert r[f"p{q}"] == pytest.approx(brute_percentile(x[g == r["g"]], q))


def test_positions_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(5000) < 0.4, 0, rng.integers(1, 30, 5000))
    v = rng.integers(0, 7, 5000)
    d = spark.createDataFrame([(int(a), f"t{b}", i) for i, (a, b) in enumerate(zip(g, v))], "g int, v string, i int")
    got = {r["i"]: r["pos"] for r in R.row_positions(d, ["g"], ["-v", "i"], "pos").collect()}
    for k in set(g):
        want = sorted(np.flatnonzero(g == k), key=lambda i: (-v[i], i))
        assert [got[i] for i in want] == list(range(1, len(want) + 1))


def test_rolling_is_inclusive(spark):
    d = spark.createDataFrame([(1, day(1), 1.0), (1, day(31), 1.0), (1, day(32), 1.0)], "k int, day date, v double")
    assert col(O.rolling_range_sum(d, ["k"], "day", "v", {"s": 30}), ["day"], "s") == [1.0, 2.0, 2.0]


def test_event_shift(spark):
    rows = [(1, day(1), 8.0, 0, "x"), (1, day(2), 0.0, 1, "y"), (2, day(1), 0.0, 0, "x"), (2, day(2), 0.0, 1, "y")]
    d = spark.createDataFrame(rows, "k int, day date, h double, e int, why string")
    s = O.shift_event_to_prior_day(d, ["k"], "day", "e", F.col("h") > 0, ["why"])
    assert col(s, ["k", "day"], "e", "why") == [(1, "y"), (0, "y"), (0, "x"), (1, "y")]
    q = O.shift_event_to_prior_day(d, ["k"], "day", "e", F.col("h") > 0, ["why"], from_earlier=True)
    assert col(q, ["k", "day"], "why")[0] is None


def test_first_after_event(spark):
    d = spark.createDataFrame([(1, day(i), int(i == 3), 1) for i in range(1, 7)], "k int, day date, e int, w int")
    assert col(O.first_n_after_event(d, ["k"], "day", "e", "w"), ["day"], "day") == [day(2), day(3), day(5), day(6)]
    # days without work after the event go until the second worked day
    d = spark.createDataFrame([(1, day(i), int(i == 3), int(i not in (4, 5))) for i in range(1, 8)], "k int, day date, e int, w int")
    assert col(O.first_n_after_event(d, ["k"], "day", "e", "w"), ["day"], "day") == [day(2), day(3), day(7)]


def test_staged_collapse_nets_within_code(spark):
    rows = [(1, 1, "not leave", None, 8.0), (1, 1, "not leave", None, -8.0), (1, 1, "vac", None, -2.0), (1, 1, "sick", 1, 5.0)]
    d = spark.createDataFrame(rows, "k int, d int, kind string, sick int, h double").withColumns({"m": F.lit(None).cast("int"), "r": F.lit(1.0)})
    r = collapse.staged_collapse(d, ["k", "d"], "kind", "sick", "h", [], "m", "r").first()
    assert (r["worked_hours"], r["leave_hours"], r["sick_hours"]) == (0.0, 5.0, 5.0)


def test_text_ordered_ids(spark):
    d = spark.createDataFrame([("E 10",), ("E 2",), ("E 10",)], "n string")
    assert sorted(map(tuple, R.group_id(d, ["n"], "id").collect())) == [("E 10", 1), ("E 10", 1), ("E 2", 2)]


def test_merge_report_and_checks(spark):
    a = spark.createDataFrame([(1, None, 1.0), (2, "x", 2.0), (3, "x", 3.0)], "k int, j string, v double")
    b = spark.createDataFrame([(1, None, 9.0), (4, "y", 8.0)], "k int, j string, v double")
    m, n = merge.merge_report(a, b, ["k", "j"])
    assert {r["_merge"]: r["n"] for r in n.collect()} == {1: 2, 2: 1, 3: 1}
    assert sorted((r["k"], r["v"]) for r in m.collect()) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 8.0)]
    bad = {r["check"]: r["n_violations"] for r in checks.check_match(m, {"no left": [2], "no both": [3]}).collect()}
    assert bad == {"no left": 1, "no both": 1}
    with pytest.raises(ValueError, match="no left"):
        checks.require(checks.check_match(m, {"no left": [2]}))
    c = {r["check"]: r["n_violations"] for r in checks.constancy_in_group(a, ["j"], ["v"]).collect()}
    assert c == {"v": 1}


def test_skeleton_open_end(spark):
    p = spark.createDataFrame([(1, day(-3), None), (2, day(2), day(3)), (3, day(1), day(40))], "k int, s date, e date")
    s = reshape.panel_skeleton(p, "k", "s", "e", day(1), day(5))
    assert {r["k"]: r["count"] for r in s.groupBy("k").count().collect()} == {1: 5, 2: 2, 3: 5}


def test_dedup_first_missing_last(spark):
    d = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (2, None, "c")], "k int, o int, v string")
    assert sorted(map(tuple, clean.dedup_key_first(d, ["k"], ["o", "v"]).collect())) == [(1, 2, "b"), (2, None, "c")]


def test_drop_entity_missing_key(spark):
    d = spark.createDataFrame([(None, 1), (None, 0), (1, 0), (2, 1)], "k int, f int")
    assert [tuple(r) for r in clean.drop_entity_if_any(d, ["k"], F.col("f") == 1).collect()] == [(1, 0)]


def test_all_missing_rate_goes_through_the_sentinel(spark):
    d = spark.createDataFrame([(1, day(1), 20.0), (1, day(2), None), (1, day(3), 50.0)], "k int, day date, r double")
    r = clean.recode_sentinel(d, "r", m_gt(F.col("r"), 34))
    assert col(r, ["day"], "r", "r_sentinel") == [(20.0, 0), (None, 1), (None, 1)]
    assert col(O.ffill(r, ["k"], ["day"], ["r"]), ["day"], "r") == [20.0, 20.0, 20.0]


def test_slots_show_a_third_unit(spark):
    d = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (1, 3, 5.0)], "k int, u int, h double")
    r = reshape.daily_slots(d, ["k"], ["h", "u"], {"unit": "u"}).first()
    assert (r["unit1"], r["unit2"], r["n_slots"]) == (2, 1, 3)


def test_normal_law(spark):
    x = [float(v) for v in np.linspace(-9, 9, 181)]
    d = spark.createDataFrame([(v,) for v in x], "x double")
    got = np.array([r[0] for r in d.select(norm_cdf("x"), "x").orderBy("x").collect()])
    assert np.allclose(got, np_cdf(np.array(x)), atol=1e-15)
    assert np_cdf(np.array([1.959963984540054]))[0] == pytest.approx(0.975, abs=1e-14)
    mid = d.where("abs(x) < 6").withColumn("p", norm_cdf("x")).withColumn("back", norm_inv("p"))
    assert mid.agg(F.max(F.abs(F.col("x") - F.col("back")))).first()[0] < 1e-6
    assert np_inv(0.975) == pytest.approx(1.959963984540054)
    r = d.withColumn("k", F.lit(0.3)).withColumn("r", F.lit(-0.6)).select("x", bvn_cdf("x", "k", -0.6).alias("a"), bvn_cdf("x", "k", "r").alias("b")).orderBy("x").toPandas()
    assert np.allclose(r["a"], np_bvn(r["x"].to_numpy(), 0.3, -0.6), atol=1e-12) and np.allclose(r["a"], r["b"], atol=1e-12)
    assert np_bvn(np.array([0.0]), np.array([0.0]), 0.5)[0] == pytest.approx(1 / 3)


def test_draws_do_not_depend_on_partitions(spark):
    d = spark.range(2000)
    e1, e2 = hash_normal2(5, -0.5, "id")
    f = lambda n: d.repartition(n).select("id", hash_uniform(1, "id").alias("u"), e1.alias("a"), e2.alias("b")).orderBy("id").toPandas()
    a, b = f(1), f(64)
    assert a.equals(b)
    assert abs(a["u"].mean() - 0.5) < 0.03 and abs(a["a"].std() - 1) < 0.06
    assert np.corrcoef(a["a"], a["b"])[0, 1] == pytest.approx(-0.5, abs=0.06)


def test_gap_tags(spark):
    d = spark.createDataFrame([(1, day(1)), (1, day(1)), (1, day(5)), (1, day(6)), (1, day(12))], "k int, day date")
    g = O.gap_days(d, ["k"], "day", day(2))
    assert col(g, ["day"], "gap") == [0, 0, 1, 6]
    assert O.max_gap(d, ["k"], "day", day(2)).first()["max_gap"] == 6
    t = O.gap_end_tag(d, ["k"], "day", day(2), 5)
    assert [r["gap_end"] for r in t.orderBy("day").collect()] == [None, None, None, None, day(12)]


def test_merge_report_keeps_hot_and_missing_keys(spark):
    """Half the rows on one key, a quarter without a key: counts are those of a full outer join, and the plan has none."""
    left = [(1, f"a{i}") for i in range(400)] + [(None, f"n{i}") for i in range(200)] + [(i, "x") for i in range(2, 202)]
    right = [(1, 10), (1, 11), (None, 5), (None, 6)] + [(i, i) for i in range(100, 300)]
    a, b = spark.createDataFrame(left, "k int, v string"), spark.createDataFrame(right, "k int, w int")
    m, n = merge.merge_report(a, b, ["k"])
    assert "FullOuter" not in m._jdf.queryExecution().optimizedPlan().toString()
    full = a.withColumn("l", F.lit(1)).join(b.withColumnRenamed("k", "k2").withColumn("r", F.lit(1)), F.col("k").eqNullSafe(F.col("k2")), "full_outer")
    want = sorted(map(str, full.select(F.coalesce("k", "k2"), "v", "w", F.when(F.col("l").isNull(), 2).when(F.col("r").isNull(), 1).otherwise(3)).collect()))
    assert sorted(str(tuple(r)) for r in m.collect()) == sorted(str(tuple(r)) for r in full.select(F.coalesce("k", "k2"), "v", "w", F.when(F.col("l").isNull(), 2).when(F.col("r").isNull(), 1).otherwise(3)).collect()) and want
    assert sum(r["n"] for r in n.collect()) == full.count()


def test_kernel_density_equals_the_sum_over_all_values(spark):
    import numpy as np
    from panelspark.operators import stats as T
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(100, 15, 3000), np.full(1500, 80.0), rng.exponential(3, 500)]).tolist()
    d = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)] + [("a", None)], "g string, x double")
    for by in (None, ["g"]):
        got = T.kde_grid(d, "x", 60, by).collect()
        for g in {r["g"] if by else None for r in got}:
            x = np.array([v for i, v in enumerate(values) if g is None or ("a" if i % 3 else "b") == g])
            rows = sorted((r for r in got if not by or r["g"] == g), key=lambda r: r["point"])
            assert len(rows) == 60
            at = np.array([r["x_at"] for r in rows])
            h = x.min() - at[0]
            z = (at[:, None] - x[None, :]) / h
            want = np.where(z * z < 5, 0.75 / 5**0.5 * (1 - z * z / 5), 0).sum(axis=1) / (len(x) * h)
            assert np.abs(np.array([r["density"] for r in rows]) - want).max() < 1e-12
