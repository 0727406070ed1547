"""Selection-model quantities and allocation replicates.

Quantities with comparison SQL use fixed coefficients, so that the SQL can evaluate the same
formula; the fitted model has its own queries, checked in the tests.
"""

import math

from pyspark.sql import functions as F

from panelspark.catalog.estimators import with_sql
from panelspark.catalog.registry import query
from panelspark.catalog.scalars import cdf_text, u_sql
from panelspark.catalog.stats import kde_sql, pct_sql, ranked_long
from panelspark.functions.normal import W_A, W_B, W_C, W_D, W_E, W_F, bvn_rule, np_inv
from panelspark.operators import allocate as A, effects as E, linear as L, stats as T
from panelspark.operators.keys import cut_lineage, large
from panelspark.operators.selection import OUT, SEL, Model, index_columns, level_table, selection_loglik, selection_predict, selection_probit, usable
from panelspark.plans import inputs as I, sample as S

RHO = -0.6
COEF = {
    OUT: {"_cons": -1.2, "bar_others_out": 0.05, "bar_rate": 0.01, "age": -0.004, "rate": 0.006},
    SEL: {"_cons": 0.5, "bar_others_out": -0.05, "bar_rate": 0.01, "others_out": -0.1, "age": 0.003, "rate": 0.008}}
XS, ZS = [c for c in COEF[OUT] if c != "_cons"], [c for c in COEF[SEL] if c != "_cons"]
BARS = ["bar_others_out", "bar_rate"]


def weekdays():
    """Monday to Thursday."""
    return F.col("weekday").between(1, 4)


def demo() -> Model:
    """A model with stated coefficients and no factors."""
    return Model(XS, ZS, {}, {(eq, t, None): v for eq, c in COEF.items() for t, v in c.items()}, math.atanh(RHO))


def rows(spark, sf):
    return S.estimation_sample(spark, sf).dropna(subset=[*XS, *ZS])


def index_sql(eq: str, skip: tuple = ()) -> str:
    return " + ".join([f"{COEF[eq]['_cons']}::DOUBLE", *[f"{v}::DOUBLE * {t}" for t, v in COEF[eq].items() if t != "_cons" and t not in skip]])


BASE = [f"m AS MATERIALIZED (SELECT *, {index_sql(OUT)} AS xb, {index_sql(SEL)} AS zg, {index_sql(SEL, ('rate', 'others_out'))} AS base "
        f"FROM @sample WHERE rate IS NOT NULL AND bar_rate IS NOT NULL)"]
ROOT = math.sqrt(1 - RHO * RHO)


def bvn_text(h: str, k: str, rho: float) -> str:
    terms = " + ".join(f"{w!r}::DOUBLE * exp(-({h} * {h} + {k} * {k} - 2 * {h} * {k} * {s!r}::DOUBLE) / {2 * (1 - s * s)!r}::DOUBLE)"
                       for w, s in bvn_rule(rho))
    return f"({cdf_text(h)} * {cdf_text(k)} + {terms})"


def grid_sql(us) -> str:
    return "g AS (SELECT * FROM (VALUES " + ", ".join(f"({u!r}::DOUBLE, {np_inv(u)!r}::DOUBLE)" for u in us) + ") AS t(u, q))"


@query("selection_predict", "emp l, day s, xb d, xbsel d, psel d, pmargin d, pcond d", with_sql(
    BASE, f"SELECT emp, day, xb, zg AS xbsel, {cdf_text('zg')} AS psel, {cdf_text('xb')} AS pmargin, "
          f"{bvn_text('xb', 'zg', RHO)} / {cdf_text('zg')} AS pcond FROM m"))
def q_selection_predict(spark, sf):
    return selection_predict(rows(spark, sf), demo(), ["xb", "xbsel", "psel", "pmargin", "pcond"])


@query("selection_loglik", "loglik d, n l, n_selected l", with_sql(
    [*BASE, "t AS (SELECT worked, injured, xb, zg, -xb AS mxb, -zg AS mzg FROM m)"],
    f"SELECT sum(ln(CASE WHEN worked = 0 THEN {cdf_text('mzg')} WHEN injured = 1 THEN {bvn_text('xb', 'zg', RHO)} "
    f"ELSE {bvn_text('mxb', 'zg', -RHO)} END)) AS loglik, count(*) AS n, sum(worked) AS n_selected FROM t"))
def q_selection_loglik(spark, sf):
    return selection_loglik(rows(spark, sf), demo(), "injured", "worked")


GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@query("mte_curve", "u d, estimate d, n l", with_sql(
    [*BASE, grid_sql(GRID), f"e AS (SELECT u, (xb - q * {RHO}::DOUBLE) / {ROOT!r}::DOUBLE AS v FROM m, g WHERE weekday BETWEEN 1 AND 4)"],
    f"SELECT u, avg({cdf_text('v')}) AS estimate, count(*) AS n FROM e GROUP BY u"))
def q_mte_curve(spark, sf):
    return E.mte_curve(rows(spark, sf), demo(), GRID, weekdays())


LEAVE_GRID = [float(v) for v in range(0, 101, 10)]


@query("margins", "u d, estimate d, n l", with_sql(
    [*BASE, "g AS (SELECT unnest(range(0, 101, 10))::DOUBLE AS u)",
     f"e AS (SELECT u, xb AS h, zg + {COEF[SEL]['others_out']}::DOUBLE * (u - others_out) AS k FROM m, g)"],
    f"SELECT u, avg({bvn_text('h', 'k', RHO)} / {cdf_text('k')}) AS estimate, count(*) AS n FROM e GROUP BY u"))
def q_margins(spark, sf):
    """Mean conditional outcome probability with the leave count set to a grid."""
    return E.margins(rows(spark, sf), demo(), E.pcond, LEAVE_GRID, at="others_out")


SLOPE_TERMS = ["others_out", "rate", "age"]
DENS = {v: f"(exp(-{v} * {v} / 2) / sqrt(2 * pi()))" for v in ("xb", "zg")}
SLOPES = [*BASE, f"h AS MATERIALIZED (SELECT *, (zg - {RHO}::DOUBLE * xb) / {ROOT!r}::DOUBLE AS zx, (xb - {RHO}::DOUBLE * zg) / {ROOT!r}::DOUBLE AS xz FROM m WHERE weekday BETWEEN 1 AND 4)",
          f"q AS MATERIALIZED (SELECT *, {cdf_text('zg')} AS ps, {bvn_text('xb', 'zg', RHO)} AS j, {DENS['xb']} * {cdf_text('zx')} AS jx, {DENS['zg']} * {cdf_text('xz')} AS jz FROM h)"]


def slope_sql(t: str) -> str:
    beta, gamma = COEF[OUT].get(t, 0.0), COEF[SEL].get(t, 0.0)
    sel = f"{DENS['zg']} * {gamma!r}::DOUBLE"
    cond = f"(jx * {beta!r}::DOUBLE + (jz - j / ps * {DENS['zg']}) * {gamma!r}::DOUBLE) / ps"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS prediction, '{t}' AS term, '{kind}' AS kind, avg({d}{'' if kind == 'dydx' else f' * {t} / ({level})'}) AS estimate, count(*) AS n FROM q"
        for name, d, level in (("psel", sel, "ps"), ("pcond", cond, "j / ps")) for kind in ("dydx", "eyex"))


@query("margins_slopes", "prediction s, term s, kind s, estimate d, n l", with_sql(SLOPES, " UNION ALL ".join(slope_sql(t) for t in SLOPE_TERMS)))
def q_margins_slopes(spark, sf):
    """Average derivatives and elasticities of both predictions."""
    return E.margins_slopes(rows(spark, sf), demo(), SLOPE_TERMS, weekdays())


SURFACE = [*BASE, grid_sql([k / 100 for k in range(1, 100)]), f"p AS MATERIALIZED (SELECT xb, {cdf_text('zg')} AS psel FROM m WHERE weekday BETWEEN 1 AND 4)",
           f"s0 AS (SELECT u, psel, (xb - q * {RHO}::DOUBLE) / {ROOT!r}::DOUBLE AS v FROM p, g WHERE u > (SELECT min(psel) FROM p))",
           f"s AS MATERIALIZED (SELECT u, psel, {cdf_text('v')} AS mte FROM s0)"]


@query("mte_surface", "u d, bin d, mte_pct d, n l", with_sql(
    SURFACE, "SELECT u, floor(psel * 100) / 100 AS bin, avg(mte) * 100 AS mte_pct, count(*) AS n FROM s GROUP BY 1, 2"))
def q_mte_surface(spark, sf):
    return E.mte_surface(rows(spark, sf), demo(), 99, 0.01, weekdays())


@query("variance_share", "r2_both d, r2_u d, r2_p d, share_observed d, share_private d", with_sql(
    [*SURFACE, "r AS (SELECT corr(mte, u) AS a, corr(mte, psel) AS b, corr(u, psel) AS c FROM s)",
     f"x AS (SELECT corr(xb, zg) ** 2 * var_samp(xb) AS o FROM m WHERE weekday BETWEEN 1 AND 4)"],
    f"SELECT (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2_both, a * a AS r2_u, b * b AS r2_p, o / (o + {RHO * RHO!r}::DOUBLE) AS share_observed, "
    f"{RHO * RHO!r}::DOUBLE / (o + {RHO * RHO!r}::DOUBLE) AS share_private FROM r, x"))
def q_variance_share(spark, sf):
    return E.variance_share(rows(spark, sf), demo(), 99, weekdays())


BOUND = [round(0.01 * i, 2) for i in range(1, 99)]


@query("bound_integral", "integral d, n l", with_sql(
    [*BASE, grid_sql(BOUND), f"e AS (SELECT u, (xb - q * {RHO}::DOUBLE) / {ROOT!r}::DOUBLE AS v FROM m, g WHERE weekday BETWEEN 1 AND 4)"],
    f"SELECT sum(CASE WHEN u > 0.975 THEN 0.005 ELSE 0.01 END * {cdf_text('v')}) / (count(*) / {len(BOUND)}) AS integral, count(*) / {len(BOUND)} AS n FROM e"))
def q_bound_integral(spark, sf):
    return E.bound_integral(rows(spark, sf), demo(), 0.01, 0.98, 0.01, weekdays())


RISK = [round(0.001 + 0.09 * i, 3) for i in range(11)]


@query("labor_supply_curve", "u d, estimate d, n l", with_sql(
    [*BASE, grid_sql(RISK), f"""e AS (SELECT u, (zg + {COEF[SEL]['others_out']}::DOUBLE * (u - others_out) + {RHO}::DOUBLE * q) / {ROOT!r}::DOUBLE AS v
                                      FROM m, g WHERE weekday BETWEEN 1 AND 4)"""],
    f"SELECT u, avg({cdf_text('v')}) AS estimate, count(*) AS n FROM e GROUP BY u"))
def q_labor_supply_curve(spark, sf):
    return E.labor_supply_curve(rows(spark, sf), demo(), RISK, "others_out", weekdays())


@query("elasticity_grid", "u d, estimate d, share_above d", with_sql(
    [*BASE, grid_sql(GRID), f"e AS (SELECT u, xb, rate, (zg + {RHO}::DOUBLE * q) / {ROOT!r}::DOUBLE AS v FROM m, g)"],
    f"SELECT u, avg(exp(-v * v / 2) / sqrt(2 * pi()) * {COEF[SEL]['rate'] / ROOT!r}::DOUBLE * rate / {cdf_text('v')}) AS estimate, "
    f"avg((xb >= u)::INT) AS share_above FROM e GROUP BY u"))
def q_elasticity_grid(spark, sf):
    return E.elasticity_grid(rows(spark, sf), demo(), "rate", GRID)


def inv_text(p: str) -> str:
    """The quantile function of a named column as SQL text."""
    def poly(z, cs):
        cs = tuple(reversed(cs))
        return "".join("(" for _ in cs[1:]) + f"{cs[0]!r}::DOUBLE" + "".join(f" * {z} + {c!r}::DOUBLE)" for c in cs[1:])
    q = f"({p} - 0.5)"
    c = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END))"
    near, far = f"({r} - 1.6)", f"({r} - 5)"
    tail = f"(CASE WHEN {r} <= 5 THEN {poly(near, W_C)} / {poly(near, W_D)} ELSE {poly(far, W_E)} / {poly(far, W_F)} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {poly(c, W_A)} / {poly(c, W_B)} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def value_ctes(where: str) -> list[str]:
    rate = COEF[OUT]["rate"] - RHO * COEF[SEL]["rate"]
    nodes = list(zip(E.NODES, E.NODE_WEIGHTS))
    a = ", ".join(f"(xb - {RHO * x!r}::DOUBLE) / {ROOT!r}::DOUBLE AS a{i}" for i, (x, _) in enumerate(nodes))
    p = ", ".join(f"{cdf_text(f'a{i}')} + 1.0::DOUBLE / n AS p{i}" for i in range(5))
    v = " + ".join(f"{w}::DOUBLE * (a{i} - {inv_text(f'p{i}')}) * {ROOT!r}::DOUBLE" for i, (_, w) in enumerate(nodes))
    return [*BASE, f"va AS MATERIALIZED (SELECT emp, day, {a}, count(*) OVER () AS n FROM m {where})",
            f"vp AS MATERIALIZED (SELECT *, {p} FROM va)",
            f"vv AS MATERIALIZED (SELECT emp, day, n, ({v}) * {-8 / math.pi / rate!r}::DOUBLE AS value FROM vp)"]


@query("quadrature_value", "m d, wtp d, total d, n l", with_sql(
    [*value_ctes("WHERE weekday BETWEEN 1 AND 4"), "k AS (SELECT unnest([1.0, 2.0])::DOUBLE AS m)"],
    "SELECT k.m, avg(value) * k.m AS wtp, sum(value) * k.m AS total, count(*) AS n FROM vv, k GROUP BY k.m"))
def q_quadrature_value(spark, sf):
    return E.quadrature_value(rows(spark, sf), demo(), "rate", [1, 2], where=weekdays())


@query("value_rows", "emp l, day s, value d", with_sql(value_ctes(""), "SELECT emp, day, value FROM vv"))
def q_value_rows(spark, sf):
    r = rows(spark, sf)
    return E.row_values(r, demo(), "rate", r.count())


@query("fe_components", "n l, mean_work d, var_work d, mean_inj d, var_inj d, corr d, joint_corr d", with_sql(
    [*BASE, f"f AS (SELECT {' + '.join(f'{COEF[SEL][b]}::DOUBLE * {b}' for b in BARS)} AS w, {' + '.join(f'{COEF[OUT][b]}::DOUBLE * {b}' for b in BARS)} AS i FROM m)"],
    f"""SELECT count(*) AS n, avg(w) AS mean_work, var_samp(w) AS var_work, avg(i) AS mean_inj, var_samp(i) AS var_inj, corr(w, i) AS corr,
        ({RHO}::DOUBLE + corr(w, i) * sqrt(var_samp(w) * var_samp(i))) / sqrt((1 + var_samp(w)) * (1 + var_samp(i))) AS joint_corr FROM f"""))
def q_fe_components(spark, sf):
    return E.fe_components(rows(spark, sf), demo(), BARS)


# ---- fitted model ------------------------------------------------------------

FACTORS = ["day", "main_div"]
FIT_X, FIT_Z = [*XS, "rank_org"], [*ZS, "rank_org"]


@I.stage
def _fit_frame(spark, sf):
    return cut_lineage(S.estimation_sample(spark, sf))


def in_sample():
    return usable("injured", FIT_X, "worked", FIT_Z, FACTORS, F.col("day_varies") == 1)


@query("selection_sample", "emp l, day s, worked l, sample_marked l", """
    SELECT emp, day, worked, (day_varies = 1 AND worked IS NOT NULL AND (worked = 0 OR injured IS NOT NULL) AND bar_others_out IS NOT NULL AND bar_rate IS NOT NULL
        AND age IS NOT NULL AND rate IS NOT NULL AND others_out IS NOT NULL AND rank_org IS NOT NULL AND main_div IS NOT NULL)::INT AS sample_marked FROM @sample""")
def q_selection_sample(spark, sf):
    """The rows that the main model uses."""
    return _fit_frame(spark, sf).select("emp", "day", "worked", in_sample().cast("int").alias("sample_marked"))


_fits: dict = {}


def fitted(spark, sf) -> Model:
    """The main model: date and division effects, seniority, errors by person; fitted once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fits:
        _fits[key] = selection_probit(_fit_frame(spark, sf), "injured", FIT_X, "worked", FIT_Z, FACTORS, "emp", F.col("day_varies") == 1)
    return _fits[key]


def marked(spark, sf):
    return _fit_frame(spark, sf).where(in_sample())


TABLE = "model s, term s, coef d, se d, z d, p d, stars s"


@query("selection_probit", TABLE)
def q_selection_probit(spark, sf):
    return L.model_table(spark, {"selection": fitted(spark, sf).fit()})


@query("selection_levels", "level s, out d, sel d, se_out d, se_sel d")
def q_selection_levels(spark, sf):
    """Effects of the dates in both equations."""
    return level_table(fitted(spark, sf))


@query("lincom_nlcom", "what s, value d, se d")
def q_lincom_nlcom(spark, sf):
    m = fitted(spark, sf)
    out = [("leave coefficient", *E.lincom_nlcom(m, SEL, "others_out")), ("rho", *E.lincom_nlcom(m, "athrho", "athrho", "tanh"))]
    return spark.createDataFrame([(a, float(b), float(c)) for a, b, c in out], "what string, value double, se double")


@query("margins_fitted", "u d, estimate d, se d, n l")
def q_margins_fitted(spark, sf):
    return E.margins(marked(spark, sf), fitted(spark, sf), E.pcond, LEAVE_GRID, at="others_out", vce="unconditional", cluster="emp")


@query("margins_slopes_fitted", "prediction s, term s, kind s, estimate d, se d, n l")
def q_margins_slopes_fitted(spark, sf):
    return E.margins_slopes(marked(spark, sf), fitted(spark, sf), ["others_out", "rank_org", "rate"], weekdays())


@query("elasticity_fitted", "u d, estimate d, se d, low d, high d, share_above d")
def q_elasticity_fitted(spark, sf):
    """Elasticity by risk quantile with error and interval."""
    e = E.elasticity_grid(marked(spark, sf), fitted(spark, sf), "rate", GRID, "emp")
    half = F.col("se") * E.NORMAL_975
    return e.select("u", "estimate", "se", (F.col("estimate") - half).alias("low"), (F.col("estimate") + half).alias("high"), "share_above")


@query("model_sweep", "name s, instrument d, se_i d, rho d, se_r d, margin d, se_m d, n l")
def q_model_sweep(spark, sf):
    """The main model and six others: leave without sick time, broader date effects, no strains, three cost thresholds.

    A missing cost is above every threshold.
    """
    base = dict(y="injured", x=FIT_X, select="worked", z=FIT_Z, instrument="others_out", factors=FACTORS, cluster="emp",
                where=F.col("day_varies") == 1, average=weekdays())
    broad = {**base, "factors": ["week", "weekday", "main_div"]}
    swap = lambda cols: [{"others_out": "others_leave_nosick", "bar_others_out": "bar_nosick"}.get(c, c) for c in cols]
    off = lambda cond: [("injured", cond, F.lit(0))]
    d = _fit_frame(spark, sf)
    means = d.where("day_varies = 1").groupBy("emp").agg(F.avg("others_leave_nosick").alias("bar_nosick"))
    return E.model_sweep(d.join(large(means), "emp", "left"), [
        {**base, "name": "base"},
        {**base, "name": "sick time excluded from leave", "x": swap(FIT_X), "z": swap(FIT_Z), "instrument": "others_leave_nosick"},
        {**broad, "name": "broader date effects"},
        {**broad, "name": "strains not injuries", "where": None, "update": off(F.col("nature") == "Strain")},
        *[{**broad, "name": f"cost up to {t} not injury", "update": off(F.col("medpd") <= t)} for t in (0, 200, 400)]])


# ---- allocation replicates ----------------------------------------------------

DRAWS = 20


@I.stage
def _alloc_rows(spark, sf):
    m = demo()
    d = index_columns(rows(spark, sf).where(weekdays()), m)
    base = F.col("zg") - F.col("rate") * m.get(SEL, "rate") - F.col("others_out") * m.get(SEL, "others_out")
    return cut_lineage(d.withColumn("base", base))


@I.stage
def _quota(spark, sf):
    return cut_lineage(A.shift_quota(_alloc_rows(spark, sf), "main_div", "day", "worked", "std_hours"))


@I.stage
def _draws(spark, sf):
    return A.draw_rows(_alloc_rows(spark, sf), _quota(spark, sf), "main_div", "day", "emp", 1, DRAWS, RHO)


QUOTA = [*BASE, "wd AS MATERIALIZED (SELECT * FROM m WHERE weekday BETWEEN 1 AND 4)",
         """quota AS MATERIALIZED (SELECT grp, day, shifts, extra_share, floor(shifts * extra_share + 0.5)::BIGINT AS additional,
                 shifts - floor(shifts * extra_share + 0.5)::BIGINT AS regular FROM
              (SELECT *, coalesce(greatest((sum(shifts) OVER g - sum(std) OVER g / 8) / nullif(sum(shifts) OVER g, 0), 0), 0) AS extra_share FROM
                (SELECT main_div AS grp, day, sum(worked)::BIGINT AS shifts, sum(std_hours)::DOUBLE AS std FROM wd GROUP BY ALL) WINDOW g AS (PARTITION BY grp)))"""]


@query("shift_quota", "grp l, day s, shifts l, extra_share d, additional l, regular l", with_sql(QUOTA, "SELECT * FROM quota"))
def q_shift_quota(spark, sf):
    return _quota(spark, sf)


KEY = ("draw", "emp", "w.day")
DRAWN = [*QUOTA, f"""dr0 AS MATERIALIZED (SELECT d.draw, w.main_div AS grp, w.day, w.emp, q.shifts, q.additional, q.regular, w.xb, w.zg, w.base,
        sqrt(-2 * ln({u_sql('allocta', *KEY)})) AS r, 2 * pi() * {u_sql('alloctb', *KEY)} AS t, {u_sql('alloclist', *KEY)} AS u_list,
        {u_sql('allocsplit', *KEY)} AS u_split, {u_sql('allocbest', *KEY)} AS u_best
      FROM wd w JOIN quota q ON q.grp = w.main_div AND q.day = w.day, (SELECT unnest(range(1, {DRAWS + 1})) AS draw) d)""",
         f"""dr AS MATERIALIZED (SELECT *, (zg > r * cos(t))::INT AS willing, base - r * cos(t) AS value,
        xb - ({RHO}::DOUBLE * r * cos(t) + {ROOT!r}::DOUBLE * r * sin(t)) AS risk FROM dr0)"""]


def rest_sql(u: str, order: str, tag: str) -> list[str]:
    return [f"""a_{tag} AS MATERIALIZED (SELECT *, (willing = 1 AND row_number() OVER (PARTITION BY draw, grp, day, willing ORDER BY {u}) <= regular)::INT AS reg FROM dr)""",
            f"b_{tag} AS MATERIALIZED (SELECT *, additional + regular - sum(reg) OVER (PARTITION BY draw, grp, day) AS open FROM a_{tag})",
            f"""c_{tag} AS MATERIALIZED (SELECT *, (reg = 1 OR row_number() OVER (PARTITION BY draw, grp, day, reg ORDER BY {order}, emp) <= open)::INT AS work
                FROM b_{tag})"""]


LIST = ["c_l AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY draw, grp, day ORDER BY willing DESC, u_list) <= shifts)::INT AS work FROM dr)"]
AUCTION, BEST = rest_sql("u_split", "value DESC", "s"), rest_sql("u_best", "risk", "f")
ROW_OUT = "draw l, emp l, day s, work l"


@query("alloc_list", ROW_OUT, with_sql([*DRAWN, *LIST], "SELECT draw, emp, day, work FROM c_l"))
def q_alloc_list(spark, sf):
    return A.alloc_list(_draws(spark, sf), "work")


@query("alloc_auction", ROW_OUT, with_sql([*DRAWN, *AUCTION], "SELECT draw, emp, day, work FROM c_s"))
def q_alloc_auction(spark, sf):
    return A.alloc_auction(_draws(spark, sf), "work")


@query("alloc_full_info", ROW_OUT, with_sql([*DRAWN, *BEST], "SELECT draw, emp, day, work FROM c_f"))
def q_alloc_full_info(spark, sf):
    return A.alloc_full_info(_draws(spark, sf), "work")


@I.stage
def _outcomes(spark, sf):
    return cut_lineage(A.alloc_outcomes(_alloc_rows(spark, sf), _quota(spark, sf), "main_div", "day", "emp", RHO, DRAWS))


OUTCOMES = [*DRAWN, *LIST, *AUCTION, *BEST,
            *[f"o_{t} AS (SELECT draw, sum((risk > 0)::INT * work) AS hits, sum(work) AS shifts FROM c_{t} GROUP BY draw)" for t in "lsf"],
            """oc AS MATERIALIZED (SELECT l.draw, l.hits AS list, s.hits AS auction, f.hits AS best, l.shifts AS list_shifts,
                 (s.hits - l.hits) / nullif(l.hits, 0)::DOUBLE AS pct_auction_list, (s.hits - f.hits) / nullif(s.hits, 0)::DOUBLE AS pct_auction_best,
                 (s.hits - l.hits) / l.shifts::DOUBLE AS diff_auction_list
               FROM o_l l JOIN o_s s USING (draw) JOIN o_f f USING (draw))"""]


@query("alloc_outcomes", "draw l, list l, auction l, best l, list_shifts l, pct_auction_list d, pct_auction_best d, diff_auction_list d",
       with_sql(OUTCOMES, "SELECT * FROM oc"))
def q_alloc_outcomes(spark, sf):
    return _outcomes(spark, sf)


@query("alloc_summary", "variable s, n l, mean d, sd d, p5 d, p95 d", with_sql(
    [*OUTCOMES, f"r AS ({ranked_long('oc', ['list', 'auction', 'best', 'pct_auction_list'])})"],
    f"SELECT variable, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, {pct_sql(5, 'i', 'n', 'x')} AS p5, {pct_sql(95, 'i', 'n', 'x')} AS p95 FROM r GROUP BY variable"))
def q_alloc_summary(spark, sf):
    return T.tabstat(_outcomes(spark, sf), ["list", "auction", "best", "pct_auction_list"], [5, 95])


@query("alloc_density", "point l, x_at d, density d", with_sql([*OUTCOMES, kde_sql("oc", "auction", 30).split("WITH ", 1)[1].split("\nMAIN ")[0]],
                                                            kde_sql("oc", "auction", 30).split("\nMAIN ")[1]))
def q_alloc_density(spark, sf):
    return T.kde_grid(_outcomes(spark, sf), "auction", 30)
