"""Linear and binary estimators with elimination-in-SQL checks."""

from pyspark.sql import functions as F

from panelspark.catalog.network import SHARES
from panelspark.catalog.registry import query
from panelspark.catalog.scalars import cdf_text
from panelspark.operators import linear as L
from panelspark.plans import network as C, sample as S

X = ["worked", "age", "rate"]
IVX = ["bar_others_out", "bar_rate", "age"]


def center(src: str, cols: list[str], keep: str = "") -> str:
    cols = list(dict.fromkeys(cols))
    have = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    k = f"{keep}, " if keep else ""
    return f"SELECT {k}{', '.join(f'{c} - avg({c}) OVER () AS {c}' for c in cols)} FROM {src} WHERE {have}"


def demean(src: str, cols: list[str], factors: list[str], sweeps: int, tag: str, keep: str) -> list[str]:
    """CTEs <tag>0..: alternate group means `sweeps` times."""
    have = " AND ".join(f"{c} IS NOT NULL" for c in dict.fromkeys(cols))
    ctes = [f"{tag}0 AS MATERIALIZED (SELECT {keep}, {', '.join(factors)}, {', '.join(f'{c}::DOUBLE AS {c}' for c in cols)} FROM {src} WHERE {have})"]
    for i in range(1, sweeps * len(factors) + 1):
        f = factors[(i - 1) % len(factors)]
        ctes.append(f"{tag}{i} AS MATERIALIZED (SELECT {keep}, {', '.join(factors)}, "
                    f"{', '.join(f'{c} - avg({c}) OVER (PARTITION BY {f}) AS {c}' for c in cols)} FROM {tag}{i - 1})")
    return ctes


def solve(src: str, rows: list[str], cols: list[str], rhs: list[str], tag: str) -> list[str]:
    """CTEs ending in <tag>: b_<rhs>_<i> and inverse entries v_<i>_<j> of (rows' cols)^-1 by elimination."""
    p, names = len(rows), cols + [f"{r}" for r in rhs]
    cell = {(i, j): f"sum({rows[i]} * {names[j]})" for i in range(p) for j in range(len(names))}
    for i in range(p):
        for j in range(p):
            cell[i, len(names) + j] = "1.0::DOUBLE" if i == j else "0.0::DOUBLE"
    width = len(names) + p
    ctes = [f"{tag}_0 AS MATERIALIZED (SELECT count(*) AS n, {', '.join(f'{cell[i, j]} AS m_{i}_{j}' for i in range(p) for j in range(width))} FROM {src})"]
    for k in range(p):
        out = []
        for i in range(p):
            for j in range(width):
                out.append(f"m_{k}_{j} / m_{k}_{k} AS m_{k}_{j}" if i == k
                           else f"m_{i}_{j} - m_{i}_{k} * m_{k}_{j} / m_{k}_{k} AS m_{i}_{j}")
        ctes.append(f"{tag}_{k + 1} AS MATERIALIZED (SELECT n, {', '.join(out)} FROM {tag}_{k})")
    out = [f"m_{i}_{p + r} AS b_{name}_{i}" for i in range(p) for r, name in enumerate(rhs)]
    out += [f"m_{i}_{len(names) + j} AS v_{i}_{j}" for i in range(p) for j in range(p)]
    ctes.append(f"{tag} AS MATERIALIZED (SELECT n, {', '.join(out)} FROM {tag}_{p})")
    return ctes


def resid(y: str, xs: list[str], name: str) -> str:
    return y + "".join(f" - b_{name}_{i} * {x}" for i, x in enumerate(xs))


def meat(src: str, sol: str, zs: list[str], e: str, cluster: str, tag: str) -> list[str]:
    s = ", ".join(f"sum({z} * ({e})) AS s{i}" for i, z in enumerate(zs))
    b = ", ".join(f"sum(s{i} * s{j}) AS w_{i}_{j}" for i in range(len(zs)) for j in range(len(zs)))
    return [f"{tag}_s AS (SELECT {cluster}, {s} FROM {src}, {sol} GROUP BY {cluster})",
            f"{tag} AS (SELECT count(*) AS g, {b} FROM {tag}_s)"]


def sandwich(p: int, j: int, left: str = "v", transpose: bool = False) -> str:
    at = (lambda a, b: f"{left}_{b}_{a}") if transpose else (lambda a, b: f"{left}_{a}_{b}")
    return "(" + " + ".join(f"{at(j, a)} * w_{a}_{b} * {at(j, b)}" for a in range(p) for b in range(p)) + ")"


def table(xs: list[str], value: dict[str, list[str]], src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS term, " + ", ".join(f"{v[i]} AS {n}" for n, v in value.items()) + f" FROM {src}" for i, x in enumerate(xs))


def terms(spark, fit, *stats):
    rows = [(t, float(b), float(s), *[float(fit.stats[k]) for k in stats]) for t, b, s in zip(fit.terms, fit.coef, fit.se)]
    return spark.createDataFrame(rows, "term string, coef double, se double" + "".join(f", {k} double" for k in stats))


def with_sql(ctes: list[str], main: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\nMAIN " + main


P3 = range(len(X))
E_Y = resid("injured", X, "injured")


@query("ols", "term s, coef d, se d, n l", with_sql(
    [f"d AS MATERIALIZED ({center('@sample', ['injured', *X])})", *solve("d", X, X, ["injured"], "o"),
     f"e AS (SELECT sum(({E_Y}) ** 2) AS rss FROM d, o)"],
    table(X, {"coef": [f"b_injured_{i}" for i in P3], "se": [f"sqrt(v_{i}_{i} * rss / (n - {len(X) + 1}))" for i in P3], "n": ["n"] * 3}, "o, e")))
def q_ols(spark, sf):
    return terms(spark, L.ols(S.estimation_sample(spark, sf), "injured", X), "n")


CL = [f"d AS MATERIALIZED ({center('@sample', ['injured', *X], 'emp')})", *solve("d", X, X, ["injured"], "o"),
      *meat("d", "o", X, E_Y, "emp", "c")]


@query("ols_cluster", "term s, coef d, se d, clusters l", with_sql(
    CL, table(X, {"coef": [f"b_injured_{i}" for i in P3],
                  "se": [f"sqrt({sandwich(3, i)} * (n - 1) / (n - {len(X) + 1}) * g / (g - 1))" for i in P3],
                  "clusters": ["g"] * 3}, "o, c")))
def q_ols_cluster(spark, sf):
    return terms(spark, L.ols_cluster(S.estimation_sample(spark, sf), "injured", X, "emp"), "clusters")


def factor_sql(factors: list[str], sweeps: int) -> str:
    last = f"f{sweeps * len(factors)}"
    levels = " + ".join(f"(SELECT count(DISTINCT {f}) FROM f0)" for f in factors)
    return with_sql([*demean("@sample", ["injured", *X], factors, sweeps, "f", "emp"), *solve(last, X, X, ["injured"], "o"),
                     *meat(last, "o", X, E_Y, "emp", "c"), f"l AS (SELECT {levels} - {len(factors) - 1} + {len(X)} AS k)"],
                    table(X, {"coef": [f"b_injured_{i}" for i in P3],
                              "se": [f"sqrt({sandwich(3, i)} * (n - 1) / (n - k) * g / (g - 1))" for i in P3]}, "o, c, l"))


@query("ols_factor", "term s, coef d, se d", factor_sql(["main_div"], 1))
def q_ols_factor(spark, sf):
    return terms(spark, L.ols_cluster(S.estimation_sample(spark, sf), "injured", X, "emp", ["main_div"]))


@query("ols_factor_two", "term s, coef d, se d", factor_sql(["main_div", "day"], 12))
def q_ols_factor_two(spark, sf):
    """Division and date effects together."""
    return terms(spark, L.ols_cluster(S.estimation_sample(spark, sf), "injured", X, "emp", ["main_div", "day"]))


FE_ROWS = "fe AS (SELECT emp, day, ot_work, bartik_scaled AS x FROM (SELECT *, bartik / (SELECT stddev_samp(bartik) FROM sh) AS bartik_scaled FROM sh))"


@query("fe_within", "term s, coef d", "WITH " + SHARES + ",\n" + ",\n".join(
    [FE_ROWS, *demean("fe", ["ot_work", "x"], ["day", "emp"], 25, "f", "1 AS one")]) +
    "\nMAIN SELECT 'bartik_scaled' AS term, sum(x * ot_work) / sum(x * x) AS coef FROM f50")
def q_fe_within(spark, sf):
    """Overtime on scaled exposure with day and person effects."""
    fit = L.fe_within(C.shares(spark, sf), "ot_work", "bartik_scaled", ["day", "emp"])
    return terms(spark, fit)


@query("residualize", "emp l, day s, resid d", with_sql(
    [*demean("@sample", ["others_out", "age", "rate"], ["main_div", "day"], 12, "f", "emp"),
     *solve("f24", ["age", "rate"], ["age", "rate"], ["others_out"], "o")],
    f"SELECT emp, day, {resid('others_out', ['age', 'rate'], 'others_out')} AS resid FROM f24, o"))
def q_residualize(spark, sf):
    return L.residualize(S.estimation_sample(spark, sf), "others_out", ["age", "rate"], ["main_div", "day"], ["emp", "day"])


def iv_sql(factors: list[str], sweeps: int = 1) -> str:
    xs, zs = ["worked", *IVX], ["others_out", *IVX]
    p, cols = len(xs), ["injured", *xs, "others_out"]
    if factors:
        last = f"d{sweeps * len(factors)}"
        head = [*demean("@sample", cols, factors, sweeps, "d", "emp"), f"d AS (SELECT * FROM {last})"]
        k = " + ".join(f"(SELECT count(DISTINCT {f}) FROM d0)" for f in factors) + f" - {len(factors) - 1} + {p}"
    else:
        head, k = [f"d AS MATERIALIZED ({center('@sample', cols, 'emp')})"], str(p + 1)
    ctes = [*head, f"dim AS (SELECT {k} AS k)",
            *solve("d", zs, xs, ["injured"], "o"), *meat("d", "o", zs, resid("injured", xs, "injured"), "emp", "c"),
            *solve("d", zs, zs, ["worked"], "f"), *meat("d", "f", zs, resid("worked", zs, "worked"), "emp", "h"),
            f"r AS (SELECT sum(({resid('worked', zs, 'worked')}) ** 2) AS rss FROM d, f)",
            *solve("d", IVX, IVX, ["others_out", "worked"], "u"),
            f"q AS (SELECT emp, ({resid('others_out', IVX, 'others_out')}) * ({resid('worked', IVX, 'worked')}) AS s FROM d, u)",
            "lm AS (SELECT sum(s) ** 2 / sum(s * s) AS lm FROM (SELECT sum(s) AS s FROM q GROUP BY emp))",
            f"""fs AS (SELECT f.b_worked_0 ** 2 / (f.v_0_0 * rss / (f.n - k)) AS cdf,
                f.b_worked_0 ** 2 / ({sandwich(p, 0).replace('v_', 'f.v_').replace('w_', 'h.w_')} * (f.n - 1) / (f.n - k) * h.g / (h.g - 1)) AS rkf
              FROM f, r, h, dim)"""]
    return with_sql(ctes, table(xs, {"coef": [f"b_injured_{i}" for i in range(p)],
                                     "se": [f"sqrt({sandwich(p, i)})" for i in range(p)],
                                     "cdf": ["cdf"] * p, "rkf": ["rkf"] * p, "lm": ["lm"] * p}, "o, c, fs, lm"))


IV_OUT = "term s, coef d, se d, cdf d, rkf d, lm d"


def q_iv(spark, sf, factors):
    fit = L.iv_2sls(S.estimation_sample(spark, sf), "injured", "worked", "others_out", IVX, factors, "emp")
    return terms(spark, fit, "cdf", "rkf", "lm")


@query("iv_2sls", IV_OUT, iv_sql([]))
def q_iv_2sls(spark, sf):
    return q_iv(spark, sf, [])


@query("iv_2sls_division", IV_OUT, iv_sql(["main_div"]))
def q_iv_2sls_division(spark, sf):
    return q_iv(spark, sf, ["main_div"])


@query("iv_2sls_date", IV_OUT, iv_sql(["main_div", "day"], 12))
def q_iv_2sls_date(spark, sf):
    """Division and date effects partialled out."""
    return q_iv(spark, sf, ["main_div", "day"])


@query("iv_2sls_factors", "model s, term s, coef d, se d, z d, p d, stars s")
def q_iv_2sls_factors(spark, sf):
    """The four control sets side by side."""
    s = S.estimation_sample(spark, sf)
    sets = {"none": [], "division": ["main_div"], "division, weekday": ["main_div", "weekday"], "division, date": ["main_div", "day"]}
    return L.model_table(spark, {n: L.iv_2sls(s, "injured", "worked", "others_out", IVX, f, "emp") for n, f in sets.items()})


@query("instrument_relevance", "model s, term s, coef d, se d, z d, p d, stars s")
def q_instrument_relevance(spark, sf):
    """First stages with growing controls, and balance of claim cost on the instrument."""
    s = S.estimation_sample(spark, sf)
    bars, ctl = ["bar_others_out", "bar_rate", "others_out"], ["age", "rate", "rank_org"]
    fits = {"relevance 1": L.ols_cluster(s, "worked", bars, "emp"),
            "relevance 2": L.ols_cluster(s, "worked", bars + ctl, "emp"),
            "relevance 3": L.ols_cluster(s, "worked", bars + ctl, "emp", ["main_div"]),
            "relevance 4": L.ols_cluster(s, "worked", bars + ctl, "emp", ["main_div", "weekday"]),
            "relevance 5": L.ols_cluster(s, "worked", bars + ctl, "emp", ["main_div", "day"])}
    cost = s.where(F.col("injured") == 1).withColumn("medpd", F.coalesce("medpd", F.lit(0.0)))
    fits["balance 1"] = L.ols_cluster(cost, "medpd", ["others_out", *ctl], "emp")
    fits["balance 2"] = L.ols_cluster(cost, "medpd", ["others_out", *ctl], "emp", ["main_div"])
    return L.model_table(spark, fits)


def newton_sql(src: str, y: str, xs: list[str], rounds: int, link: str = "logit") -> list[str]:
    """Scoring steps, each an elimination of the weighted normal equations; ends in t<rounds>."""
    p, rows = len(xs) + 1, ["k", *xs]
    ctes = [f"d AS MATERIALIZED (SELECT {y}::DOUBLE AS y, 1.0::DOUBLE AS k, {', '.join(f'{x}::DOUBLE AS {x}' for x in xs)} FROM {src} WHERE "
            + " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs]) + ")",
            "t0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS t{i}" for i in range(p)) + ")"]
    mean = "1 / (1 + exp(-eta))" if link == "logit" else cdf_text("eta")
    dens = "pr * (1 - pr)" if link == "logit" else "exp(-eta * eta / 2) / sqrt(2 * pi())"
    for r in range(1, rounds + 1):
        eta = " + ".join(f"t{i} * {x}" for i, x in enumerate(rows))
        ctes.append(f"w{r} AS MATERIALIZED (SELECT *, dens * dens / (pr * (1 - pr)) AS wt, dens * (y - pr) / (pr * (1 - pr)) AS u FROM "
                    f"(SELECT *, {dens} AS dens FROM (SELECT *, {mean} AS pr FROM (SELECT d.*, {eta} AS eta FROM d, t{r - 1}))))")
        ctes.append(f"z{r} AS MATERIALIZED (SELECT {', '.join(f'sum({a} * {b} * wt) AS a_{i}_{j}' for i, a in enumerate(rows) for j, b in enumerate(rows))}, "
                    f"{', '.join(f'sum({a} * u) AS g_{i}' for i, a in enumerate(rows))} FROM w{r})")
        cell = {(i, j): f"a_{i}_{j}" for i in range(p) for j in range(p)} | {(i, p): f"g_{i}" for i in range(p)}
        ctes.append(f"s{r}_0 AS (SELECT {', '.join(f'{v} AS m_{i}_{j}' for (i, j), v in cell.items())} FROM z{r})")
        for k in range(p):
            out = [f"m_{k}_{j} / m_{k}_{k} AS m_{k}_{j}" if i == k else f"m_{i}_{j} - m_{i}_{k} * m_{k}_{j} / m_{k}_{k} AS m_{i}_{j}"
                   for i in range(p) for j in range(p + 1)]
            ctes.append(f"s{r}_{k + 1} AS MATERIALIZED (SELECT {', '.join(out)} FROM s{r}_{k})")
        ctes.append(f"t{r} AS MATERIALIZED (SELECT {', '.join(f't{i} + m_{i}_{p} AS t{i}' for i in range(p))} FROM t{r - 1}, s{r}_{p})")
    return ctes


@query("logit", "term s, coef d", with_sql(newton_sql("@sample", "worked", ["others_out", "age"], 8), " UNION ALL ".join(
    f"SELECT '{n}' AS term, t{i} AS coef FROM t8" for i, n in enumerate(["_cons", "others_out", "age"]))))
def q_logit(spark, sf):
    return terms(spark, L.binary_fit(S.estimation_sample(spark, sf), "worked", ["others_out", "age"], "logit"))


PROBIT_SRC = """pb AS MATERIALIZED (SELECT * FROM (SELECT *, bartik / (SELECT stddev_samp(bartik) FROM sh) AS bartik_scaled,
        avg(share_z) OVER (PARTITION BY emp) AS share_mean FROM sh) s JOIN (SELECT emp, day, worked_hours FROM @panel) USING (emp, day)
        WHERE leave_hours = 0 OR worked_hours > 0)"""


@query("probit", "term s, effect d", "WITH " + SHARES + ",\n" + ",\n".join(
    [PROBIT_SRC, *newton_sql("pb", "ot_work", ["bartik_scaled", "share_mean"], 9, "probit"),
     "e AS (SELECT avg(exp(-eta * eta / 2) / sqrt(2 * pi())) AS dens FROM (SELECT t0 * k + t1 * bartik_scaled + t2 * share_mean AS eta FROM d, t9))"])
    + "\nMAIN SELECT 'bartik_scaled' AS term, t1 * dens AS effect FROM t9, e UNION ALL SELECT 'share_mean', t2 * dens FROM t9, e")
def q_probit(spark, sf):
    """Overtime on scaled exposure and its person mean: average marginal effects."""
    d = C.shares(spark, sf).where((F.col("leave_hours") == 0) | (F.col("worked_hours") > 0))
    return L.probit(d, "ot_work", ["bartik_scaled", "share_mean"])[1]


def logit_level_sql(src: str, y: str, xs: list[str], level: str, rounds: int) -> list[str]:
    """Newton steps for slopes with one effect a level, each level taken out by its own count; ends in t<rounds> and i<rounds - 1> (inverse)."""
    p, have = len(xs), " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])
    ctes = [f"d0 AS (SELECT {level} AS lv, {y}::DOUBLE AS y, {', '.join(f'{x}::DOUBLE AS z{i}' for i, x in enumerate(xs))} FROM {src} WHERE {have})",
            "d AS MATERIALIZED (SELECT * FROM d0 WHERE lv IN (SELECT lv FROM d0 GROUP BY lv HAVING min(y) <> max(y)))",
            "a0 AS (SELECT DISTINCT lv, 0.0::DOUBLE AS a FROM d)", "t0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS t{i}" for i in range(p)) + ")"]
    for r in range(1, rounds + 1):
        eta = " + ".join(["a", *[f"t{i} * z{i}" for i in range(p)]])
        ctes.append(f"w{r} AS MATERIALIZED (SELECT *, y - pr AS u, pr * (1 - pr) AS wt FROM (SELECT d.*, 1 / (1 + exp(-({eta}))) AS pr FROM d JOIN a{r - 1} USING (lv), t{r - 1}))")
        ctes.append(f"l{r} AS MATERIALIZED (SELECT lv, sum(u) AS g, sum(wt) AS d, {', '.join(f'sum(wt * z{i}) AS b{i}, sum(u * z{i}) AS s{i}' for i in range(p))}, "
                    f"{', '.join(f'sum(wt * z{i} * z{j}) AS h{i}_{j}' for i in range(p) for j in range(p))} FROM w{r} GROUP BY lv)")
        cell = {(i, j): f"sum(h{i}_{j} - b{i} * b{j} / d)" for i in range(p) for j in range(p)} | {(i, p): f"sum(s{i} - b{i} * g / d)" for i in range(p)}
        cell |= {(i, p + 1 + j): "1.0::DOUBLE" if i == j else "0.0::DOUBLE" for i in range(p) for j in range(p)}
        width = 2 * p + 1
        ctes.append(f"s{r}_0 AS (SELECT {', '.join(f'{v} AS m_{i}_{j}' for (i, j), v in cell.items())} FROM l{r})")
        for k in range(p):
            out = [f"m_{k}_{j} / m_{k}_{k} AS m_{k}_{j}" if i == k else f"m_{i}_{j} - m_{i}_{k} * m_{k}_{j} / m_{k}_{k} AS m_{i}_{j}" for i in range(p) for j in range(width)]
            ctes.append(f"s{r}_{k + 1} AS MATERIALIZED (SELECT {', '.join(out)} FROM s{r}_{k})")
        ctes.append(f"t{r} AS MATERIALIZED (SELECT {', '.join(f't{i} + m_{i}_{p} AS t{i}' for i in range(p))} FROM t{r - 1}, s{r}_{p})")
        ctes.append(f"a{r} AS MATERIALIZED (SELECT lv, a + (g - {' - '.join(f'b{i} * m_{i}_{p}' for i in range(p))}) / d AS a FROM a{r - 1} JOIN l{r} USING (lv), s{r}_{p})")
    return ctes


@query("logit_fe", "term s, coef d, se d", "WITH " + SHARES + ",\n" + ",\n".join(
    [PROBIT_SRC, *logit_level_sql("pb", "ot_work", ["bartik_scaled", "share_mean"], "day", 10)])
    + "\nMAIN " + " UNION ALL ".join(f"SELECT '{n}' AS term, t{i} AS coef, sqrt(m_{i}_{3 + i}) AS se FROM t10, s10_2" for i, n in enumerate(["bartik_scaled", "share_mean"])))
def q_logit_fe(spark, sf):
    """Overtime on scaled exposure and its person mean, with an effect for every date."""
    d = C.shares(spark, sf).where((F.col("leave_hours") == 0) | (F.col("worked_hours") > 0))
    return terms(spark, L.logit_fe(d, "ot_work", ["bartik_scaled", "share_mean"], ["day"])[0])


@query("model_table", "model s, term s, coef d, se d, z d, p d, stars s")
def q_model_table(spark, sf):
    s = S.estimation_sample(spark, sf)
    return L.model_table(spark, {
        "1": L.ols_cluster(s, "injured", ["worked", "age"], "emp"),
        "2": L.ols_cluster(s, "injured", ["worked", "age", "rank_org", "rate"], "emp", ["main_div"]),
        "3": L.ols_cluster(s, "injured", ["worked", "age", "rank_org", "rate"], "emp", ["main_div", "day"])})
