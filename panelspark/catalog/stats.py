"""Percentile tables, moments, bins, densities."""

from pyspark.sql import functions as F

from panelspark.catalog.registry import query
from panelspark.operators import stats as T
from panelspark.plans import inputs as I, panel as P, sample as S


def pct_sql(q: float, order: str, n: str, value: str) -> str:
    """The percentile rule over rows numbered 1..n: average at whole ranks, else the next rank."""
    p = f"({n} * {q} / 100.0::DOUBLE)"
    return (f"avg({value}) FILTER ({order} = greatest(ceil({p}), 1) OR "
            f"({p} = floor({p}) AND {order} = {p} + 1))")


def ranked_long(src: str, cols: list[str], by: str = "") -> str:
    part = f"PARTITION BY {by + ', ' if by else ''}variable"
    pick = f"{by}, " if by else ""
    parts = " UNION ALL ".join(f"SELECT {pick}'{c}' AS variable, {c}::DOUBLE AS x FROM {src}" for c in cols)
    return (f"SELECT *, row_number() OVER ({part} ORDER BY x) AS i, count(*) OVER ({part}) AS n "
            f"FROM ({parts}) WHERE x IS NOT NULL")


def tab_sql(src, cols, qs, by=""):
    pick = f"{by}, " if by else ""
    pcts = ", ".join(f"{pct_sql(q, 'i', 'n', 'x')} AS p{q}" for q in qs)
    return (f"WITH r AS ({ranked_long(src, cols, by)})\nMAIN SELECT {pick}variable, count(*) AS n, avg(x) AS mean, "
            f"stddev_samp(x) AS sd, {pcts} FROM r GROUP BY ALL")


DAY_COLS = ["worked", "worked_hours", "ot_hours", "leave_hours", "injured", "others_out", "rate", "rank_org"]
QS = [5, 10, 50, 90, 95]
P_OUT = ", ".join(f"p{q} d" for q in QS)


@query("tabstat", f"variable s, n l, mean d, sd d, {P_OUT}", tab_sql("@sample", DAY_COLS, QS))
def q_tabstat(spark, sf):
    return T.tabstat(S.estimation_sample(spark, sf), DAY_COLS, QS)


@query("tabstat_by_group", f"worked l, variable s, n l, mean d, sd d, {P_OUT}", tab_sql("@sample", ["worked_hours", "age"], QS, "worked"))
def q_tabstat_by_group(spark, sf):
    return T.tabstat(S.estimation_sample(spark, sf), ["worked_hours", "age"], QS, ["worked"])


@query("tabstat_scale", f"l_returnflag s, variable s, n l, mean d, sd d, {P_OUT}",
       tab_sql("lineitem", ["l_extendedprice", "l_quantity"], QS, "l_returnflag"))
def q_tabstat_scale(spark, sf):
    """Percentiles of a nearly continuous column over the largest table."""
    li = I.table(spark, sf, "lineitem", ["l_returnflag", "l_extendedprice", "l_quantity"])
    return T.tabstat(li, ["l_extendedprice", "l_quantity"], QS, ["l_returnflag"])


@query("tabstat_entity", f"variable s, n l, mean d, sd d, {P_OUT}", f"""
    WITH e AS (SELECT emp, count(*) AS days, sum(worked) AS worked, sum(injured) AS hurt, count(DISTINCT main_div) AS divs, max(age_ref) AS age
               FROM @sample GROUP BY emp), r AS ({ranked_long('e', ['days', 'worked', 'hurt', 'divs', 'age'])})
MAIN SELECT variable, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, {", ".join(f"{pct_sql(q, 'i', 'n', 'x')} AS p{q}" for q in QS)}
    FROM r GROUP BY variable""")
def q_tabstat_entity(spark, sf):
    """One row per person first, then the table over people."""
    e = S.estimation_sample(spark, sf).groupBy("emp").agg(
        F.count("*").alias("days"), F.sum("worked").alias("worked"), F.sum("injured").alias("hurt"),
        F.count_distinct("main_div").alias("divs"), F.max("age_ref").alias("age"))
    return T.tabstat(e, ["days", "worked", "hurt", "divs", "age"], QS)


DQ = [1, 5, 10, 25, 50, 75, 90, 95, 99]


@query("summarize_detail", "variable s, n l, mean d, sd d, variance d, skewness d, kurtosis d, min d, max d, " + ", ".join(f"p{q} d" for q in DQ), f"""
    WITH r AS ({ranked_long('@sample', ['worked_hours', 'rate', 'age'])}),
    m AS (SELECT variable, avg(x) AS mu FROM r GROUP BY variable)
MAIN SELECT r.variable, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, var_samp(x) AS variance,
           avg((x - mu) ** 3) / avg((x - mu) ** 2) ** 1.5 AS skewness, avg((x - mu) ** 4) / avg((x - mu) ** 2) ** 2 AS kurtosis,
           min(x) AS min, max(x) AS max, {", ".join(f"{pct_sql(q, 'i', 'n', 'x')} AS p{q}" for q in DQ)}
    FROM r JOIN m ON r.variable = m.variable GROUP BY r.variable""")
def q_summarize_detail(spark, sf):
    return T.summarize_detail(S.estimation_sample(spark, sf), ["worked_hours", "rate", "age"])


@query("median_flag", "emp l, day s, at_median l", f"""
    WITH r AS ({ranked_long('@daily', ['worked_hours'])}), m AS (SELECT {pct_sql(50, 'i', 'n', 'x')} AS med FROM r)
MAIN SELECT emp, day, (abs(worked_hours - med) < 0.000001)::INT AS at_median FROM @daily, m""")
def q_median_flag(spark, sf):
    return T.median_flag(P.daily(spark, sf), "worked_hours", "at_median")


@query("corr_pair", "weekday l, n l, corr d", """
    SELECT weekday, count(*) AS n, corr(others_out, worked) AS corr FROM @sample GROUP BY weekday""")
def q_corr_pair(spark, sf):
    return T.corr_pair(S.estimation_sample(spark, sf), "others_out", "worked", ["weekday"])


@query("freq_table", "weekday l, freq l, pct d, cum_pct d", """
    WITH c AS (SELECT weekday, count(*) AS freq FROM @sample WHERE worked = 1 GROUP BY 1)
MAIN SELECT weekday, freq, freq * 100.0::DOUBLE / sum(freq) OVER () AS pct,
           sum(freq) OVER (ORDER BY freq DESC, weekday ROWS UNBOUNDED PRECEDING) * 100.0::DOUBLE / sum(freq) OVER () AS cum_pct FROM c""")
def q_freq_table(spark, sf):
    return T.freq_table(S.estimation_sample(spark, sf).where(F.col("worked") == 1), "weekday")


@query("freq_table_part", "p_type s, freq l, pct d, cum_pct d", """
    WITH c AS (SELECT p_type, count(*) AS freq FROM part GROUP BY 1)
MAIN SELECT p_type, freq, freq * 100.0::DOUBLE / sum(freq) OVER () AS pct,
           sum(freq) OVER (ORDER BY freq DESC, p_type ROWS UNBOUNDED PRECEDING) * 100.0::DOUBLE / sum(freq) OVER () AS cum_pct FROM c""")
def q_freq_table_part(spark, sf):
    return T.freq_table(I.table(spark, sf, "part", ["p_type"]), "p_type")


def qbin_sql(src: str, y: str, x: str, n: int) -> str:
    cuts = ", ".join(f"{pct_sql(100 * i / n, 'i', 'n', 'x')} AS c{i}" for i in range(1, n))
    lst = ", ".join(f"c{i}" for i in range(1, n))
    return f"""
    WITH r AS (SELECT {x}::DOUBLE AS x, {y}::DOUBLE AS y, row_number() OVER (ORDER BY {x}) AS i, count(*) OVER () AS n
               FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    c AS (SELECT list_distinct([{lst}]) AS cuts FROM (SELECT {cuts} FROM r))
MAIN SELECT len(list_filter(cuts, lambda v: v < x)) + 1 AS bin, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y FROM r, c GROUP BY 1"""


@query("quantile_bins", "bin l, n l, mean_x d, mean_y d", qbin_sql("@sample", "worked", "others_leave", 20))
def q_quantile_bins(spark, sf):
    return T.quantile_bins(S.estimation_sample(spark, sf), "worked", "others_leave", 20)


@query("quantile_bins_scale", "bin l, n l, mean_x d, mean_y d", qbin_sql("lineitem", "l_discount", "l_extendedprice", 20))
def q_quantile_bins_scale(spark, sf):
    return T.quantile_bins(I.table(spark, sf, "lineitem", ["l_extendedprice", "l_discount"]), "l_discount", "l_extendedprice", 20)


@query("equal_width_bins", "bin l, start d, n l, fraction d, density d, mean_y d", """
    WITH m AS (SELECT min(others_leave) AS lo, (max(others_leave) - min(others_leave)) / 8.0::DOUBLE AS w, count(*) AS c FROM @sample),
    b AS (SELECT least(floor((others_leave - lo) / w), 7)::INT AS bin, worked, lo, w, c FROM @sample, m)
MAIN SELECT bin, any_value(lo) + bin * any_value(w) AS start, count(*) AS n, count(*) / any_value(c)::DOUBLE AS fraction,
           count(*) / any_value(c)::DOUBLE / any_value(w) AS density, avg(worked) AS mean_y FROM b GROUP BY bin""")
def q_equal_width_bins(spark, sf):
    return T.equal_width_bins(S.estimation_sample(spark, sf), "others_leave", 8, "worked")


def kde_sql(src: str, x: str, points: int) -> str:
    return f"""
    WITH r AS (SELECT {x}::DOUBLE AS x, row_number() OVER (ORDER BY {x}) AS i, count(*) OVER () AS n FROM {src} WHERE {x} IS NOT NULL),
    s AS (SELECT stddev_samp(x) AS sd, ({pct_sql(75, 'i', 'n', 'x')} - {pct_sql(25, 'i', 'n', 'x')}) / 1.349 AS iqr,
                 min(x) AS lo, max(x) AS hi, count(*) AS n FROM r),
    h AS (SELECT *, 0.9 * (CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END) * n ** (-0.2::DOUBLE) AS h FROM s),
    g AS (SELECT point, lo - h + point * (hi - lo + 2 * h) / {points - 1} AS x_at, h, n FROM h, (SELECT unnest(range(0, {points})) AS point))
MAIN SELECT point, x_at, sum(CASE WHEN ((x_at - x) / h) ** 2 < 5 THEN 0.75 / sqrt(5.0::DOUBLE) * (1 - ((x_at - x) / h) ** 2 / 5) ELSE 0 END)
           / any_value(g.n * h) AS density FROM r, g GROUP BY point, x_at"""


@query("kde_grid", "point l, x_at d, density d", kde_sql("@daily", "work_pay", 50))
def q_kde_grid(spark, sf):
    return T.kde_grid(P.daily(spark, sf), "work_pay", 50)
