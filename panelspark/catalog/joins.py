"""Merges and lookups."""

from pyspark.sql import functions as F

from panelspark.catalog.registry import query
from panelspark.operators import merge as M
from panelspark.plans import inputs as I, panel as P
from panelspark.operators.clean import case_label


@query("merge_report", "_merge l, n l", """
    SELECT CASE WHEN p.emp IS NULL THEN 2 WHEN d.emp IS NULL THEN 1 ELSE 3 END AS _merge, count(*) AS n
    FROM @skeleton p FULL JOIN @daily d ON p.emp = d.emp AND p.day = d.day GROUP BY 1""")
def q_merge_report(spark, sf):
    from panelspark.operators.reshape import panel_skeleton
    days = panel_skeleton(I.people(spark, sf), "emp", "hire", "term", I.LO, I.HI)
    return M.merge_report(days, P.daily(spark, sf).select("emp", "day", "worked_hours"), ["emp", "day"])[1]


@query("merge_full", "emp l, day s, worked_hours d, medpd d, _merge l", """
    SELECT coalesce(d.emp, c.emp) AS emp, coalesce(d.day, c.day) AS day, d.worked_hours, c.medpd,
           CASE WHEN d.emp IS NULL THEN 2 WHEN c.emp IS NULL THEN 1 ELSE 3 END AS _merge
    FROM (SELECT * FROM @daily WHERE worked_hours > 0) d FULL JOIN @claims c ON d.emp = c.emp AND d.day = c.day""")
def q_merge_full(spark, sf):
    d = P.daily(spark, sf).where(F.col("worked_hours") > 0).select("emp", "day", "worked_hours")
    return M.merge_report(d, I.claims(spark, sf).select("emp", "day", "medpd"), ["emp", "day"])[0]


@query("merge_m1_left", "emp l, day s, rain_known l, prcp d, medpd d", """
    SELECT d.emp, d.day, (w.prcp IS NOT NULL)::INT AS rain_known, w.prcp, c.medpd
    FROM @daily d LEFT JOIN @weather w ON d.day = w.day LEFT JOIN @claims c ON d.emp = c.emp AND d.day = c.day""")
def q_merge_m1_left(spark, sf):
    d = M.merge_m1_left(P.daily(spark, sf).select("emp", "day"), I.claims(spark, sf), ["emp", "day"], ["medpd"])
    d = M.merge_m1_left(d, I.weather(spark, sf), ["day"])
    return d.withColumn("rain_known", F.col("prcp").isNotNull().cast("int"))


@query("merge_must_match", "side s, n l", """
    SELECT 'matched' AS side, count(*) AS n FROM @pay p JOIN @codes c USING (code)
    UNION ALL SELECT 'unmatched', count(*) FROM @pay WHERE code NOT IN (SELECT code FROM @codes)
    UNION ALL SELECT 'day without rain', count(*) FROM @pay WHERE day NOT IN (SELECT day FROM @weather)""")
def q_merge_must_match(spark, sf):
    p = I.pay(spark, sf)
    n = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    hit, miss = M.merge_must_match(p, I.codes(spark, sf), ["code"])
    return (n(hit, "matched").unionByName(n(miss, "unmatched"))
            .unionByName(n(M.merge_must_match(p, I.weather(spark, sf), ["day"])[1], "day without rain")))


@query("merge_indicator_flag", "emp l, day s, is_holiday l, hurt l", """
    SELECT d.emp, d.day, (h.day IS NOT NULL)::INT AS is_holiday, (c.emp IS NOT NULL)::INT AS hurt
    FROM @daily d LEFT JOIN @holidays h ON d.day = h.day LEFT JOIN @claims c ON d.emp = c.emp AND d.day = c.day""")
def q_merge_indicator_flag(spark, sf):
    d = M.merge_indicator_flag(P.daily(spark, sf).select("emp", "day"), I.holidays(spark, sf), ["day"], "is_holiday")
    return M.merge_indicator_flag(d, I.claims(spark, sf), ["emp", "day"], "hurt")


@query("full_outer_align", "pos l, low s, mid s, high s", """
    WITH t AS (SELECT DISTINCT p_type, CASE WHEN p_size > 33 THEN 'high' WHEN p_size > 16 THEN 'mid' ELSE 'low' END AS cat FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY p_type) AS pos FROM t)
MAIN SELECT pos, max(p_type) FILTER (cat = 'low') AS low, max(p_type) FILTER (cat = 'mid') AS mid,
           max(p_type) FILTER (cat = 'high') AS high FROM r GROUP BY pos""")
def q_full_outer_align(spark, sf):
    p = case_label(I.table(spark, sf, "part", ["p_type", "p_size"]), "cat",
                   [(F.col("p_size") > 16, "mid"), (F.col("p_size") > 33, "high")], "low")
    return M.full_outer_align(p, "cat", "p_type", ["low", "mid", "high"])


@query("lookup_prior_period", "emp l, day s, week_hours d, month_hours d", """
    SELECT a.emp, a.day, w.cum_worked AS week_hours, m.cum_worked AS month_hours FROM @panel a
    LEFT JOIN @panel w ON w.emp = a.emp AND w.day = a.day - (dayofweek(a.day) + 1)::INT
    LEFT JOIN @panel m ON m.emp = a.emp AND m.day = date_trunc('month', a.day)::DATE - 1""")
def q_lookup_prior_period(spark, sf):
    p = P.panel(spark, sf).select("emp", "day", "cum_worked")
    p = M.lookup_prior_period(p, ["emp"], "day", "cum_worked", "week", "week_hours")
    return M.lookup_prior_period(p, ["emp"], "day", "cum_worked", "month", "month_hours")


@query("lookup_prior_month", "cust l, day s, spent d, before d", """
    WITH o AS (SELECT o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS spent FROM orders GROUP BY ALL)
MAIN SELECT a.*, b.spent AS before FROM o a LEFT JOIN o b ON a.cust = b.cust AND b.day = date_trunc('month', a.day)::DATE - 1""")
def q_lookup_prior_month(spark, sf):
    o = (I.table(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
         .groupBy(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"))
         .agg(F.sum("o_totalprice").alias("spent")))
    return M.lookup_prior_period(o, ["cust"], "day", "spent", "month", "before")


@query("cross_join_draws", "draw l, n l, worked d", """
    SELECT draw, count(*) AS n, sum(worked_hours) AS worked FROM @daily, (SELECT unnest(range(1, 21)) AS draw) GROUP BY draw""")
def q_cross_join_draws(spark, sf):
    d = M.cross_join_draws(P.daily(spark, sf).select("worked_hours"), 20)
    return d.groupBy("draw").agg(F.count("*").alias("n"), F.sum("worked_hours").alias("worked"))
