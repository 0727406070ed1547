"""Group statistics, reshape, set operations, sorting."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.catalog.registry import LEAVE, query
from panelspark.functions.missing import firstnm
from panelspark.operators import collapse as G, ranks as R, reshape as H
from panelspark.plans import inputs as I, panel as P, sample as S

PAY_STATS = "n l, hours d, rate_mean d, rate_sd d, lo d, hi d, rated l, codes l, mark l"


@query("collapse_multi", f"div l, day s, {PAY_STATS}", """
    SELECT div, day, count(rec) AS n, coalesce(sum(hours), 0) AS hours, avg(rate) AS rate_mean, stddev_samp(rate) AS rate_sd,
           min(hours) AS lo, max(hours) AS hi, count(rate) AS rated, count(DISTINCT code) AS codes,
           max(CASE WHEN code = 'error' THEN 1 END) AS mark FROM @pay GROUP BY div, day""")
def q_collapse_multi(spark, sf):
    return G.collapse_multi(I.pay(spark, sf), ["div", "day"], {
        "n": ("count", "rec"), "hours": ("sum", "hours"), "rate_mean": ("mean", "rate"), "rate_sd": ("sd", "rate"),
        "lo": ("min", "hours"), "hi": ("max", "hours"), "rated": ("count", "rate"), "codes": ("n_distinct", "code"),
        "mark": ("firstnm", F.when(F.col("code") == "error", 1))})


@query("staged_collapse", "emp l, day s, div l, worked_hours d, leave_hours d, sick_hours d, std_hours d, ot_hours d, work_pay d, ot_pay d, iod l, rate d",
       "SELECT * FROM @daily_div")
def q_staged_collapse(spark, sf):
    return P.daily_div(spark, sf)


@query("scale_collapse", "supp l, day s, hours d, kinds l, pay d", """
    SELECT l_suppkey AS supp, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS hours,
           count(DISTINCT l_returnflag) AS kinds, sum(l_extendedprice) AS pay FROM lineitem GROUP BY ALL""")
def q_scale_collapse(spark, sf):
    """Line items as records of their supplier, collapsed to supplier-days."""
    li = I.table(spark, sf, "lineitem", ["l_suppkey", "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice"])
    li = li.select(F.col("l_suppkey").alias("supp"), F.to_date("l_shipdate").alias("day"), "l_returnflag", "l_quantity", "l_extendedprice")
    return G.collapse_multi(li, ["supp", "day"], {
        "hours": ("sum", "l_quantity"), "kinds": ("n_distinct", "l_returnflag"), "pay": ("sum", "l_extendedprice")})


@query("firstnm", "emp l, day s, iod l", """
    SELECT emp, day, max(CASE WHEN code = 'error' THEN 1 END) AS iod FROM @pay GROUP BY emp, day""")
def q_firstnm(spark, sf):
    return (I.pay(spark, sf).withColumn("m", F.when(F.col("code") == "error", 1))
            .groupBy("emp", "day").agg(firstnm("m").alias("iod")))


@query("group_total", "emp l, day s, worked_hours d, total d, top d, mean d, n l, grand d", """
    SELECT emp, day, worked_hours, sum(worked_hours) OVER w AS total, max(worked_hours) OVER w AS top, avg(worked_hours) OVER w AS mean,
           count(rate) OVER w AS n, sum(worked_hours) OVER () AS grand FROM @daily WINDOW w AS (PARTITION BY day)""")
def q_group_total(spark, sf):
    d = G.group_total(P.daily(spark, sf).select("emp", "day", "worked_hours", "rate"), ["day"], {
        "total": ("sum", "worked_hours"), "top": ("max", "worked_hours"), "mean": ("mean", "worked_hours"), "n": ("count", "rate")})
    return G.group_total(d, [], {"grand": ("sum", "worked_hours")})


@query("ever_flag", "emp l, day s, ever_hurt l", "SELECT emp, day, max(injured) OVER (PARTITION BY emp) AS ever_hurt FROM @panel")
def q_ever_flag(spark, sf):
    return G.ever_flag(P.panel(spark, sf).select("emp", "day", "injured"), ["emp"], F.col("injured") == 1, "ever_hurt")


@query("leave_one_out_count", "emp l, day s, main_div l, out_others l, leave_others l, nosick_others l, idle_hours d", f"""
    SELECT emp, day, main_div, sum(({LEAVE})::INT) OVER w - ({LEAVE})::INT AS out_others,
           others_leave AS leave_others, others_leave_nosick AS nosick_others, others_leave_hours AS idle_hours
    FROM @ranked WINDOW w AS (PARTITION BY main_div, day)""")
def q_leave_one_out_count(spark, sf):
    p = P.leave_panel(spark, sf).select("emp", "day", "main_div", "leave_hours", "worked_hours",
                                        F.col("others_leave").alias("leave_others"), F.col("others_leave_nosick").alias("nosick_others"),
                                        F.col("others_leave_hours").alias("idle_hours"))
    return G.leave_one_out_count(p, ["main_div", "day"], (F.col("leave_hours") >= 8) & (F.col("worked_hours") == 0), "out_others")


@query("leave_one_out_share", "emp l, day s, share d", """
    SELECT emp, day, CASE WHEN div_size = 1 THEN 0 ELSE others_leave / (div_size - 1)::DOUBLE END AS share FROM @ranked""")
def q_leave_one_out_share(spark, sf):
    p = P.leave_panel(spark, sf).select("emp", "day", "main_div", "leave_hours")
    return G.leave_one_out_share(p, ["main_div", "day"], F.col("leave_hours") > 0, "share")


@query("count_distinct", "code s, n_emp l, n_day l, n_div l", """
    SELECT code, count(DISTINCT emp) AS n_emp, count(DISTINCT day) AS n_day, count(DISTINCT div) AS n_div FROM @pay GROUP BY code""")
def q_count_distinct(spark, sf):
    return G.count_distinct(I.pay(spark, sf), ["code"], ["emp", "day", "div"])


@query("events_per_day", "day s, n_props l", """
    SELECT CAST(ts AS DATE) AS day, count(DISTINCT props) AS n_props FROM events WHERE event_type = 'signup' GROUP BY 1""")
def q_events_per_day(spark, sf):
    e = I.table(spark, sf, "events", ["ts", "event_type", "props"]).where(F.col("event_type") == "signup")
    return G.count_distinct(e.withColumn("day", F.to_date("ts")), ["day"], ["props"])


@query("distinct_flags_by_year", "year s, recs l, people l, days l, codes l", """
    SELECT CASE WHEN grouping(y) = 1 THEN 'Overall' ELSE y END AS year, count(*) AS recs, count(DISTINCT o_custkey) AS people,
           count(DISTINCT (o_custkey, o_orderdate)) AS days, count(DISTINCT o_orderpriority) AS codes
    FROM (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders) GROUP BY GROUPING SETS ((y), ())""")
def q_distinct_flags_by_year(spark, sf):
    o = I.table(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_orderpriority"]).withColumn("year", F.year("o_orderdate"))
    return G.distinct_flags_by_year(o, "year", {"people": ["o_custkey"], "days": ["o_custkey", "o_orderdate"], "codes": ["o_orderpriority"]})


@query("group_share", "nature s, n l, share d, is_total l", """
    SELECT CASE WHEN grouping(nature) = 1 THEN 'All Types' ELSE nature END AS nature, count(*) AS n,
           count(*) / (SELECT count(*) FROM @claims)::DOUBLE AS share, grouping(nature) AS is_total
    FROM @claims GROUP BY GROUPING SETS ((nature), ())""")
def q_group_share(spark, sf):
    return G.group_share(I.claims(spark, sf), "nature")


@query("binned_mean", "bin d, mean d, n l", """
    SELECT floor(others_leave / 2.0 + 0.5) * 2 AS bin, avg(worked) AS mean, count(*) AS n FROM @sample GROUP BY 1""")
def q_binned_mean(spark, sf):
    return G.binned_mean(S.estimation_sample(spark, sf), "worked", "others_leave", 2)


@query("binned_mean_weekday", "weekday l, bin d, mean d, n l", """
    SELECT weekday, floor(others_leave / 2.0 + 0.5) * 2 AS bin, avg(worked) AS mean, count(*) AS n FROM @sample GROUP BY 1, 2""")
def q_binned_mean_weekday(spark, sf):
    return G.binned_mean(S.estimation_sample(spark, sf), "worked", "others_leave", 2, ["weekday"])


@query("work_rate_by_leave", "others_out l, work_rate d, injury_pct d, n l", """
    SELECT others_out, avg((worked_hours > 0)::INT) AS work_rate, avg(injured) * 100 AS injury_pct, count(*) AS n FROM @ranked GROUP BY 1""")
def q_work_rate_by_leave(spark, sf):
    """Flagship: records to panel to coworkers on leave to the mean work rate by their number."""
    p = P.leave_panel(spark, sf)
    return p.groupBy("others_out").agg(F.avg((F.col("worked_hours") > 0).cast("int")).alias("work_rate"),
                                       (F.avg("injured") * 100).alias("injury_pct"), F.count("*").alias("n"))


@query("group_mean_listwise", "main_div l, n l, mean_out d, sd_out d, mean_size d, sd_size d", """
    SELECT main_div, count(*) AS n, avg(out) AS mean_out, stddev_samp(out) AS sd_out, avg(size) AS mean_size, stddev_samp(size) AS sd_size
    FROM (SELECT main_div, day, sum(out_today) AS out, count(*) AS size FROM @based GROUP BY ALL) GROUP BY main_div""")
def q_group_mean_listwise(spark, sf):
    d = G.collapse_multi(P.leave_panel(spark, sf), ["main_div", "day"], {"out": ("sum", "out_today"), "size": ("count", "emp")})
    return G.group_mean_listwise(d, ["main_div"], ["out", "size"])


@query("event_prob_share", "emp l, share d, any_event l", """
    SELECT emp, sum((worked_hours > 0 AND leave_hours = 0)::INT) / nullif(sum((leave_hours = 0)::INT), 0)::DOUBLE AS share,
           max(injured) AS any_event FROM @panel GROUP BY emp""")
def q_event_prob_share(spark, sf):
    return G.event_prob_share(P.panel(spark, sf), ["emp"], F.col("worked_hours") > 0, F.col("leave_hours") == 0, "injured")


@query("mode_no_ties", "emp l, usual_stint l", "SELECT * FROM @modes")
def q_mode_no_ties(spark, sf):
    s = S.stints(spark, sf).where(F.col("active") == 1)
    return G.mode_no_ties(s, ["emp"], "stint_length", "usual_stint")


@query("mode_code", "emp l, top_code s", """
    SELECT emp, CASE WHEN count(*) = 1 THEN max(code) END AS top_code FROM
      (SELECT emp, code, rank() OVER (PARTITION BY emp ORDER BY count(*) DESC) AS r FROM @pay GROUP BY emp, code) WHERE r = 1 GROUP BY emp""")
def q_mode_code(spark, sf):
    return G.mode_no_ties(I.pay(spark, sf), ["emp"], "code", "top_code")


@query("group_id", "emp l, day s, grouped l, name_id l", """
    SELECT d.emp, d.day, dense_rank() OVER (ORDER BY div1 NULLS LAST, d.day) AS grouped, n.id AS name_id FROM @daily d
    JOIN (SELECT emp, row_number() OVER (ORDER BY 'E ' || emp) AS id FROM (SELECT DISTINCT emp FROM @daily)) n ON n.emp = d.emp""")
def q_group_id(spark, sf):
    """Ids by (division, day), and by name where names sort as text."""
    d = P.daily(spark, sf).select("emp", "day", "div1").withColumn("name", F.concat(F.lit("E "), F.col("emp").cast("string")))
    return R.group_id(R.group_id(d, ["div1", "day"], "grouped"), ["name"], "name_id")


@query("sort_multi", "div l, day s, hours d, rec l", "SELECT div, day, hours, rec FROM @pay")
def q_sort_multi(spark, sf):
    return H.sort_multi(I.pay(spark, sf), [("div", "asc"), ("day", "desc"), ("rec", "asc")])


@query("topk_per_group_dynamic", "div l, day s, rec l, position l", """
    SELECT div, day, rec, position FROM
      (SELECT *, row_number() OVER (PARTITION BY div, day ORDER BY pay_amount DESC NULLS LAST, rec) AS position,
              ceil(count(*) OVER (PARTITION BY div, day) / 4.0) AS quota FROM @pay) WHERE position <= quota""")
def q_topk_per_group_dynamic(spark, sf):
    """The best-paid quarter of each division-day's records."""
    p = I.pay(spark, sf).select("div", "day", "rec", "pay_amount")
    p = G.group_total(p, ["div", "day"], {"size": ("count", "rec")}).withColumn("quota", F.ceil(F.col("size") / 4))
    return R.topk_per_group_dynamic(p, ["div", "day"], ["-pay_amount", "rec"], "quota")


@query("every_nth_row", "day s, n l", """
    SELECT day, n FROM (SELECT *, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS m FROM
      (SELECT day, count(*) AS n FROM @pay GROUP BY day)) WHERE i = 1 OR i = m OR i % 3 = 0""")
def q_every_nth_row(spark, sf):
    return R.every_nth_row(I.pay(spark, sf).groupBy("day").agg(F.count("*").alias("n")), ["day"], 3)


@query("union_distinct_min", "emp l, day s, far l", """
    SELECT emp, min(day) AS day, (max(day) - min(day) > 7)::INT AS far FROM
      (SELECT emp, day FROM @claims UNION SELECT emp, term FROM @people WHERE term IS NOT NULL)
    WHERE day >= DATE '2024-01-05' GROUP BY emp""")
def q_union_distinct_min(spark, sf):
    """First of two event sources per person, with the sources that lie far apart marked."""
    c = I.claims(spark, sf).select("emp", "day")
    t = I.people(spark, sf).where(F.col("term").isNotNull()).select("emp", F.col("term").alias("day"))
    first, far = H.union_distinct_min([c, t], "emp", "day", dt.date(2024, 1, 5), 7)
    return (first.join(far.select("emp", F.lit(1).alias("far")), "emp", "left")
            .withColumn("far", F.coalesce("far", F.lit(0))))


@query("unpivot", "emp l, day s, measure s, hours d", """
    SELECT emp, day, measure, hours FROM (SELECT emp, day, worked_hours, leave_hours, sick_hours FROM @daily)
    UNPIVOT (hours FOR measure IN (worked_hours, leave_hours, sick_hours))""")
def q_unpivot(spark, sf):
    return H.unpivot(P.daily(spark, sf), ["emp", "day"], ["worked_hours", "leave_hours", "sick_hours"], "measure", "hours")


@query("pivot", "emp l, click d, view d, purchase d", """
    SELECT emp, sum(hours) FILTER (code = 'click') AS click, sum(hours) FILTER (code = 'view') AS view,
           sum(hours) FILTER (code = 'purchase') AS purchase FROM @pay GROUP BY emp""")
def q_pivot(spark, sf):
    return H.pivot(I.pay(spark, sf), ["emp"], "code", "hours", ["click", "view", "purchase"])


@query("panel_skeleton", "emp l, n l, first s, last s", """
    SELECT emp, count(*) AS n, min(day) AS first, max(day) AS last FROM @skeleton GROUP BY emp""")
def q_panel_skeleton(spark, sf):
    d = H.panel_skeleton(I.people(spark, sf), "emp", "hire", "term", I.LO, I.HI)
    return d.groupBy("emp").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


PANEL_OUT = ("emp l, day s, div1 l, div2 l, worked_hours d, leave_hours d, sick_hours d, std_hours d, ot_hours d, work_pay d, ot_pay d, "
             "rate d, injured l, medpd d, nature s, seen l, not_worked l, cum_worked d, cum_std d, cum_ot d, job_class s, hire s, prcp d, "
             "is_holiday l, rain l, week_ix l, month_ix l")


@query("panel_fill", PANEL_OUT, "SELECT * FROM @panel")
def q_panel_fill(spark, sf):
    return P.panel(spark, sf)


@query("panel_contiguous", "emp l, day s, step l", """
    SELECT emp, day, step FROM (SELECT emp, day, day - lag(day) OVER (PARTITION BY emp ORDER BY day) AS step FROM @daily) WHERE step <> 1""")
def q_panel_contiguous(spark, sf):
    return H.panel_contiguous(P.daily(spark, sf), "emp", "day")


@query("daily_slots", "emp l, day s, div1 l, div2 l, leave_1 d, leave_2 d, sick_1 d, sick_2 d, n_slots l, worked_hours d, rate d, hours_zeroed l",
       "SELECT * FROM @daily")
def q_daily_slots(spark, sf):
    return P.daily(spark, sf)
