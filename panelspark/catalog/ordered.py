"""Ordered by-group operators on the person-day panel."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.catalog.registry import ONWARD, UPTO, query
from panelspark.functions.dates import years_between
from panelspark.functions.missing import flag
from panelspark.operators.keys import large
from panelspark.operators import ordered as O, ranks as R
from panelspark.plans import inputs as I, panel as P, sample as S

K, D = ["emp"], ["day"]


@query("lag_lead", "emp l, day s, before d, after d", """
    SELECT emp, day, lag(worked_hours) OVER w AS before, lead(worked_hours, 2) OVER w AS after
    FROM @panel WINDOW w AS (PARTITION BY emp ORDER BY day)""")
def q_lag_lead(spark, sf):
    p = O.lag_lead(P.panel(spark, sf), K, D, "worked_hours", 1, "before")
    return O.lag_lead(p, K, D, "worked_hours", -2, "after")


@query("first_last_in_group", "emp l, size l, first_code s, last_code s, first_hours d, last_hours d", """
    SELECT emp, count(*) AS size, arg_min(code, (day, rec)) AS first_code, arg_max(code, (day, rec)) AS last_code,
           arg_min(hours, (day, rec)) AS first_hours, arg_max(hours, (day, rec)) AS last_hours FROM @pay GROUP BY emp""")
def q_first_last_in_group(spark, sf):
    return O.first_last_in_group(I.pay(spark, sf), K, ["day", "rec"], ["code", "hours"])


@query("ffill", "emp l, day s, prcp d, medpd d", f"""
    SELECT emp, day, last_value(prcp IGNORE NULLS) OVER w AS prcp, last_value(medpd IGNORE NULLS) OVER w AS medpd
    FROM @panel WINDOW w AS (PARTITION BY emp ORDER BY day {UPTO})""")
def q_ffill(spark, sf):
    return O.ffill(P.panel(spark, sf), K, D, ["prcp", "medpd"])


@query("bfill", "emp l, day s, prcp d, medpd d", f"""
    SELECT emp, day, first_value(prcp IGNORE NULLS) OVER w AS prcp, first_value(medpd IGNORE NULLS) OVER w AS medpd
    FROM @panel WINDOW w AS (PARTITION BY emp ORDER BY day {ONWARD})""")
def q_bfill(spark, sf):
    return O.bfill(P.panel(spark, sf), K, D, ["prcp", "medpd"])


@query("fill_cascade", "emp l, day s, main_div l", "SELECT emp, day, main_div FROM @fill3")
def q_fill_cascade(spark, sf):
    p = P.panel(spark, sf).join(large(P.main_division(spark, sf)), ["emp", "day"], "left")
    return O.fill_cascade(p, K, D, "main_div", F.when(F.col("div2").isNull(), F.col("div1")))


@query("cumsum", "emp l, day s, paid d, off d", f"""
    SELECT emp, day, sum(coalesce(work_pay, 0)) OVER w AS paid, sum(leave_hours) OVER w AS off
    FROM @panel WINDOW w AS (PARTITION BY emp ORDER BY day {UPTO})""")
def q_cumsum(spark, sf):
    return O.cumsum(P.panel(spark, sf), K, D, {"paid": "work_pay", "off": "leave_hours"})


GAPS = """WITH d AS (SELECT DISTINCT emp, day, day >= DATE '2024-01-05' AS late FROM @pay),
    g AS (SELECT emp, day, CASE WHEN late THEN coalesce(day - lag(day) OVER (PARTITION BY emp, late ORDER BY day), 0) ELSE 0 END AS gap FROM d)
MAIN """


@query("gap_days", "emp l, day s, gap l", GAPS + "SELECT * FROM g")
def q_gap_days(spark, sf):
    return O.gap_days(I.pay(spark, sf), K, "day", dt.date(2024, 1, 5))


@query("max_gap", "emp l, max_gap l", GAPS + "SELECT emp, max(gap) AS max_gap FROM g GROUP BY emp")
def q_max_gap(spark, sf):
    return O.max_gap(I.pay(spark, sf), K, "day", dt.date(2024, 1, 5))


@query("gap_end_tag", "rec l, gap_end s", GAPS + """
    SELECT p.rec, CASE WHEN g.gap >= 3 THEN g.day END AS gap_end FROM @pay p JOIN g ON p.emp = g.emp AND p.day = g.day""")
def q_gap_end_tag(spark, sf):
    return O.gap_end_tag(I.pay(spark, sf), K, "day", dt.date(2024, 1, 5), 3)


@query("run_length", "emp l, day s, run l, run_length l", f"""
    SELECT *, count(*) OVER (PARTITION BY emp, run) AS run_length FROM
      (SELECT emp, day, sum(c) OVER (PARTITION BY emp ORDER BY day {UPTO}) AS run FROM
        (SELECT emp, day, (not_worked IS DISTINCT FROM lag(not_worked) OVER (PARTITION BY emp ORDER BY day))::INT AS c FROM @panel))""")
def q_run_length(spark, sf):
    return O.run_length(P.panel(spark, sf), K, D, "not_worked")


@query("field_rank", "emp l, day s, rank_org l, rank_div l, rank_rate l", """
    SELECT emp, day, rank_org, rank_div,
           CASE WHEN rate IS NOT NULL THEN rank() OVER (PARTITION BY day ORDER BY rate DESC NULLS LAST) END AS rank_rate FROM @ranked""")
def q_field_rank(spark, sf):
    p = P.leave_panel(spark, sf).select("emp", "day", "main_div", "tenure", "rate")
    p = R.field_rank(p, ["day"], "tenure", "rank_org")
    p = R.field_rank(p, ["main_div", "day"], "tenure", "rank_div")
    return R.field_rank(p, ["day"], "rate", "rank_rate")


@query("rank_gap_counts", "emp l, day s, below l, above l, below_week l, above_week l", """
    SELECT a.emp, a.day,
      (SELECT count(*) FROM @prior b WHERE b.main_div = a.main_div AND b.day = a.day AND b.out_today = 1 AND b.rank_div > a.rank_div) AS below,
      (SELECT count(*) FROM @prior b WHERE b.main_div = a.main_div AND b.day = a.day AND b.out_today = 1 AND b.rank_div < a.rank_div) AS above,
      (SELECT count(*) FROM @prior b WHERE b.day = a.day AND b.out_today = 1 AND b.rank_div_lastweek > a.rank_div_lastweek) AS below_week,
      (SELECT count(*) FROM @prior b WHERE b.day = a.day AND b.out_today = 1 AND b.rank_div_lastweek IS NOT NULL
         AND coalesce(b.rank_div_lastweek < a.rank_div_lastweek, true)) AS above_week
    FROM @prior a""")
def q_rank_gap_counts(spark, sf):
    p = P.leave_panel(spark, sf).select("emp", "day", "main_div", "rank_div", "rank_div_lastweek", "out_today")
    out = F.col("out_today") == 1
    p = R.rank_gap_counts(p, ["main_div", "day"], "rank_div", out, "below", "above")
    return R.rank_gap_counts(p, ["day"], "rank_div_lastweek", out, "below_week", "above_week")


@query("leave_features", "emp l, day s, out_below l, out_above l, out_below_org l, out_above_org l, rank_div_lastweek l, rank_org_lastmonth l",
       "SELECT * FROM @leave_panel")
def q_leave_features(spark, sf):
    return P.leave_panel(spark, sf)


@query("rolling_range_sum", "emp l, day s, w3 d, w7 d, w14 d, w1000 d", """
    SELECT emp, day, sum(worked_hours) OVER (PARTITION BY emp ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS w3,
           sum(worked_hours) OVER (PARTITION BY emp ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS w7,
           sum(worked_hours) OVER (PARTITION BY emp ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND CURRENT ROW) AS w14,
           sum(worked_hours) OVER (PARTITION BY emp ORDER BY day RANGE BETWEEN INTERVAL 1000 DAY PRECEDING AND CURRENT ROW) AS w1000
    FROM @daily""")
def q_rolling_range_sum(spark, sf):
    """Over the days with records, so that calendar distance and row count differ."""
    return O.rolling_range_sum(P.daily(spark, sf), K, "day", "worked_hours", {"w3": 3, "w7": 7, "w14": 14, "w1000": 1000})


@query("first_event_date", "emp l, day s, first_injury s", """
    SELECT emp, day, min(CASE WHEN injured = 1 THEN day END) OVER (PARTITION BY emp) AS first_injury FROM @panel""")
def q_first_event_date(spark, sf):
    return O.first_event_date(P.panel(spark, sf), K, "day", F.col("injured") == 1, "first_injury")


@query("last_event_date", "emp l, day s, last_injury s", f"""
    SELECT emp, day, last_value(CASE WHEN injured = 1 THEN day END IGNORE NULLS) OVER (PARTITION BY emp ORDER BY day {UPTO}) AS last_injury FROM @panel""")
def q_last_event_date(spark, sf):
    return O.last_event_date(P.panel(spark, sf), K, "day", F.col("injured") == 1, "last_injury")


@query("first_n_after_event", "emp l, day s, injured l, worked l", f"""
    WITH a AS (SELECT emp, day, injured, (worked_hours > 0)::INT AS worked FROM @panel),
    b AS (SELECT *, last_value(CASE WHEN injured = 1 THEN day END IGNORE NULLS) OVER (PARTITION BY emp ORDER BY day {UPTO}) AS l FROM a),
    c AS (SELECT *, CASE WHEN l IS NULL THEN min(day) OVER (PARTITION BY emp, l)
                         WHEN worked = 1 AND row_number() OVER (PARTITION BY emp, l, worked ORDER BY day) = 2 THEN day END AS f FROM b),
    e AS (SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY emp, l ORDER BY day {UPTO}) AS g FROM c)
MAIN SELECT emp, day, injured, worked FROM e WHERE injured = 1 OR day > g""")
def q_first_n_after_event(spark, sf):
    p = P.panel(spark, sf).withColumn("worked", flag(F.col("worked_hours") > 0))
    return O.first_n_after_event(p, K, "day", "injured", "worked", 2)


@query("shift_event_to_prior_day", "emp l, day s, injured l, medpd d, nature s, shifted_here l, worked l", "SELECT * FROM @shifted")
def q_shift_event_to_prior_day(spark, sf):
    return S.shifted(spark, sf)


@query("lag_sum_6", "emp l, day s, hours_last6 d", """
    SELECT emp, day, CASE WHEN count(*) OVER w = 6 THEN sum(worked_hours) OVER w END AS hours_last6
    FROM @panel WINDOW w AS (PARTITION BY emp ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def q_lag_sum_6(spark, sf):
    return O.lag_sum_6(P.panel(spark, sf), K, D, "worked_hours", "hours_last6")


@query("group_variation_flag", "emp l, day s, varies l", """
    SELECT emp, day, (min(injured) OVER w <> max(injured) OVER w)::INT AS varies FROM @ranked WINDOW w AS (PARTITION BY main_div, day)""")
def q_group_variation_flag(spark, sf):
    p = P.leave_panel(spark, sf).select("emp", "day", "main_div", "injured")
    return O.group_variation_flag(p, ["main_div", "day"], "injured", "varies")


@query("age_anchor", "emp l, day s, age_ref d, age_now d", """
    SELECT d.emp, d.day, a.age_ref, a.age_ref + date_diff('day', DATE '2024-01-01', d.day) / 365.25::DOUBLE AS age_now
    FROM @daily d JOIN @ages a USING (emp)""")
def q_age_anchor(spark, sf):
    a = O.age_anchor(I.pay(spark, sf), K, "day", "age", I.LO)
    return P.daily(spark, sf).join(large(a), "emp").withColumn("age_now", F.col("age_ref") + years_between("day", F.lit(I.LO)))


@query("corr_random_means", "emp l, day s, bar_others_out d, bar_rate d", """
    SELECT emp, day, avg(others_out) OVER (PARTITION BY emp) AS bar_others_out, avg(rate) OVER (PARTITION BY emp) AS bar_rate FROM @ranked""")
def q_corr_random_means(spark, sf):
    return O.corr_random_means(P.leave_panel(spark, sf), K, ["others_out", "rate"])


@query("estimation_sample", "emp l, day s, worked l, injured l, others_out l, rate d, age d, bar_others_out d, bar_rate d, stint l, "
       "stint_length l, usual_stint l, first_injury s, div_before l, days_worked l, total_worked l, day_varies l, weekday l, week l, rank_org l",
       "SELECT * FROM @sample")
def q_estimation_sample(spark, sf):
    return S.estimation_sample(spark, sf)
