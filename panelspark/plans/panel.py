"""Entry A: pay records to a complete person-day panel with coworker-leave features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions.dates import month_index, week_index, years_between
from panelspark.functions.missing import flag, is_true, m_div, m_gt
from panelspark.operators.clean import dedup_key_first, hours_split
from panelspark.operators.collapse import leave_one_out, staged_collapse
from panelspark.operators.keys import cut_lineage, large
from panelspark.operators.merge import lookup_prior_period, merge_indicator_flag, merge_m1_left
from panelspark.operators.ordered import ffill, fill_cascade
from panelspark.operators.ranks import rank_from_top, rank_gap_counts, running_sums
from panelspark.operators.reshape import daily_slots, panel_fill, panel_skeleton
from panelspark.plans import inputs as I

NOT_LEAVE = "not leave"
# division slots and running totals of the panel, not needed past the main division
SLOT_COLUMNS = ["div2", "leave_1", "leave_2", "sick_1", "sick_2", "n_slots", "hours_zeroed", "iod", "seen",
                "cum_worked", "cum_std", "cum_ot"]
MEASURES = ["worked_hours", "leave_hours", "sick_hours", "std_hours", "ot_hours"]


@I.stage
def coded(spark: SparkSession, sf: str) -> DataFrame:
    return merge_m1_left(I.pay(spark, sf), I.codes(spark, sf), ["code"])


@I.stage
def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Work, leave and on-duty-injury records with their hours split and class."""
    c = coded(spark, sf)
    iod = F.col("label").contains("IOD")
    worked = is_true(F.col("work") == 1)
    c = c.where(worked | iod | is_true(F.col("out_type") == 1))
    c = c.where(~(worked & is_true(m_div(F.col("pay_amount"), F.col("hours")) == 0)))
    c = hours_split(c, "hours", "label", "work")
    is_ot = F.lower("label").contains("overtime").cast("double")
    return c.withColumns({
        "kind": F.when(F.col("out_type") == 1, F.col("code")).otherwise(NOT_LEAVE),
        "iod": F.when(iod, 1),
        "ot_pay": F.col("pay_amount") * is_ot,
        "work_pay": F.col("pay_amount") * F.col("work"),
        "div": F.when(F.col("div") >= 800, F.col("div"))})


@I.stage
def daily_div(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (person, day, division)."""
    return staged_collapse(classified(spark, sf), ["emp", "day", "div"], "kind", "sick_subset", "hours",
                           ["std_hours", "ot_hours", "work_pay", "ot_pay"], "iod", "rate", NOT_LEAVE)


@I.stage
def daily(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (person, day): two division slots, totals, filled top rate."""
    sums = [*MEASURES, "work_pay", "ot_pay"]
    out = daily_slots(daily_div(spark, sf), ["emp", "day"], ["worked_hours", "div"],
                      {"div": "div", "leave_": "leave_hours", "sick_": "sick_hours"}, 2,
                      [*[F.sum(c).alias(c) for c in sums], F.max("iod").alias("iod"), F.max("rate").alias("rate")])
    out = out.withColumns({
        "hours_zeroed": flag(F.col("worked_hours") < 0),
        "worked_hours": F.greatest("worked_hours", F.lit(0.0)),
        "rate": F.when(~m_gt(F.col("rate"), 34), F.col("rate"))})
    return ffill(out, ["emp"], ["day"], ["rate"])


@I.stage
def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Every day of every observed person, with claims, weather and holidays."""
    who = I.people(spark, sf)
    d = cut_lineage(daily(spark, sf))
    # people never observed inside their own dates leave before their days are generated
    span = who.select("emp", "hire", "term")
    seen = (d.select("emp", "day").join(large(span), "emp")
            .where((F.col("day") >= F.greatest("hire", F.lit(I.LO)))
                   & (F.col("day") <= F.least(F.coalesce("term", F.lit(I.HI)), F.lit(I.HI))))
            .select("emp").distinct())
    who = who.join(large(seen), "emp", "left_semi")
    days = panel_skeleton(who, "emp", "hire", "term", I.LO, I.HI)
    cl = I.claims(spark, sf).select("emp", "day", "medpd", "nature", F.lit(1).alias("injured"))
    d = d.join(large(cl), ["emp", "day"], "left")
    p = panel_fill(days, d, "emp", "day", MEASURES, ["rate"],
                   {"cum_worked": "worked_hours", "cum_std": "std_hours", "cum_ot": "ot_hours"}, "worked_hours")
    p = p.withColumn("injured", F.coalesce("injured", F.lit(0)))
    p = p.join(large(who.select("emp", "job_class", "hire")), "emp")
    p = merge_m1_left(p, I.weather(spark, sf), ["day"])
    p = merge_indicator_flag(p, I.holidays(spark, sf), ["day"], "is_holiday")
    return cut_lineage(p.withColumns({"week_ix": week_index("day"), "month_ix": month_index("day"),
                          "rain": flag(m_gt(F.col("prcp"), 0))}))


@I.stage
def main_division(spark: SparkSession, sf: str) -> DataFrame:
    """The division of each person-day's regular hours."""
    p = I.pay(spark, sf).where((F.col("code") == "click") & (F.col("hours") >= 0))
    first = dedup_key_first(p.select("emp", "day", "div"), ["emp", "day"], ["div"])
    return first.select("emp", "day", F.col("div").alias("main_div"))


@I.stage
def leave_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with coworkers' leave, seniority ranks and ranks of those on leave."""
    p = panel(spark, sf).join(large(main_division(spark, sf)), ["emp", "day"], "left")
    only = F.when(F.col("div2").isNull(), F.col("div1"))
    p = fill_cascade(p, ["emp"], ["day"], "main_div", only).where(F.col("main_div").isNotNull()).drop(*SLOT_COLUMNS)
    on_leave = F.col("leave_hours") > 0
    idle = F.col("worked_hours") == 0
    p = p.withColumns({
        "took_leave": flag(on_leave),
        "out_today": flag((F.col("leave_hours") >= I.LEAVE_HOURS) & idle),
        "tenure": years_between("day", "hire"),
        "tenure_days": F.datediff("day", "hire")}).where(F.col("tenure_days") >= 0)
    p = cut_lineage(p)
    div_day = ["main_div", "day"]
    # whole days of tenure: few distinct values per group
    out = F.when(F.col("out_today") == 1, 1).otherwise(0)
    levels = {"_cnt": F.count("*"), "_out": F.sum(out)}
    by_div = running_sums(p, div_day, "tenure_days", levels, bounded=True).select(
        *div_day, "tenure_days", rank_from_top("_cnt").alias("rank_div"),
        (F.col("_out_run") - F.col("_out")).alias("out_below"),
        (F.col("_out_all") - F.col("_out_run")).alias("out_above"))
    by_org = running_sums(p, ["day"], "tenure_days", {"_cnt": F.count("*")}, bounded=True).select(
        "day", "tenure_days", rank_from_top("_cnt").alias("rank_org"))
    q = leave_one_out(p, div_day, {
        "others_leave": flag(on_leave),
        "others_leave_nosick": flag(F.col("leave_hours") - F.col("sick_hours") >= I.LEAVE_HOURS),
        "others_out": F.col("out_today"),
        "others_leave_hours": F.when(idle, F.col("leave_hours")).otherwise(0.0)}, "div_size")
    share = F.when(F.col("div_size") == 1, 0.0).otherwise(m_div(F.col("others_leave"), F.col("div_size") - 1))
    q = q.withColumn("others_leave_share", share)
    q = cut_lineage(q.join(by_div, [*div_day, "tenure_days"]).join(by_org, ["day", "tenure_days"]))
    q = lookup_prior_period(q, ["emp"], "day", "rank_div", "week", "rank_div_lastweek")
    q = cut_lineage(lookup_prior_period(q, ["emp"], "day", "rank_org", "month", "rank_org_lastmonth"))
    return cut_lineage(rank_gap_counts(q, ["day"], "rank_org_lastmonth", F.col("out_today") == 1,
                                "out_below_org", "out_above_org", bounded=True))
