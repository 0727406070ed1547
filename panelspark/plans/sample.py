"""Entry B, first part: the estimation sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from panelspark.functions.dates import dow, week_of_year
from panelspark.functions.missing import flag, is_true
from panelspark.operators.clean import date_window, drop_entity_if_any
from panelspark.operators.collapse import mode_no_ties
from panelspark.operators.keys import cut_lineage, large
from panelspark.operators.ordered import (age_anchor, attach_age, corr_random_means, cumsum, first_event_date,
                                          first_n_after_event, group_variation_flag, lag_lead, lag_sum_6, run_length,
                                          shift_event_to_prior_day)
from panelspark.plans import inputs as I
from panelspark.plans.panel import leave_panel

E, D = ["emp"], ["day"]
# what the models and tables of the sample use, besides the keys; other columns join back by key
USED = ["main_div", "worked_hours", "leave_hours", "ot_hours", "std_hours", "work_pay", "ot_pay", "rate", "injured", "medpd",
        "nature", "job_class", "is_holiday", "rain", "week_ix", "others_leave", "others_leave_nosick", "others_out",
        "others_leave_hours", "others_leave_share", "rank_org", "tenure"]


@I.stage
def shifted(spark: SparkSession, sf: str) -> DataFrame:
    """Window, part-timer removal, and injuries moved to worked days."""
    s = date_window(leave_panel(spark, sf).select(*E, *D, *USED), "day", I.SAMPLE_LO, I.SAMPLE_HI)
    s = drop_entity_if_any(s, E, F.col("job_class") == I.PART_TIME)
    s = shift_event_to_prior_day(s, E, "day", "injured", F.col("worked_hours") > 0, ["medpd", "nature"])
    return s.withColumn("worked", flag((F.col("worked_hours") > 0) | (F.col("injured") == 1)))


@I.stage
def stints(spark: SparkSession, sf: str) -> DataFrame:
    """People with work, their runs of active days, and features of earlier days."""
    s = cumsum(shifted(spark, sf), E, D, {"days_worked": "worked"})
    s = s.withColumn("total_worked", F.sum("worked").over(W.partitionBy("emp"))).where(F.col("total_worked") > 0)
    s = s.withColumn("active", flag((F.col("worked") == 1) | (F.col("leave_hours") > 0)))
    s = run_length(s, E, D, "active", "stint", "stint_length")
    s = lag_sum_6(s, E, D, "worked_hours", "hours_last6")
    s = first_event_date(s, E, "day", F.col("injured") == 1, "first_injury")
    return cut_lineage(lag_lead(s, E, D, "main_div", 1, "div_before"))


@I.stage
def estimation_sample(spark: SparkSession, sf: str) -> DataFrame:
    s = stints(spark, sf)
    s = s.join(large(mode_no_ties(s.where(F.col("active") == 1), E, "stint_length", "usual_stint")), "emp", "left")
    ages = age_anchor(I.pay(spark, sf), E, "day", "age", I.LO)
    s = attach_age(s, ages, E, "day", I.LO, "age")
    s = s.where(~is_true((F.col("worked") == 0) & (F.col("leave_hours") > 0)))
    s = corr_random_means(s, E, ["others_out", "rate"])
    s = first_n_after_event(s, E, "day", "injured", "worked", 2)
    s = s.withColumns({"weekday": dow("day"), "week": week_of_year("day")})
    return cut_lineage(group_variation_flag(cut_lineage(s), D, "injured", "day_varies"))
