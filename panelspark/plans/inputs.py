"""Panel inputs derived from the TPC-H-like test tables.

`events` plays the pay records, `customer` the people. All rules are deterministic, so a
SQL engine can derive the same rows.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.functions.missing import flag
from panelspark.operators.clean import dedup_key_first
from panelspark.operators.keys import large
from panelspark.sources.tables import scan_table

LO, HI = dt.date(2024, 1, 1), dt.date(2024, 1, 30)
SAMPLE_LO, SAMPLE_HI = dt.date(2024, 1, 2), dt.date(2024, 1, 30)
LEAVE_HOURS = 8
PART_TIME = "MACHINERY"


# Column types of the tables in use.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}

_stages: dict[tuple, DataFrame] = {}


def stage(fn):
    """Build a stage once per application and data folder, so that its readers share it."""
    @functools.wraps(fn)
    def once(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), sf, fn.__module__, fn.__name__)
        if key not in _stages:
            _stages[key] = fn(spark, sf)
        return _stages[key]
    return once


def table(spark: SparkSession, sf: str, name: str, cols: list[str] | None = None) -> DataFrame:
    return scan_table(spark, f"{sf}/{name}.parquet", cols, SCHEMAS.get(name))


@stage
def people(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    key = F.col("c_custkey")
    return c.select(
        key.alias("emp"), F.col("c_mktsegment").alias("job_class"),
        (800 + F.col("c_nationkey") % 8).alias("home_div"),
        F.date_add(F.lit(dt.date(2023, 12, 15)), (key * 7 % 25).cast("int")).alias("hire"),
        F.when(key % 5 == 0, F.date_add(F.lit(dt.date(2024, 1, 20)), (key % 15).cast("int"))).alias("term"))


@stage
def codes(spark: SparkSession, sf: str) -> DataFrame:
    """Pay-code dictionary: label text and class marks, each 1 or missing."""
    c = F.col("code")
    one = lambda *names: F.when(c.isin(*names), 1)
    return (table(spark, sf, "events", ["event_type"]).select(F.col("event_type").alias("code")).distinct()
            .withColumns({
                "label": F.when(c == "click", "Regular Hours").when(c == "view", "Overtime Hours")
                .when(c == "purchase", "Vacation, Paid").when(c == "signup", "Sick 100% Pay")
                .otherwise("On Duty IOD Hours"),
                "work": one("click", "view"), "out_type": one("purchase", "signup"),
                "sick_subset": one("signup")}))


@stage
def pay(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    p = people(spark, sf).select("emp", "home_div")
    rec = F.col("event_id")
    day = F.to_date("ts")
    return (e.join(large(p), e.user_id == p.emp).select(
        rec.alias("rec"), "emp", day.alias("day"), F.col("event_type").alias("code"),
        (F.when(rec % 97 == 0, -1.0).otherwise(1.0) * (F.floor("value") % 12 + 1)).alias("hours"),
        F.col("value").alias("pay_amount"),
        F.when(rec % 41 != 0, F.lit(20.0) + rec % 15).alias("rate"),
        F.when(rec % 53 == 0, None).when(rec % 11 == 0, 800 + (F.col("home_div") - 799) % 8)
        .otherwise(F.col("home_div")).alias("div"),
        (F.lit(25.0) + F.col("emp") % 35 + F.datediff(day, F.lit(LO)) / F.lit(365.25)).alias("age")))


@stage
def claims(spark: SparkSession, sf: str) -> DataFrame:
    """First qualifying record per person-day, with a text kind and a text amount."""
    raw = (pay(spark, sf).where((F.col("code") == "error") & (F.col("pay_amount") > 100))
           .select("emp", "day", "rec", "pay_amount"))
    first = dedup_key_first(raw, ["emp", "day"], ["rec"])
    kind = (F.when(F.col("rec") % 4 == 0, "Strain").when(F.col("rec") % 4 == 1, "Mult Injuries Incl Cuts")
            .when(F.col("rec") % 4 == 2, "Sprain, Ankle (e.g., left)").otherwise("Burn, Heat"))
    return first.select("emp", "day", "rec", F.when(F.col("rec") % 3 != 0, F.col("pay_amount")).alias("medpd"),
                        kind.alias("nature"))


@stage
def holidays(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events", ["ts"]).select(F.to_date("ts").alias("day")).distinct()
    return d.where(F.dayofmonth("day").isin(1, 15)).withColumn("holiday", F.lit("Public holiday"))


@stage
def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Rain per day from January 3 on; the first days have no reading on purpose."""
    d = table(spark, sf, "events", ["ts"]).select(F.to_date("ts").alias("day")).distinct()
    return (d.where(F.col("day") >= F.lit(dt.date(2024, 1, 3)))
            .withColumn("prcp", (F.dayofmonth("day") * 7 % 10) / F.lit(10.0)))


@stage
def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (day, div, emp) with work records at a known division."""
    p = pay(spark, sf)
    return (p.where(F.col("code").isin("click", "view") & F.col("div").isNotNull())
            .select("day", "div", "emp").distinct())


@stage
def station_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Text-dated readings of several stations, from the orders of each date and priority."""
    o = table(spark, sf, "orders", ["o_orderdate", "o_orderpriority", "o_totalprice"])
    day = F.to_date("o_orderdate")
    return (o.groupBy(F.col("o_orderpriority").alias("name"), F.date_format(day, "yyyy-MM-dd").alias("date_text"))
            .agg(F.min("o_totalprice").alias("tmin"), F.max("o_totalprice").alias("tmax"),
                 F.count("*").cast("double").alias("prcp")))


@stage
def holiday_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text-dated holidays: order dates on the first of a month."""
    d = table(spark, sf, "orders", ["o_orderdate"]).select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.where(F.dayofmonth("d") == 1).select(
        F.date_format("d", "M/d/yyyy").alias("date_text"),
        F.concat(F.lit("Holiday, "), F.date_format("d", "yyyy")).alias("holiday"))


def is_work_day(hours: str = "worked_hours"):
    return flag(F.col(hours) > 0)
