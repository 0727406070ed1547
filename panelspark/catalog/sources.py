"""Scans, sinks, stacking, calendar inputs."""

import uuid

from pyspark.sql import functions as F

from panelspark.catalog.registry import query
from panelspark.functions.dates import month_index
from panelspark.operators.checks import check_not_missing, check_unique
from panelspark.operators.collapse import total_row_union
from panelspark.operators.keys import shared_folder
from panelspark.plans import inputs as I
from panelspark.sources.calendars import holidays_etl, weather_etl
from panelspark.sources.tables import append_rows, replicate_rows, scan_csv, scan_table, write_csv, write_table


def _path(spark, name):
    return f"{shared_folder(spark)}/panelspark-{name}-{uuid.uuid4().hex}"


@query("scan_table", "event_id l, user_id l, value d", "SELECT event_id, user_id, value FROM events")
def q_scan_table(spark, sf):
    return scan_table(spark, f"{sf}/events.parquet", ["event_id", "user_id", "value"])


@query("scan_csv", "code s, label s, n l", "SELECT code, label, count(*) AS n FROM @coded GROUP BY ALL")
def q_scan_csv(spark, sf):
    """Records written as text with quotes and commas in a column, then read back and counted."""
    from panelspark.plans.panel import coded
    path = _path(spark, "csv")
    write_csv(coded(spark, sf).select("rec", "code", "label"), path)
    back = scan_csv(spark, path, "rec bigint, code string, label string")
    return back.groupBy("code", "label").agg(F.count("*").alias("n"))


@query("write_csv", "emp l, day s, hours d, div l", "SELECT emp, day, hours, div FROM @pay")
def q_write_csv(spark, sf):
    """Tab-separated text without a header, read back."""
    path = _path(spark, "tsv")
    write_csv(I.pay(spark, sf).select("emp", "day", "hours", "div"), path, "\t", False)
    return scan_csv(spark, path, "emp bigint, day date, hours double, div int", False, "\t")


@query("write_table", "emp l, day s, code s, hours d", "SELECT emp, day, code, hours FROM @pay")
def q_write_table(spark, sf):
    path = _path(spark, "table")
    write_table(I.pay(spark, sf).select("emp", "code", "hours", "day"), path, ["day"])
    return scan_table(spark, path, schema="emp bigint, code string, hours double, day date")


@query("append_rows", "emp l, day s, source s, medpd d", """
    SELECT emp, day, 'claim' AS source, medpd FROM @claims
    UNION ALL SELECT emp, term, 'status', NULL FROM @people WHERE term IS NOT NULL""")
def q_append_rows(spark, sf):
    c = I.claims(spark, sf).select("emp", "day", F.lit("claim").alias("source"), "medpd")
    p = I.people(spark, sf).where(F.col("term").isNotNull())
    return append_rows(c, p.select("emp", F.col("term").alias("day"), F.lit("status").alias("source")))


@query("replicate_rows", "copy l, n l, hours d", """
    SELECT copy, count(*) AS n, sum(hours * copy) AS hours
    FROM @pay, (SELECT unnest(range(1, 4)) AS copy) GROUP BY copy""")
def q_replicate_rows(spark, sf):
    r = replicate_rows(I.pay(spark, sf).select("hours"), 3)
    return r.groupBy("copy").agg(F.count("*").alias("n"), F.sum(F.col("hours") * F.col("copy")).alias("hours"))


@query("total_row_union", "nature s, is_total l, n l, paid d", """
    SELECT CASE WHEN grouping(nature) = 1 THEN 'All Types' ELSE nature END AS nature, grouping(nature) AS is_total,
           count(*) AS n, sum(medpd) AS paid FROM @claims GROUP BY GROUPING SETS ((nature), ())""")
def q_total_row_union(spark, sf):
    return total_row_union(I.claims(spark, sf), "nature", "All Types",
                           [F.count("*").alias("n"), F.sum("medpd").alias("paid")])


@query("holidays_etl", "day s, holiday s, month_ix l", """
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, 'Holiday, ' || year(o_orderdate) AS holiday,
           (year(o_orderdate) - 1960) * 12 + month(o_orderdate) - 1 AS month_ix
    FROM orders WHERE dayofmonth(o_orderdate) = 1""")
def q_holidays_etl(spark, sf):
    return holidays_etl(I.holiday_text(spark, sf)).withColumn("month_ix", month_index("day"))


@query("weather_etl", "day s, tmin d, tmax d, prcp d", """
    SELECT CAST(date_text AS DATE) AS day, tmin, tmax, prcp FROM @readings WHERE name = '5-LOW'""")
def q_weather_etl(spark, sf):
    return weather_etl(I.station_readings(spark, sf), "5-LOW")


@query("weather_checks", "check s, n_violations l, ok l", """
    SELECT * FROM (
      SELECT 'tmin' AS check, count(*) FILTER (tmin IS NULL) AS n_violations, (count(*) FILTER (tmin IS NULL) = 0)::INT AS ok
      FROM @readings WHERE name = '5-LOW'
      UNION ALL SELECT 'prcp', count(*) FILTER (prcp IS NULL), (count(*) FILTER (prcp IS NULL) = 0)::INT
      FROM @readings WHERE name = '5-LOW'
      UNION ALL SELECT 'duplicate_keys', count(*) FILTER (n > 1), (count(*) FILTER (n > 1) = 0)::INT
      FROM (SELECT date_text, count(*) AS n FROM @readings WHERE name = '5-LOW' GROUP BY 1)
      UNION ALL SELECT 'missing_key_rows', 0, 1)""")
def q_weather_checks(spark, sf):
    w = weather_etl(I.station_readings(spark, sf), "5-LOW")
    return check_not_missing(w, {"tmin": "tmin", "prcp": "prcp"}).unionByName(check_unique(w, ["day"]))
