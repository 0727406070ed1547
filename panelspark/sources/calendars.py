"""Holiday and weather inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.dates import parse_day


def holidays_etl(df: DataFrame, date_col: str = "date_text", fmt: str = "M/d/yyyy") -> DataFrame:
    """Holiday rows with their text date parsed."""
    return df.select(parse_day(date_col, fmt).alias("day"), F.col("holiday"))


def weather_etl(df: DataFrame, station: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """One station's daily readings: (day, tmin, tmax, prcp)."""
    return (df.where(F.col("name") == station)
            .select(parse_day("date_text", fmt).alias("day"), "tmin", "tmax", "prcp"))
