"""Calendar columns: 52-week years, month counters, Sunday-first weekdays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def week_of_year(d) -> Column:
    """Week 1..52 counted in sevens from January 1; week 52 takes the rest."""
    return F.least(F.ceil(F.dayofyear(_c(d)) / 7), F.lit(52)).cast("int")


def week_index(d) -> Column:
    """Weeks since 1960, 52 to the year."""
    return ((F.year(_c(d)) - 1960) * 52 + week_of_year(d) - 1).cast("int")


def month_index(d) -> Column:
    """Months since January 1960."""
    return ((F.year(_c(d)) - 1960) * 12 + F.month(_c(d)) - 1).cast("int")


def dow(d) -> Column:
    """Day of week, 0 = Sunday."""
    return (F.dayofweek(_c(d)) - 1).cast("int")


def prior_week_end(d) -> Column:
    """The last Saturday before the current Sunday-to-Saturday week."""
    return F.date_sub(_c(d), F.dayofweek(_c(d)))


def prior_month_end(d) -> Column:
    return F.date_sub(F.trunc(_c(d), "month"), 1)


def years_between(later, earlier) -> Column:
    """Elapsed years of 365.25 days."""
    return F.datediff(_c(later), _c(earlier)) / F.lit(365.25)


def four_week(week) -> Column:
    return F.floor(_c(week) / 4).cast("int")


def day_number(d) -> Column:
    """Days since the epoch, for range windows."""
    return F.unix_date(_c(d)).cast("long")


def parse_day(text, fmt: str) -> Column:
    """Text to date; text that does not parse becomes missing."""
    return F.try_to_date(_c(text), fmt)


def round_to(x, m: float) -> Column:
    """Nearest multiple of m, halves upward."""
    return F.floor(_c(x) / F.lit(float(m)) + 0.5) * F.lit(float(m))
