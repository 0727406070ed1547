"""Wide and long forms, complete calendars, and first-event unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.missing import flag, m_gt
from panelspark.operators.keys import large
from panelspark.operators.ordered import by_order, cumsum, ffill
from panelspark.sources.tables import append_rows


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str = "variable",
            value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def pivot(df: DataFrame, ids: list[str], col: str, val: str, domain: list) -> DataFrame:
    """Long to wide over a stated, small domain (no pass to discover it)."""
    return df.groupBy(*ids).pivot(col, domain).agg(F.sum(val))


def panel_skeleton(people: DataFrame, k: str, start: str, end: str, lo, hi) -> DataFrame:
    """Every day of each entity between max(start, lo) and min(end, hi); an open end is hi."""
    first = F.greatest(F.col(start), F.lit(lo))
    last = F.when(m_gt(F.col(end), F.lit(hi)), F.lit(hi)).otherwise(F.col(end))
    return (people.select(k, first.alias("_f"), last.alias("_t")).where(F.col("_f") <= F.col("_t"))
            .select(k, F.explode(F.sequence("_f", "_t", F.expr("interval 1 day"))).alias("day")))


def panel_fill(skeleton: DataFrame, daily: DataFrame, k: str, day: str, zero: list[str],
               carry: list[str], cumulate: dict[str, str], hours: str) -> DataFrame:
    """Daily data on the complete calendar.

    Measures are zero on empty days, attributes carry forward, running sums start at the
    entity's first day. Adds `seen` (a record that day) and `not_worked`.
    """
    d = skeleton.join(large(daily.withColumn("seen", F.lit(1))), [k, day], "left")
    d = d.withColumns({**{c: F.coalesce(c, F.lit(0.0)) for c in zero},
                       "seen": F.coalesce("seen", F.lit(0))})
    d = d.withColumn("not_worked", flag(F.col(hours) == 0))
    return cumsum(ffill(d, [k], [day], carry), [k], [day], cumulate)


def panel_contiguous(df: DataFrame, k: str, day: str) -> DataFrame:
    """Rows whose day does not follow the entity's previous row by exactly one day."""
    prev = F.lag(day).over(by_order([k], [day]))
    return (df.select(k, day, F.datediff(day, prev).alias("step"))
            .where(F.col("step").isNotNull() & (F.col("step") != 1)))


def daily_slots(df: DataFrame, k: list[str], o: list[str], cols: dict[str, str], n: int = 2,
                totals: list[Column] | None = None) -> DataFrame:
    """First n values of some columns per key, as columns `<prefix>1..n`, with `n_slots`.

    Further aggregates of the key's rows can be taken in the same pass (`totals`).

    Input is one row per (key, unit), so a key holds at most as many rows as there are
    units; `n_slots > n` shows keys with more.
    """
    pos = F.row_number().over(by_order(k, o))
    d = df.withColumn("_pos", pos)
    picks = [F.max(F.when(F.col("_pos") == i, F.col(c))).alias(f"{prefix}{i}")
             for prefix, c in cols.items() for i in range(1, n + 1)]
    return d.groupBy(*k).agg(*picks, F.count("*").alias("n_slots"), *(totals or []))


def union_distinct_min(dfs: list[DataFrame], k: str, day: str, lo, span: int) -> tuple[DataFrame, DataFrame]:
    """First event per entity from several sources, ignoring events before `lo`.

    Also returns the entities whose sources disagree by more than `span` days.
    """
    events = append_rows(*[d.select(k, day) for d in dfs]).where(F.col(day) >= F.lit(lo))
    per = events.groupBy(k).agg(F.min(day).alias(day), F.max(day).alias("_last"))
    far = per.where(F.datediff("_last", day) > span)
    return per.drop("_last"), far


def sort_multi(df: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    """Sort by (column, 'asc' or 'desc'), missing last either way; for output only."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last()
                        for c, d in order])
