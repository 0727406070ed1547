"""Ordered by-group operators on a panel with one row per (entity, day).

The windows partition by entity. A partition is bounded by the length of the calendar,
because records are collapsed to one row per entity and day first, whatever share of the
records one entity has. The window specs are the same text throughout, so Spark sorts
once for a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.dates import day_number, years_between
from panelspark.functions.missing import flag, is_true, m_ne
from panelspark.operators.keys import attach, key_join, large


def by_order(k: list[str], o: list[str]):
    return W.partitionBy(*k).orderBy(*[F.col(c).asc_nulls_last() for c in o])


def upto(k: list[str], o: list[str]):
    return by_order(k, o).rowsBetween(W.unboundedPreceding, 0)


def backward(k: list[str], o: list[str]):
    """From the last row to this one, read backward: a running frame, linear in the rows."""
    return W.partitionBy(*k).orderBy(*[F.col(c).desc_nulls_first() for c in o]).rowsBetween(W.unboundedPreceding, 0)


def lag_lead(df: DataFrame, k: list[str], o: list[str], col: str, n: int, out: str) -> DataFrame:
    """The value n rows back (n > 0) or ahead (n < 0)."""
    w = by_order(k, o)
    return df.withColumn(out, F.lag(col, n).over(w) if n > 0 else F.lead(col, -n).over(w))


def first_last_in_group(df: DataFrame, k: list[str], o: list[str], cols: list[str]) -> DataFrame:
    """Per group: size, and first and last value of each column in a total order."""
    rank = F.struct(*[F.col(c) for c in o])
    return df.groupBy(*k).agg(F.count("*").alias("size"),
                              *[a for c in cols for a in (F.min_by(c, rank).alias(f"first_{c}"),
                                                          F.max_by(c, rank).alias(f"last_{c}"))])


def ffill(df: DataFrame, k: list[str], o: list[str], cols: list[str]) -> DataFrame:
    w = upto(k, o)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def bfill(df: DataFrame, k: list[str], o: list[str], cols: list[str]) -> DataFrame:
    w = backward(k, o)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def fill_cascade(df: DataFrame, k: list[str], o: list[str], col: str, alt: Column) -> DataFrame:
    """Carry forward, then take `alt`, carry that forward, then carry backward."""
    fwd, back = upto(k, o), backward(k, o)
    one = F.last(col, ignorenulls=True).over(fwd)
    return (df.withColumn(col, F.coalesce(one, alt))
            .withColumn(col, F.last(col, ignorenulls=True).over(fwd))
            .withColumn(col, F.last(col, ignorenulls=True).over(back)))


def cumsum(df: DataFrame, k: list[str], o: list[str], cols: dict[str, str]) -> DataFrame:
    """Running sums {out: column} with missing as zero."""
    w = upto(k, o)
    return df.withColumns({out: F.sum(F.coalesce(c, F.lit(0))).over(w) for out, c in cols.items()})


def _days(df: DataFrame, k: list[str], day: str) -> DataFrame:
    return df.select(*k, day).distinct()


def gap_days(df: DataFrame, k: list[str], day: str, lo, out: str = "gap") -> DataFrame:
    """(entity, day) with days since the entity's previous day in the same period.

    Two periods, before and from `lo`; the first day of a period and all days before `lo`
    have gap 0. Records are reduced to distinct days before the window.
    """
    late = F.col(day) >= F.lit(lo)
    d = _days(df, k, day).withColumn("_late", late)
    prev = F.lag(day).over(by_order([*k, "_late"], [day]))
    gap = F.when(F.col("_late"), F.coalesce(F.datediff(day, prev), F.lit(0))).otherwise(0)
    return d.withColumn(out, gap.cast("int")).drop("_late")


def max_gap(df: DataFrame, k: list[str], day: str, lo, out: str = "max_gap") -> DataFrame:
    """Largest gap per entity from `lo` on."""
    return gap_days(df, k, day, lo, "_gap").groupBy(*k).agg(F.max("_gap").alias(out))


def gap_end_tag(df: DataFrame, k: list[str], day: str, lo, min_days: int, out: str = "gap_end") -> DataFrame:
    """Every record on a day that ends a gap of at least `min_days` gets that day."""
    ends = (gap_days(df, k, day, lo, "_gap").where(F.col("_gap") >= min_days)
            .select(*k, day, F.col(day).alias(out)))
    return df.join(large(ends), [*k, day], "left")


def run_length(df: DataFrame, k: list[str], o: list[str], col: str, run: str = "run",
               length: str = "run_length") -> DataFrame:
    """Number runs of equal values 1, 2, ... and give each row its run's length."""
    first = F.row_number().over(by_order(k, o)) == 1
    change = flag(first | m_ne(F.col(col), F.lag(col).over(by_order(k, o))))
    return (df.withColumn("_new", change)
            .withColumn(run, F.sum("_new").over(upto(k, o)).cast("int")).drop("_new")
            .withColumn(length, F.count("*").over(W.partitionBy(*k, run)).cast("int")))


def rolling_range_sum(df: DataFrame, k: list[str], day: str, col: str, spans: dict[str, int]) -> DataFrame:
    """Sums over the previous p days and today, by calendar distance: {out: p}."""
    w = W.partitionBy(*k).orderBy("_d")
    return (df.withColumn("_d", day_number(day))
            .withColumns({out: F.coalesce(F.sum(col).over(w.rangeBetween(-p, 0)), F.lit(0.0))
                          for out, p in spans.items()}).drop("_d"))


def first_event_date(df: DataFrame, k: list[str], day: str, event: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.min(F.when(is_true(event), F.col(day))).over(W.partitionBy(*k)))


def last_event_date(df: DataFrame, k: list[str], day: str, event: Column, out: str) -> DataFrame:
    """Date of the most recent event up to this row."""
    marked = F.when(is_true(event), F.col(day))
    return df.withColumn(out, F.last(marked, ignorenulls=True).over(upto(k, [day])))


def first_n_after_event(df: DataFrame, k: list[str], day: str, event: str, work: str,
                        n: int = 2) -> DataFrame:
    """Drop the days after an event up to and including the n-th worked day, event day kept.

    The event day counts as the first worked day. Before any event only the entity's
    first day is dropped. Rows that never reach the n-th worked day are dropped.
    """
    w = upto(k, [day])
    hit, works = is_true(F.col(event) == 1), flag(F.col(work) == 1)
    d = df.withColumns({"_last": F.last(F.when(hit, F.col(day)), ignorenulls=True).over(w),
                        "_count": F.sum(works).over(w)})
    # worked days up to this row, less those before the event's own row
    before = F.last(F.when(hit, F.col("_count") - works), ignorenulls=True).over(w)
    d = d.withColumn("_at", F.when((works == 1) & (F.col("_count") - before == n), F.col(day)))
    d = d.withColumns({"_back": F.last("_at", ignorenulls=True).over(w), "_start": F.min(day).over(W.partitionBy(*k))})
    # a return day of an earlier spell lies before the last event
    after = (F.col("_back") >= F.col("_last")) & (F.col(day) > F.col("_back"))
    keep = hit | is_true(F.when(F.col("_last").isNull(), F.col(day) > F.col("_start")).otherwise(after))
    return d.where(keep).drop("_last", "_count", "_at", "_back", "_start")


def shift_event_to_prior_day(df: DataFrame, k: list[str], day: str, event: str, worked: Column,
                             carry: list[str] | None = None, from_earlier: bool = False) -> DataFrame:
    """Move an event from a day without work to the day before, if that day was worked.

    `carry` columns move with the event. `from_earlier` takes them from the row before the
    receiving day instead, a variant kept for comparison. Adds `shifted_here`.
    """
    w = by_order(k, [day])
    d = df.withColumn("_w", flag(worked))
    idle_event = flag((F.col(event) == 1) & (F.col("_w") == 0))
    d = d.withColumn("_idle", idle_event)
    d = d.withColumn("_take", flag((F.col("_w") == 1) & (F.lead("_idle").over(w) == 1)))
    d = d.withColumn("_give", flag(F.lag("_take").over(w) == 1))
    moved = {c: F.when(F.col("_take") == 1, (F.lag(c) if from_earlier else F.lead(c)).over(w))
             .otherwise(F.col(c)) for c in carry or []}
    value = F.when(F.col("_give") == 1, 0).when(F.col("_take") == 1, 1).otherwise(F.col(event))
    return (d.withColumns({**moved, event: value, "shifted_here": F.col("_take")})
            .drop("_w", "_idle", "_take", "_give"))


def lag_sum_6(df: DataFrame, k: list[str], o: list[str], col: str, out: str) -> DataFrame:
    """Sum of the six previous rows; missing unless all six are there."""
    w = by_order(k, o).rowsBetween(-6, -1)
    return df.withColumn(out, F.when(F.count(col).over(w) == 6, F.sum(col).over(w)))


def group_variation_flag(df: DataFrame, k: list[str], col: str, out: str) -> DataFrame:
    """Whether a column takes more than one value inside the group."""
    return attach(df, k, {out: (F.min(col) != F.max(col)).cast("int")})


def age_anchor(df: DataFrame, k: list[str], day: str, age: str, ref, out: str = "age_ref") -> DataFrame:
    """Age on the date `ref` from the entity's lowest observed age, then its earliest date.

    One row per entity; add `years_between(day, ref)` for the age on any day.
    """
    first = F.struct(F.col(age), F.col(day))
    at = df.where(F.col(age).isNotNull()).groupBy(*k).agg(F.min(first).alias("_a"))
    return at.select(*k, (F.col(f"_a.{age}") - years_between(F.col(f"_a.{day}"), F.lit(ref))).alias(out))


def corr_random_means(df: DataFrame, k: list[str], cols: list[str]) -> DataFrame:
    """Entity means of regressors, as further regressors `bar_<col>`."""
    return df.withColumns({f"bar_{c}": F.avg(c).over(W.partitionBy(*k)) for c in cols})


def attach_age(df: DataFrame, ages: DataFrame, k: list[str], day: str, ref, out: str) -> DataFrame:
    """Age on every date from the anchored age."""
    joined = key_join(df, large(ages), k, "left", nullable=False)
    return joined.withColumn(out, F.col("age_ref") + years_between(day, F.lit(ref)))
