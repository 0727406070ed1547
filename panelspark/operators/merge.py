"""Keyed merges with match reports, and lookups at computed dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.dates import prior_month_end, prior_week_end
from panelspark.functions.missing import flag
from panelspark.operators.keys import key_join, large
from panelspark.operators.ranks import row_positions


def merge_report(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Full outer merge with `_merge` = 1 left only, 2 right only, 3 both, and its counts.

    A non-key column on both sides keeps the left value unless the row is right-only. A full outer join cannot be split
    at a hot key; a left join and the right rows without a match can, a missing key like any other. Neither side is broadcast.
    """
    both = [c for c in right.columns if c in left.columns and c not in on]
    only = [c for c in right.columns if c not in on and c not in both]
    matched = key_join(left, large(right.select(*on, *only, F.lit(1).alias("_hit"))), on, "left")
    matched = matched.select(*left.columns, *only, F.when(F.col("_hit") == 1, 3).otherwise(1).alias("_merge"))
    rest = key_join(right, large(left.select(*on)), on, "left_anti")
    kinds = dict(left.dtypes)
    rest = rest.select(*[F.col(c) if c in right.columns else F.lit(None).cast(kinds[c]).alias(c) for c in left.columns], *only, F.lit(2).alias("_merge"))
    merged = matched.unionByName(rest)
    return merged, merged.groupBy("_merge").agg(F.count("*").alias("n"))


def merge_m1_left(left: DataFrame, right: DataFrame, on: list[str],
                  cols: list[str] | None = None) -> DataFrame:
    """Many-to-one lookup that keeps every left row and no right-only row."""
    r = right.select(*on, *(cols or [c for c in right.columns if c not in on]))
    return key_join(left, r, on, "left")


def merge_must_match(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The inner merge and the left rows without a match, which should be none."""
    return key_join(left, right, on, "inner"), key_join(left, right.select(*on), on, "left_anti")


def merge_indicator_flag(left: DataFrame, right: DataFrame, on: list[str], out: str) -> DataFrame:
    """Whether a key is listed on the right, as 0/1; the row count stays."""
    keys = right.select(*on).distinct().withColumn("_hit", F.lit(1))
    return key_join(left, keys, on, "left").withColumn(out, flag(F.col("_hit") == 1)).drop("_hit")


def full_outer_align(df: DataFrame, category: str, value: str, domain: list[str]) -> DataFrame:
    """Ragged lists side by side: one column per category, aligned on sorted position."""
    pos = row_positions(df.select(category, value).distinct(), [category], [value], "pos")
    return pos.groupBy("pos").pivot(category, domain).agg(F.first(value))


def lookup_prior_period(df: DataFrame, k: list[str], day: str, col: str, period: str,
                        out: str) -> DataFrame:
    """The entity's own value on the last day of the previous week or month."""
    target = {"week": prior_week_end, "month": prior_month_end}[period](F.col(day))
    past = df.select(*k, F.col(day).alias("_at"), F.col(col).alias(out))
    return df.withColumn("_at", target).join(large(past), [*k, "_at"], "left").drop("_at")


def cross_join_draws(df: DataFrame, n: int, out: str = "draw") -> DataFrame:
    """Every row under each of n replicates, generated inside the scan's own tasks."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(n))))
