"""Projection, filters, conditional updates, labels and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.missing import flag, is_true
from panelspark.operators.keys import key_join, large


def project(df: DataFrame, keep: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Keep columns, in order, with optional new names. A trailing * keeps a prefix."""
    rename = rename or {}
    names: list[str] = []
    for k in keep:
        hits = [c for c in df.columns if c.startswith(k[:-1])] if k.endswith("*") else [k]
        names += [c for c in hits if c not in names]
    return df.select([F.col(c).alias(rename.get(c, c)) for c in names])


def filter_missing_aware(df: DataFrame, cond: Column) -> DataFrame:
    """Keep rows where a condition built from the `m_*` comparisons holds."""
    return df.where(is_true(cond))


def conditional_update(df: DataFrame, steps: list[tuple[str, Column | None, Column]]) -> DataFrame:
    """Updates in order (column, condition or None, new value); later steps see earlier ones."""
    for col, cond, expr in steps:
        old = F.col(col) if col in df.columns else F.lit(None)
        df = df.withColumn(col, expr if cond is None else F.when(is_true(cond), expr).otherwise(old))
    return df


def paycode_flag(df: DataFrame, code: str, patterns: dict[str, str],
                 ignore_case: bool = True) -> DataFrame:
    """0/1 flags for codes whose text holds a pattern."""
    text = F.lower(code) if ignore_case else F.col(code)
    return df.withColumns({
        name: flag(text.contains(p.lower() if ignore_case else p)) for name, p in patterns.items()})


def hours_split(df: DataFrame, hours: str, code: str, work: str,
                ot: str = "ot_hours", std: str = "std_hours", marker: str = "overtime") -> DataFrame:
    """Overtime and standard hours by code text.

    Overtime asks for a work code; standard time does not, so leave hours count there.
    """
    is_ot = is_true(F.lower(code).contains(marker))
    return df.withColumns({
        ot: F.when(is_ot & is_true(F.col(work) == 1), F.coalesce(hours, F.lit(0.0))).otherwise(0.0),
        std: F.when(is_ot, F.lit(0.0)).otherwise(F.coalesce(hours, F.lit(0.0)))})


def dedup_all(df: DataFrame) -> DataFrame:
    return df.distinct()


def dedup_key_first(df: DataFrame, k: list[str], o: list[str]) -> DataFrame:
    """First row of each key in the order `o`, missing last.

    One aggregate with map-side partials instead of a sorted window: only the best
    row per key and task is shuffled.
    """
    rest = [c for c in df.columns if c not in k]
    rank = F.struct(*[x for c in o for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(f"v_{c}"))])
    best = df.groupBy(*k).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*k, "_row.*").select(*df.columns)


def date_window(df: DataFrame, day: str, lo, hi) -> DataFrame:
    """Rows with lo <= day < hi."""
    return df.where((F.col(day) >= F.lit(lo)) & (F.col(day) < F.lit(hi)))


def drop_entity_if_any(df: DataFrame, k: list[str], cond: Column, none: bool = False) -> DataFrame:
    """Drop entities with any row meeting `cond`; with `none`, those without such a row."""
    hit = df.where(is_true(cond)).select(*k).distinct()
    return key_join(df, large(hit), k, "left_semi" if none else "left_anti")


def recode_sentinel(df: DataFrame, col: str, cond: Column, sentinel: float = -99.0) -> DataFrame:
    """Mark values under `cond` by a sentinel, count on it, then make them missing.

    Adds `<col>_sentinel`, the 0/1 mark, so that marked rows stay countable.
    """
    marked = F.when(is_true(cond), F.lit(sentinel)).otherwise(F.col(col))
    return (df.withColumn(col, marked)
            .withColumn(f"{col}_sentinel", flag(F.col(col) == sentinel))
            .withColumn(col, F.when(F.col(col) != sentinel, F.col(col))))


def destring_clean(df: DataFrame, col: str, strip: str = ",", to: str = "double",
                   out: str | None = None) -> DataFrame:
    """Remove characters, then cast; text that stays non-numeric becomes missing."""
    return df.withColumn(out or col, F.translate(col, strip, "").try_cast(to))


def division_lookup(df: DataFrame, code: str, name: str, above: int | None = None) -> DataFrame:
    """Distinct (code, name) pairs with a known code, optionally above a threshold."""
    cond = F.col(code).isNotNull() if above is None else F.col(code) > above
    return df.where(cond).select(code, name).distinct()


def case_label(df: DataFrame, out: str, rules: list[tuple[Column, str]], default: str) -> DataFrame:
    """Label rows by rules where a later rule overrides an earlier one."""
    label = reduce(lambda acc, r: F.when(is_true(r[0]), F.lit(r[1])).otherwise(acc), rules, F.lit(default))
    return df.withColumn(out, label)


def text_normalize(df: DataFrame, col: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(guard, find, put) in order: where the text holds `guard`, replace every `find`."""
    text = F.col(col)
    for guard, find, put in rules:
        text = F.when(text.contains(guard), F.replace(text, F.lit(find), F.lit(put))).otherwise(text)
    return df.withColumn(col, text)


def manual_override(df: DataFrame, overrides: DataFrame, on: list[str], col: str,
                    cond: Column, mark: str = "overridden") -> DataFrame:
    """Replace `col` for listed keys where `cond` holds, and mark those rows."""
    o = overrides.select(*on, F.col(col).alias("_put"))
    joined = key_join(df, o, on)
    hit = F.col("_put").isNotNull() & is_true(cond)
    return (joined.withColumn(mark, flag(hit))
            .withColumn(col, F.when(hit, F.col("_put")).otherwise(F.col(col))).drop("_put"))
