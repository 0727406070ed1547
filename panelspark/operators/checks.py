"""Data-quality checks that report (check, n_violations, ok); raising is up to the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.missing import is_true


def _report(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """All counts in one aggregation pass, then one row per check."""
    one = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(f"_{i}") for i, c in enumerate(counts.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"_{i}").alias("n_violations"))
                     for i, n in enumerate(counts)])
    return (one.select(F.inline(rows))
            .withColumn("ok", (F.col("n_violations") == 0).cast("int")))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Count rows that break each rule; a rule that is unknown counts as broken."""
    return _report(df, {n: F.sum(F.when(is_true(c), 0).otherwise(1)) for n, c in rules.items()})


def check_unique(df: DataFrame, k: list[str], allow_missing: bool = False) -> DataFrame:
    """Keys on more than one row, and rows with a missing key part unless allowed."""
    dup = df.groupBy(*k).agg(F.count("*").alias("_n"))
    counts = {"duplicate_keys": F.sum((F.col("_n") > 1).cast("int"))}
    if not allow_missing:
        gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in k])
        counts["missing_key_rows"] = F.sum(F.when(gap, F.col("_n")).otherwise(0))
    return _report(dup, counts)


def check_not_missing(df: DataFrame, rules: dict[str, str | tuple[str, str]]) -> DataFrame:
    """`col` present, or for a pair (a, b): b present wherever a is."""
    def rule(r):
        return F.col(r).isNotNull() if isinstance(r, str) else F.col(r[0]).isNull() | F.col(r[1]).isNotNull()
    return violations(df, {n: rule(r) for n, r in rules.items()})


def check_bounds(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return violations(df, rules)


def check_count(df: DataFrame, name: str, counted: Column, expected: int) -> DataFrame:
    """Distance between a count and its expected value."""
    return _report(df, {name: F.abs(F.count(F.when(is_true(counted), 1)) - expected)})


def check_match(merged: DataFrame, rules: dict[str, list[int]]) -> DataFrame:
    """Merge codes that must not occur, by rule name."""
    return _report(merged, {n: F.sum(F.col("_merge").isin(bad).cast("int")) for n, bad in rules.items()})


def constancy_in_group(df: DataFrame, k: list[str], cols: list[str]) -> DataFrame:
    """Per column: entities that hold more than one value (missing is a value)."""
    per = df.groupBy(*k).agg(*[(F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count("*"))))
                               .alias(c) for c in cols])
    return _report(per, {c: F.sum((~F.col(c)).cast("int")) for c in cols})


def require(report: DataFrame) -> None:
    """Raise when a report (a few rows, one per check) has a failed check."""
    bad = report.where(F.col("ok") == 0).collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['n_violations']}" for r in bad))
