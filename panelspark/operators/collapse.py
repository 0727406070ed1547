"""Group statistics: collapse, totals, leave-one-out, shares, distinct counts, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.dates import round_to
from panelspark.functions.missing import flag, is_true, m_div, sum0
from panelspark.operators.keys import attach

STATS = {
    "sum": sum0, "mean": F.avg, "min": F.min, "max": F.max, "sd": F.stddev_samp,
    "count": F.count, "firstnm": F.max, "n_distinct": F.count_distinct,
}


def _aggs(stats: dict[str, tuple[str, object]]) -> dict[str, Column]:
    out = {}
    for name, (stat, x) in stats.items():
        x = F.col(x) if isinstance(x, str) else x
        c = STATS[stat](x)
        out[name] = c.cast("long") if stat in ("count", "n_distinct") else c
    return out


def collapse_multi(df: DataFrame, k: list[str], stats: dict[str, tuple[str, object]]) -> DataFrame:
    """One row per key with mixed statistics {out: (stat, column)}; missing keys are a group."""
    return df.groupBy(*k).agg(*[c.alias(n) for n, c in _aggs(stats).items()])


def group_total(df: DataFrame, k: list[str], stats: dict[str, tuple[str, object]]) -> DataFrame:
    """The same statistics on every row; an empty key list means the whole table."""
    aggs = _aggs(stats)
    if k:
        return attach(df, k, aggs)
    return df.withColumns({n: df.agg(c).scalar() for n, c in aggs.items()})


def staged_collapse(df: DataFrame, keys: list[str], kind: str, sick: str, hours: str,
                    sums: list[str], mark: str, rate: str, not_leave: str = "not leave") -> DataFrame:
    """Records to (keys): net per code first, zero negative leave per code, then add up.

    Corrections cancel inside a code; a net negative leave code counts as zero instead of
    eating into another code.
    """
    per_code = df.groupBy(*keys, kind, sick).agg(
        *[sum0(c).alias(c) for c in (hours, *sums)], F.max(mark).alias(mark), F.max(rate).alias(rate))
    is_leave = F.col(kind) != not_leave
    net = F.when(is_leave & (F.col(hours) < 0), 0.0).otherwise(F.col(hours))
    return (per_code.withColumn(hours, net)
            .withColumns({
                "worked_hours": F.when(is_leave, 0.0).otherwise(F.col(hours)),
                "leave_hours": F.when(is_leave, F.col(hours)).otherwise(0.0),
                "sick_hours": F.when(F.col(sick) == 1, F.col(hours)).otherwise(0.0)})
            .groupBy(*keys).agg(
                *[sum0(c).alias(c) for c in ("worked_hours", "leave_hours", "sick_hours", *sums)],
                F.max(mark).alias(mark), F.max(rate).alias(rate)))


def ever_flag(df: DataFrame, k: list[str], cond: Column, out: str) -> DataFrame:
    """Whether any row of the entity meets the condition, on all its rows."""
    return attach(df, k, {out: F.max(flag(cond))})


def leave_one_out(df: DataFrame, k: list[str], parts: dict[str, Column], size: str = "group_size") -> DataFrame:
    """Group sums less the row's own part, for several parts in one pass."""
    own = df.withColumns({f"_own_{n}": c for n, c in parts.items()})
    out = attach(own, k, {size: F.count("*"), **{f"_all_{n}": sum0(f"_own_{n}") for n in parts}})
    return (out.withColumns({n: F.col(f"_all_{n}") - F.coalesce(f"_own_{n}", F.lit(0)) for n in parts})
            .drop(*[f"_own_{n}" for n in parts], *[f"_all_{n}" for n in parts]))


def leave_one_out_count(df: DataFrame, k: list[str], cond: Column, out: str) -> DataFrame:
    """How many other members of the group meet the condition."""
    return (leave_one_out(df, k, {out: flag(cond)}, "_size").drop("_size")
            .withColumn(out, F.col(out).cast("long")))


def leave_one_out_share(df: DataFrame, k: list[str], cond: Column, out: str) -> DataFrame:
    """Share of the other members that meet the condition; zero when there are none."""
    x = leave_one_out(df, k, {out: flag(cond)}, "_size")
    share = F.when(F.col("_size") == 1, 0.0).otherwise(m_div(F.col(out), F.col("_size") - 1))
    return x.withColumn(out, share).drop("_size")


def count_distinct(df: DataFrame, k: list[str], cols: list[str]) -> DataFrame:
    """Exact distinct counts per key; an empty key list counts over the table."""
    return df.groupBy(*k).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in cols])


def distinct_flags_by_year(df: DataFrame, year: str, counts: dict[str, list[str]],
                           total_name: str = "Overall") -> DataFrame:
    """Records and distinct combinations per year, with one more row over all years.

    Each count first reduces to its distinct keys, so no group is held by one task.
    """
    base = df.withColumn("_y", F.explode(F.array(F.col(year).cast("string"), F.lit(total_name))))
    aggs = [F.count("*").alias("recs")]
    for name, cols in counts.items():
        aggs.append(F.count_distinct(*[F.col(c) for c in cols]).alias(name))
    return base.groupBy(F.col("_y").alias(year)).agg(*aggs)


def total_row_union(df: DataFrame, label: str, total_name: str, aggs: list[Column]) -> DataFrame:
    """Group rows plus one row for the total, in a single pass with grouping sets."""
    return (df.groupingSets([[label], []], label).agg(F.grouping(label).alias("_tot"), *aggs)
            .withColumn(label, F.when(F.col("_tot") == 1, F.lit(total_name)).otherwise(F.col(label)))
            .withColumnRenamed("_tot", "is_total"))


def group_share(df: DataFrame, label: str, total_name: str = "All Types") -> DataFrame:
    """Counts per label and their share of all rows, the total row included."""
    counts = total_row_union(df, label, total_name, [F.count("*").alias("n")])
    return counts.withColumn("share", F.col("n") / df.agg(F.count("*")).scalar())


def binned_mean(df: DataFrame, y: str, x: str, step: float, by: list[str] | None = None) -> DataFrame:
    """Mean outcome by x rounded to a multiple of `step`, with the bin size."""
    return (df.where(F.col(x).isNotNull()).withColumn("bin", round_to(x, step))
            .groupBy(*(by or []), "bin").agg(F.avg(y).alias("mean"), F.count(y).alias("n")))


def group_mean_listwise(df: DataFrame, k: list[str], cols: list[str]) -> DataFrame:
    """Mean and sd per key over rows where every listed column is present."""
    full = df.dropna(subset=cols)
    return full.groupBy(*k).agg(F.count("*").alias("n"),
                                *[a for c in cols for a in (F.avg(c).alias(f"mean_{c}"),
                                                            F.stddev_samp(c).alias(f"sd_{c}"))])


def event_prob_share(df: DataFrame, k: list[str], num: Column, den: Column, event: str) -> DataFrame:
    """Share of eligible rows with the outcome, and whether the event ever came."""
    eligible = is_true(den)
    return df.groupBy(*k).agg(
        m_div(F.sum(flag(is_true(num) & eligible)), F.sum(flag(den))).alias("share"),
        F.max(event).alias("any_event"))


def mode_no_ties(df: DataFrame, k: list[str], col: str, out: str) -> DataFrame:
    """Most frequent value per entity; missing when two values tie.

    Counts per value, then counts per frequency: each step is a partial aggregate.
    """
    freq = df.where(F.col(col).isNotNull()).groupBy(*k, col).agg(F.count("*").alias("_n"))
    level = freq.groupBy(*k, "_n").agg(F.count("*").alias("_ties"), F.min(col).alias("_v"))
    top = level.groupBy(*k).agg(F.max_by(F.struct("_ties", "_v"), "_n").alias("_top"))
    return top.select(*k, F.when(F.col("_top._ties") == 1, F.col("_top._v")).alias(out))
