"""Ranks, positions and running totals for groups of any size.

A window over a whole group sorts that group in one task. Here a group is first
reduced to its distinct values, which are then cut into ranges of about equal weight
that are sorted apart; group-wide numbers come from the running totals of ranges.
No task holds more than one range of one group, whatever share a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.operators.keys import cut_lineage, key_join

def running_sums(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column],
                 bounded: bool = False) -> DataFrame:
    """Per group and distinct value: each sum, its running total and its group total.

    Output columns `<name>`, `<name>_run` (up to and including the value, missing last)
    and `<name>_all`. `bounded` says a group has few distinct values (days, hours), so
    one window per group is enough. Otherwise the distinct values, of any sortable type, are
    dealt in order of group and value to as many ranges as the session shuffles to; a range's
    window holds its own part of a group only.
    """
    hist = df.groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()])
    order = F.col(value).asc_nulls_last()
    if bounded:
        w = W.partitionBy(*keys)
        run = w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return hist.withColumns({**{f"{n}_run": F.sum(n).over(run) for n in sums},
                                 **{f"{n}_all": F.sum(n).over(w) for n in sums}})
    spread = cut_lineage(hist).repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys], order)
    hist = cut_lineage(spread.withColumn("_b", F.spark_partition_id()))
    w = W.partitionBy(*keys)
    ranges = hist.groupBy(*keys, "_b").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    before = w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(
        *keys, "_b",
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in sums],
        *[F.sum(f"_{n}").over(w).alias(f"{n}_all") for n in sums])
    inside = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = hist.withColumns({f"_{n}_in": F.sum(n).over(inside) for n in sums})
    out = key_join(out, ranges, [*keys, "_b"])
    return out.select(*keys, value, *sums,
                      *[(F.col(f"_{n}_in") + F.col(f"_{n}_before")).alias(f"{n}_run") for n in sums],
                      *[f"{n}_all" for n in sums])


def row_positions(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1..n inside each group, in the order of any columns, text included.

    A leading "-" sorts a column downward; missing values come last either way.
    Range-partitioned sort, written once, plus offsets from per-partition counts.
    """
    by = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]
    spread = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in keys], *by).withColumn("_p", F.spark_partition_id())
    spread = cut_lineage(spread)
    counts = spread.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1)))
    counts = counts.withColumn("_before", F.coalesce(
        F.sum("_n").over(before.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy(*keys, "_p").orderBy(*by))
    return (key_join(spread.withColumn("_i", local), counts, [*keys, "_p"])
            .withColumn(out, (F.col("_i") + F.col("_before")).cast("long"))
            .drop("_p", "_i", "_before"))


def rank_from_top(n: str) -> Column:
    """Highest-first rank of a distinct value from its running count and group count."""
    return (F.col(f"{n}_all") - F.col(f"{n}_run") + 1).cast("long")


def field_rank(df: DataFrame, k: list[str], col: str, out: str, bounded: bool = False) -> DataFrame:
    """Rank inside a group, highest value = 1, ties share, missing unranked."""
    has = F.col(col).isNotNull().cast("long")
    hist = running_sums(df, k, col, {"_cnt": F.sum(has)}, bounded)
    ranks = hist.select(*k, col, F.when(F.col(col).isNotNull(), rank_from_top("_cnt")).alias(out))
    return key_join(df, ranks, [*k, col])


def rank_gap_counts(df: DataFrame, k: list[str], rank: str, cond: Column, below: str,
                    above: str, bounded: bool = False) -> DataFrame:
    """How many flagged members rank below (number larger) and above each row.

    A row with a missing rank counts every flagged member as above and none as below;
    flagged members with a missing rank are never counted.
    """
    hit = F.when(cond & F.col(rank).isNotNull(), 1).otherwise(0)
    hist = running_sums(df, k, rank, {"_f": F.sum(hit)}, bounded)
    counts = hist.select(*k, rank,
                         F.when(F.col(rank).isNull(), 0).otherwise(F.col("_f_all") - F.col("_f_run"))
                         .cast("long").alias(below),
                         (F.col("_f_run") - F.col("_f")).cast("long").alias(above))
    return key_join(df, counts, [*k, rank])


def topk_per_group_dynamic(df: DataFrame, k: list[str], o: list[str], quota: str,
                           out: str = "position") -> DataFrame:
    """The first `quota` rows of each group, where the quota is a column of the group."""
    return row_positions(df, k, o, out).where(F.col(out) <= F.col(quota))


def group_positions(df: DataFrame, k: list[str], order: str, tie: str, out: str, ranges: Column) -> DataFrame:
    """1..n inside each group by a numeric order of known law, such as a draw.

    `ranges` is the range number of a row, rising with the order, so no pass over the data
    is needed to balance the ranges. Equal values are ordered by `tie`. Use `row_positions`
    for other orders.
    """
    spread = df.withColumn("_b", ranges)
    counts = spread.groupBy(*k, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*k).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*k, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(*k, "_b").orderBy(F.col(order).asc_nulls_last(), tie))
    return (key_join(spread.withColumn("_i", local), counts, [*k, "_b"])
            .withColumn(out, (F.col("_i") + F.col("_before")).cast("long"))
            .drop("_b", "_i", "_before"))


def group_id(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """Dense id 1..G per distinct key, numbered in sorted order (text as text)."""
    ids = row_positions(df.select(*cols).distinct(), [], cols, out)
    return key_join(df, ids, cols)


def every_nth_row(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first row, the last row and each n-th row of a sorted table."""
    pos = row_positions(df, [], order, "_pos")
    last = pos.agg(F.max("_pos")).scalar()
    keep = (F.col("_pos") == 1) | (F.col("_pos") % n == 0) | (F.col("_pos") == last)
    return pos.where(keep).drop("_pos")
