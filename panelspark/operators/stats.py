"""Percentile tables, moments, bins, densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.missing import m_div
from panelspark.operators.keys import cut_lineage, key_join
from panelspark.operators.ranks import row_positions, running_sums

SQRT5 = math.sqrt(5)


def _long(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*by, F.inline(pairs)).where(F.col("value").isNotNull())


def _at_percentiles(hist: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Percentiles from distinct values with running counts `_n`, `_n_run`, `_n_all`."""
    low = F.col("_n_run") - F.col("_n")
    aggs = []
    for q in qs:
        p = F.col("_n_all") * F.lit(float(q)) / 100
        whole = p == F.floor(p)
        lo_rank = F.greatest(F.ceil(p), F.lit(1))
        hi_rank = F.least(F.when(whole, p + 1).otherwise(lo_rank), F.col("_n_all"))
        at = lambda r: F.max(F.when((low < r) & (F.col("_n_run") >= r), F.col(value)))
        aggs.append(((at(lo_rank) + at(hi_rank)) / 2).alias(f"p{q:g}"))
    return hist.groupBy(*keys).agg(*aggs)


def percentiles(df: DataFrame, cols: list[str], qs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, variable, p..): percentiles by averaging at exact ranks.

    With n sorted values and P = n*q/100, an integer P averages the P-th and the next
    value, any other P takes the value at the next whole rank. Each group is reduced to
    distinct values with running counts, never sorted in one task.
    """
    keys = [*(by or []), "variable"]
    hist = running_sums(_long(df, cols, by or []), keys, "value", {"_n": F.count("*")})
    return _at_percentiles(hist, keys, "value", qs)


def tabstat(df: DataFrame, cols: list[str], qs: list[float], by: list[str] | None = None) -> DataFrame:
    """Count, mean, sd and percentiles, one row per variable (and group)."""
    keys = [*(by or []), "variable"]
    base = _long(df, cols, by or []).groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return key_join(base, percentiles(df, cols, qs, by), keys)


def summarize_detail(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Moments (population-central skewness and kurtosis), range and percentiles."""
    keys = [*(by or []), "variable"]
    base = _long(df, cols, by or []).groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.var_samp("value").alias("variance"), F.skewness("value").alias("skewness"),
        (F.kurtosis("value") + 3).alias("kurtosis"), F.min("value").alias("min"), F.max("value").alias("max"))
    return key_join(base, percentiles(df, cols, [1, 5, 10, 25, 50, 75, 90, 95, 99], by), keys)


def median_flag(df: DataFrame, col: str, out: str, tol: float = 1e-6) -> DataFrame:
    """Rows whose value is the median up to `tol`."""
    med = percentiles(df, [col], [50]).agg(F.max("p50")).scalar()
    return df.withColumn(out, (F.abs(F.col(col) - med) < tol).cast("int"))


def corr(x: str, y: str) -> Column:
    """Correlation of the rows with both values; missing, not an error, if either column does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sd = lambda c: F.stddev_pop(F.when(both, F.col(c)))
    return F.try_divide(F.covar_pop(x, y), sd(x) * sd(y))


def corr_pair(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*(by or [])).agg(
        F.count("*").alias("n"), corr(x, y).alias("corr"))


def freq_table(df: DataFrame, col: str) -> DataFrame:
    """Counts, percent and cumulative percent, most frequent first, ties by value."""
    counts = df.groupBy(col).agg(F.count("*").alias("freq"))
    levels = running_sums(counts.withColumn("_neg", -F.col("freq")), [], "_neg",
                          {"_f": F.sum("freq"), "_c": F.count("*")})
    levels = levels.select((-F.col("_neg")).alias("freq"), "_f_all",
                           (F.col("_f_run") - F.col("_f")).alias("_rows_above"),
                           (F.col("_c_run") - F.col("_c")).alias("_labels_above"))
    pos = row_positions(counts, [], ["-freq", col], "_pos").join(levels, "freq")
    cum = F.col("_rows_above") + (F.col("_pos") - F.col("_labels_above")) * F.col("freq")
    return pos.select(col, "freq", (F.col("freq") * 100 / F.col("_f_all")).alias("pct"),
                      (cum * 100 / F.col("_f_all")).alias("cum_pct"))


def quantile_bins(df: DataFrame, y: str, x: str, n: int) -> DataFrame:
    """Means by n quantile bins of x; equal cut points merge, so fewer bins may come back.

    A bin is the number of distinct inner cut points below x, so it comes from the running
    counts of x's distinct values and needs no join of rows to cuts.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    hist = cut_lineage(running_sums(d.withColumn("_x", F.col(x).cast("double")), [], "_x",
                                    {"_n": F.count("*"), "_sy": F.sum(F.col(y).cast("double"))}))
    qs = [100 * i / n for i in range(1, n)]
    cuts = _at_percentiles(hist, [], "_x", qs).select(F.array_distinct(F.array(*[f"`p{q:g}`" for q in qs]))).scalar()
    bins = (hist.withColumn("_cuts", cuts)
            .withColumn("bin", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_x"))), F.lit(0)) + 1))
    return bins.groupBy("bin").agg(
        F.sum("_n").alias("n"), m_div(F.sum(F.col("_x") * F.col("_n")), F.sum("_n")).alias("mean_x"),
        m_div(F.sum("_sy"), F.sum("_n")).alias("mean_y"))


def equal_width_bins(df: DataFrame, x: str, n: int, y: str | None = None) -> DataFrame:
    """n bins between minimum and maximum: start, count, fraction, density, mean of y."""
    d = df.where(F.col(x).isNotNull())
    # three one-row statistics of one shared aggregate
    lim = d.agg(F.struct(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"),
                         F.count("*").alias("n"))).scalar()
    d = d.withColumn("_l", lim)
    width = (F.col("_l.hi") - F.col("_l.lo")) / n
    pos = F.least(F.floor(m_div(F.col(x) - F.col("_l.lo"), width)), F.lit(n - 1))
    d = d.withColumns({"_w": width, "bin": F.coalesce(pos, F.lit(0)).cast("int")})
    total = F.max("_l.n")
    aggs = [(F.max("_l.lo") + F.max("bin") * F.max("_w")).alias("start"), F.count("*").alias("n"),
            (F.count("*") / total).alias("fraction"),
            m_div(F.count("*") / total, F.max("_w")).alias("density")]
    if y:
        aggs.append(F.avg(y).alias("mean_y"))
    return d.groupBy("bin").agg(*aggs)


def kde_grid(df: DataFrame, x: str, n_points: int, by: list[str] | None = None) -> DataFrame:
    """Kernel density on an even grid over the range widened by one bandwidth.

    Bandwidth 0.9 * min(sd, IQR / 1.349) * n^(-1/5) per group. The kernel is a parabola on its support, so all values that reach the
    same points of the grid enter by three sums; rows are read once for these, and only the sums meet the grid.
    """
    by = by or []
    stats = tabstat(df, [x], [25, 75], by).drop("variable")
    low_high = F.struct(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    if by:
        stats = key_join(stats, df.groupBy(*by).agg(low_high.alias("_r")), by)
    else:
        stats = stats.withColumn("_r", df.agg(low_high).scalar())
    iqr = (F.col("p75") - F.col("p25")) / 1.349
    spread = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    stats = stats.select(*by, F.col("n").alias("_n"), (spread * 0.9 * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("_h"), F.col("_r.lo").alias("_lo"), F.col("_r.hi").alias("_hi"))
    stats = stats.select(*by, "_n", "_h", (F.col("_lo") - F.col("_h")).alias("_at"), ((F.col("_hi") - F.col("_lo") + F.col("_h") * 2) / (n_points - 1)).alias("_step"))
    d = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"))
    if by:
        d = key_join(d, stats, by, "inner")
    else:
        one = stats.agg(F.max(F.struct("_n", "_h", "_at", "_step"))).scalar()
        d = d.withColumn("_s", one).select("_x", "_s.*")
    reach = F.col("_h") * SQRT5
    place = (F.col("_x") - F.col("_at"))
    # without spread all values lie on one spot, and no point is within a bandwidth of zero
    d = d.where("_h > 0").withColumns({"_first": F.greatest(F.ceil((place - reach) / F.col("_step")), F.lit(0)).cast("int"),
                                       "_last": F.least(F.floor((place + reach) / F.col("_step")), F.lit(n_points - 1)).cast("int")})
    u = (F.col("_x") - F.col("_at") - F.col("_first") * F.col("_step")) / F.col("_h")
    own = ["_n", "_h", "_at", "_step"]
    sums = (d.where("_first <= _last").withColumn("_u", u).groupBy(*by, "_first", "_last", *own)
            .agg(F.count("*").alias("_c"), F.sum("_u").alias("_su"), F.sum(F.col("_u") * F.col("_u")).alias("_suu")))
    z = (F.col("point") - F.col("_first")) * F.col("_step") / F.col("_h")
    part = F.col("_c") - (z * z * F.col("_c") - z * F.col("_su") * 2 + F.col("_suu")) / 5
    found = sums.withColumn("point", F.explode(F.sequence("_first", "_last"))).groupBy(*by, "point").agg(F.sum(part).alias("_k"))
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))))
    out = key_join(grid, found, [*by, "point"])
    density = F.try_divide(F.coalesce(F.greatest("_k", F.lit(0.0)), F.lit(0.0)) * (0.75 / SQRT5), F.col("_n") * F.col("_h"))
    return out.select(*by, "point", (F.col("_at") + F.col("point") * F.col("_step")).alias("x_at"), density.alias("density"))
