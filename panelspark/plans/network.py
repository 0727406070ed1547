"""Entry C: the contact network of people who work at the same division and day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators import graph as N, windows as W
from panelspark.operators.keys import cut_lineage, large
from panelspark.plans import inputs as I
from panelspark.plans.panel import panel


@I.stage
def weights(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(N.contact_weights(I.contacts(spark, sf), "day", "div", "emp"))


@I.stage
def edges(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(N.contact_edges(weights(spark, sf)))


@I.stage
def centrality(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(N.eigen_centrality(weights(spark, sf)))


def rolling(spark: SparkSession, sf: str, spans: list[int]) -> DataFrame:
    """Contact strength over several windows; people are present from their first to their last day in the panel."""
    present = panel(spark, sf).groupBy(F.col("emp").alias("node")).agg(F.min("day").alias("start"), F.max("day").alias("end"))
    return N.rolling_strength(weights(spark, sf), cut_lineage(present), spans)


@I.stage
def node_days(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with contact strength and overtime; days without contact count zero.

    Centrality, a search of many rounds that no reader of these rows uses, stays a table of its own.
    """
    s = N.node_strength(weights(spark, sf)).select("day", F.col("node").alias("emp"), "strength")
    p = panel(spark, sf).select("emp", "day", "worked_hours", "leave_hours", "ot_hours", "injured")
    p = p.join(large(s), ["emp", "day"], "left")
    return cut_lineage(p.withColumns({
        "strength": F.coalesce("strength", F.lit(0.0)),
        "ot_work": (F.col("ot_hours") > 0).cast("int"), "work": (F.col("worked_hours") > 0).cast("int")}))


@I.stage
def shares(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(N.share_shift(node_days(spark, sf), "emp", "day", "strength", F.col("ot_work")))


@I.stage
def eligible_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares over the rows of a stretch of days that are at work or not on leave."""
    at_work = (F.col("leave_hours") == 0) | (F.col("worked_hours") > 0)
    return cut_lineage(N.share_shift(node_days(spark, sf), "emp", "day", "strength", F.col("ot_work"),
                                     at_work & F.col("day").between("2024-01-08", "2024-01-24")))


def snapshot_edges(spark: SparkSession, sf: str, at, spans: list[int], q: float) -> DataFrame:
    """Strongest contacts of several windows up to one day, among people in the panel on that day: one table, with span and cutoff."""
    present = cut_lineage(panel(spark, sf).groupBy(F.col("emp").alias("node")).agg(F.min("day").alias("start"), F.max("day").alias("end"))
                          .where(F.lit(at).between(F.col("start"), F.col("end"))))
    out = []
    for span in spans:
        edges, cutoff, kept = W.threshold_window(weights(spark, sf), present, at, span, q)
        out.append(edges.select(F.lit(span).cast("long").alias("span"), "a", "b", "w", "n_pairs", F.lit(cutoff).alias("cutoff"), F.lit(kept).cast("long").alias("kept_pairs")))
    return reduce(DataFrame.unionByName, out)
