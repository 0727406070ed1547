"""Contact networks kept in factored form.

Two people are linked on a day when they share a group (a division), with weight
1 / (group size - 1), added up over the groups they share. Writing out the pairs costs
the square of the group size, so no operator here does. Two facts replace them:

* sums over a person's links are sums over the person's groups (group total less own part);
* people with the same set of groups on a day have the same links, so they form one class.
  Classes of a day are bounded by the group sets that occur (with two of D groups per
  person, D * (D + 1) / 2), not by people. Pair weights are stated between classes, with
  the number of pairs they stand for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.missing import m_div
from panelspark.operators import components as stars
from panelspark.operators.keys import attach, cut_lineage, key_join, release
from panelspark.operators.ordered import lag_lead
from panelspark.operators.ranks import running_sums


def contact_weights(members: DataFrame, day: str, group: str, node: str) -> DataFrame:
    """Distinct memberships with the link weight of their group; zero when alone."""
    m = members.select(F.col(day).alias("day"), F.col(group).cast("string").alias("grp"), F.col(node).alias("node")).distinct()
    size = m.groupBy("day", "grp").agg(F.count("*").alias("n"))
    return (m.join(size, ["day", "grp"])
            .select("day", "grp", "node", F.when(F.col("n") > 1, 1 / (F.col("n") - 1)).otherwise(0.0).alias("w")))


def rolling_members(weights: DataFrame, present: DataFrame, span: int) -> DataFrame:
    """Memberships of the last `span` days and today, for people present on each day.

    A group is then a (past day, group) pair; a membership is copied to the span + 1 days
    it counts for, never to other people.
    """
    ahead = F.explode(F.sequence(F.lit(0), F.lit(span)))
    copies = weights.select(F.col("day").alias("_past"), "grp", "node", "w", ahead.alias("_k"))
    copies = copies.select(F.date_add("_past", F.col("_k")).alias("day"),
                           F.concat_ws("@", "grp", F.col("_past").cast("string")).alias("grp"), "node", "w")
    return copies.join(present.select("day", "node").distinct(), ["day", "node"])


def node_strength(weights: DataFrame) -> DataFrame:
    """Weighted degree per (day, node): each group adds weight * (present members - 1)."""
    here = weights.groupBy("day", "grp").agg(F.count("*").alias("_m"))
    return (weights.join(here, ["day", "grp"]).groupBy("day", "node")
            .agg(F.sum(F.col("w") * (F.col("_m") - 1)).alias("strength"), F.count("*").alias("n_groups")))


def rolling_strength(weights: DataFrame, present: DataFrame, spans: list[int]) -> DataFrame:
    """(day, node, strength_<span>...): contact weight of the last `span` days and today, among people present on the day.

    present: (node, start, end), one row per person. A link of a past day counts from when both are present until either leaves or
    the span is over, so a person's strength only changes at such events. They are added up by person and time and swept
    once by running sums, all spans side by side; rows written follow memberships, events and days present, not the spans.
    A person's events are in one task: they are bounded by the calendar.
    """
    m = weights.where("w > 0").join(present.select("node", "start", "end"), "node").where("end >= day")
    m = cut_lineage(m.withColumn("from", F.greatest("day", "start")).select("node", "day", "grp", "w", "from", "end"))
    names = [f"strength_{s}" for s in spans]
    row = lambda time, values, here: F.struct(time.alias("time"), *[v.alias(n) for v, n in zip(values, names)], F.lit(here).alias("here"))

    def moves(at, v):
        """A step of size `v` for every span, and back when the span is over."""
        leave = [row(F.greatest(at, F.date_add("day", s + 1)), [-v if t == s else F.lit(0.0) for t in spans], 0) for s in spans]
        return F.array(row(at, [v] * len(spans), 0), *leave)

    added = [F.sum(n).alias(n) for n in names]
    turns = m.select("day", "grp", "w", F.explode(F.array(F.struct(F.col("from").alias("at"), F.lit(1).alias("k")),
                                                          F.struct(F.date_add("end", 1).alias("at"), F.lit(-1).alias("k")))).alias("t"))
    turns = turns.groupBy("day", "grp", "t.at").agg((F.max("w") * F.sum("t.k")).alias("v"))
    # a group's steps are added up, and packed, before its members take them; none is needed after the last day anyone is present
    last = present.agg(F.max("end")).scalar()
    steps = turns.select("day", "grp", F.inline(moves(F.col("at"), F.col("v")))).where(F.col("time") <= last).groupBy("day", "grp", "time").agg(*added)
    steps = cut_lineage(steps.groupBy("day", "grp").agg(F.collect_list(row(F.col("time"), [F.col(n) for n in names], 0)).alias("steps")))
    # dealt by person before steps are unpacked, so that they meet in the task that unpacks them
    each = m.select("node", "day", "grp", "w", "from").unionByName(present.select("node", "start", "end"), allowMissingColumns=True).repartition("node")
    days = F.transform(F.sequence("start", "end"), lambda d: row(d, [F.lit(0.0)] * len(spans), 1))
    mine = F.when(F.col("w").isNotNull(), F.concat("steps", moves(F.col("from"), -F.col("w")))).otherwise(days)
    sums = (each.join(steps, ["day", "grp"], "left").select("node", F.inline(mine)).where(F.col("time") <= last)
            .groupBy("node", "time").agg(*added, F.max("here").alias("here")))
    run = W.partitionBy("node").orderBy("time").rowsBetween(W.unboundedPreceding, W.currentRow)
    # what has been put in and taken out again is zero but for rounding
    swept = sums.select("node", F.col("time").alias("day"), "here", *[F.round(F.sum(n).over(run), 12).alias(n) for n in names])
    return swept.where("here = 1").select("day", "node", *names)


def node_classes(weights: DataFrame) -> DataFrame:
    """(day, node, cls, grps): the node's set of groups, sorted, and a text that stands for it.

    The text joins the names with "+"; a backslash goes before a "+" or backslash of a name, so different sets
    have different texts. The set itself is never read back from the text.
    """
    plain = F.transform("grps", lambda g: F.regexp_replace(g, r"([+\\])", r"\\$1"))
    return (weights.groupBy("day", "node").agg(F.array_sort(F.collect_set("grp")).alias("grps"))
            .select("day", "node", F.array_join(plain, "+").alias("cls"), "grps"))


def class_links(weights: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(day, grp, w, cls, n, first_node): classes in each group, with size and smallest node."""
    classes = node_classes(weights) if classes is None else classes
    sizes = classes.groupBy("day", "cls").agg(F.count("*").alias("n"), F.min("node").alias("first_node"), F.first("grps").alias("grps"))
    groups = weights.groupBy("day", "grp").agg(F.max("w").alias("w"))
    return (sizes.withColumn("grp", F.explode("grps")).join(groups, ["day", "grp"])
            .select("day", "grp", "w", "cls", "n", "first_node"))


def contact_edges(weights: DataFrame) -> DataFrame:
    """Pair weights between classes: (day, cls_a, cls_b, w, n_pairs), cls_a <= cls_b.

    The self-join is over classes of a group, so it grows with group sets, not people.
    """
    links = cut_lineage(class_links(weights))
    a = links.select("day", "grp", "w", F.col("cls").alias("cls_a"), F.col("n").alias("n_a"))
    b = links.select("day", "grp", F.col("cls").alias("cls_b"), F.col("n").alias("n_b"))
    e = (a.join(b, ["day", "grp"]).where((F.col("cls_a") <= F.col("cls_b")) & (F.col("w") > 0))
         .groupBy("day", "cls_a", "cls_b", "n_a", "n_b").agg(F.sum("w").alias("w")))
    same = F.col("cls_a") == F.col("cls_b")
    pairs = F.when(same, F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b"))
    return e.select("day", "cls_a", "cls_b", "w", pairs.cast("long").alias("n_pairs")).where(F.col("n_pairs") > 0)


def pair_histogram(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """How many of a day's unordered pairs have each weight; absent pairs have weight 0."""
    people = weights.groupBy("day").agg(F.count_distinct("node").alias("_n"))
    linked = edges.groupBy("day", F.round("w", 12).alias("w")).agg(F.sum("n_pairs").alias("n_pairs"))
    held = linked.groupBy("day").agg(F.sum("n_pairs").alias("_held"))
    zero = (people.join(held, "day", "left")
            .select("day", F.lit(0.0).alias("w"),
                    (F.col("_n") * (F.col("_n") - 1) / 2 - F.coalesce("_held", F.lit(0))).cast("long").alias("n_pairs")))
    return linked.unionByName(zero.where(F.col("n_pairs") > 0))


def threshold_edges(edges: DataFrame, weights: DataFrame, q: float) -> tuple[DataFrame, DataFrame]:
    """Class edges at or above the linear-interpolated quantile of all pair weights of the day.

    Returns the edges kept and, per day, the cut-off and the number of pairs kept. Where the cut-off is 0
    every pair is kept; the pairs without a link are then one row of the day, with weight 0, no classes and
    their number, so the rows' pairs add up to the pairs kept.
    """
    hist = running_sums(pair_histogram(edges, weights), ["day"], "w", {"_n": F.sum("n_pairs")}, bounded=True)
    h = (F.col("_n_all") - 1) * F.lit(float(q))
    low = F.col("_n_run") - F.col("_n")
    at = lambda r: F.max(F.when((low < r) & (F.col("_n_run") >= r), F.col("w")))
    base = F.floor(h) + 1
    cut = hist.groupBy("day").agg(
        (at(base) + F.max(h - F.floor(h)) * (at(F.least(base + 1, F.col("_n_all"))) - at(base))).alias("cutoff"))
    kept_n = (hist.join(cut, "day").groupBy("day").agg(
        F.max("cutoff").alias("cutoff"),
        F.sum(F.when(F.col("w") >= F.col("cutoff"), F.col("_n")).otherwise(0)).alias("kept_pairs")))
    kept = edges.join(cut, "day").where(F.round("w", 12) >= F.col("cutoff")).drop("cutoff")
    absent = (hist.where("w = 0").join(cut.where("cutoff <= 0"), "day")
              .select("day", F.lit(None).cast("string").alias("cls_a"), F.lit(None).cast("string").alias("cls_b"),
                      F.lit(0.0).alias("w"), F.col("_n").cast("long").alias("n_pairs")))
    return kept.unionByName(absent), kept_n


def components(links: DataFrame) -> DataFrame:
    """(day, cls, label): connected classes share the smallest node of their component.

    Components are found among the groups, of which there are fewer than classes: a class ties its first group
    to its others. Rounds grow with the logarithm of the longest chain, and the search ends when nothing changes.
    """
    links = cut_lineage(links.select("day", "grp", "w", "cls", "first_node"))
    tied = links.where(F.col("w") > 0).select("day", "cls", F.struct("day", "grp").alias("v"))
    first = tied.groupBy("day", "cls").agg(F.min("v").alias("u"))
    roots = stars.components(tied.join(first, ["day", "cls"]).select("u", "v")).withColumnRenamed("node", "u")
    # a class without a link is a component of its own
    mine = (links.select("day", "cls", "first_node").distinct().join(first, ["day", "cls"], "left").join(roots, "u", "left")
            .select("day", "cls", "first_node", F.coalesce("root", "u").alias("root"), F.when(F.col("u").isNull(), F.col("cls")).alias("alone")))
    label = mine.groupBy("day", "root", "alone").agg(F.min("first_node").alias("label"))
    return key_join(mine, label, ["day", "root", "alone"]).select("day", "cls", "label")


def largest_component(weights: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(day, cls, n, label) of each day's largest component; a tie goes to the smallest node."""
    links = class_links(weights, classes)
    sizes = links.select("day", "cls", "n").distinct()
    state = components(links).join(sizes, ["day", "cls"])
    comp = state.groupBy("day", "label").agg(F.sum("n").alias("_size"))
    top = comp.groupBy("day").agg(F.max_by("label", F.struct(F.col("_size"), -F.col("label"))).alias("label"))
    return state.join(top, ["day", "label"]).select("day", "cls", "n", "label")


# vectors of the search in the order of its columns; each has its image under the matrix next to it
BASIS = ("x", "r", "k", "p")


def _images(links: DataFrame, state: DataFrame, of: str) -> DataFrame:
    """(day, cls, out): the links' matrix times the column `of`, in factored form: a group sum, less the own part.

    In symmetric form class sizes enter by their square roots: sqrt(n_a) * sum over groups of w * sum of sqrt(n_b) v_b, less w * v_a.
    """
    totals = (links.join(state.select("day", "cls", of), ["day", "cls"])
              .groupBy("day", "grp").agg(F.sum(F.sqrt("n") * F.col(of)).alias("_t")))
    return (links.join(totals, ["day", "grp"]).join(state.select("day", "cls", of), ["day", "cls"])
            .groupBy("day", "cls").agg(F.sum(F.col("w") * (F.sqrt("n") * F.col("_t") - F.col(of))).alias("out")))


def _combination(gram: np.ndarray, image: np.ndarray) -> tuple[float, np.ndarray]:
    """Largest Ritz value and its coefficients over a basis with these products; directions that add nothing are left out."""
    size = np.sqrt(np.maximum(np.diag(gram), 0))
    scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    e, q = np.linalg.eigh(gram * scale[:, None] * scale[None, :])
    keep = e > 1e-13
    way = scale[:, None] * q[:, keep] / np.sqrt(e[keep])
    theta, c = np.linalg.eigh(way.T @ image @ way)
    return float(theta[-1]), way @ c[:, -1]


def _leading(links: DataFrame, tol: float, max_iter: int) -> DataFrame:
    """(day, cls, x): leading eigenvector of every day's links, largest entry 1; all days move together.

    Lanczos, restarted after two steps: each round takes the best vector from the span of the current one, its residual, the
    residual's image and the last move, so tables stay a few columns wide. The driver sees the products of these by day. A day is done when its
    residual is below `tol` times its value; that bounds how far value and vector are off (by the gap to the next value).
    """
    state = cut_lineage(links.groupBy("day", "cls").agg(F.max("n").alias("n")).withColumn("x", F.sqrt("n")))
    first = _images(links, state, "x").withColumnRenamed("out", "mx")
    table = cut_lineage(state.join(first, ["day", "cls"]).withColumns({"p": F.lit(0.0), "mp": F.lit(0.0)}))
    release(state)
    theta: dict = {}
    for r in table.groupBy("day").agg(F.sum(F.col("x") * F.col("mx")).alias("a"), F.sum(F.col("x") * F.col("x")).alias("b")).collect():
        theta[r["day"]] = r["a"] / r["b"]
    spark, kind = links.sparkSession, dict(links.dtypes)["day"]
    for _ in range(max_iter):
        values = spark.createDataFrame(list(theta.items()), f"day {kind}, theta double")
        step = table.join(values, "day").withColumn("r", F.col("mx") - F.col("theta") * F.col("x")).drop("theta")
        step = step.join(_images(links, step, "r").withColumnRenamed("out", "mr"), ["day", "cls"])
        step = cut_lineage(step.withColumn("k", F.col("mr")))
        new = cut_lineage(step.join(_images(links, step, "k").withColumnRenamed("out", "mk"), ["day", "cls"]))
        release(step, table)
        pairs = [(i, j) for i in range(4) for j in range(i, 4)]
        cell = lambda i, j, m="": F.sum(F.col(BASIS[i]) * F.col(m + BASIS[j]))
        rows = new.groupBy("day").agg(*[cell(i, j).alias(f"g{i}{j}") for i, j in pairs], *[cell(i, j, "m").alias(f"m{i}{j}") for i, j in pairs]).collect()
        moves, worst = [], 0.0
        for r in rows:
            g, m = np.zeros((4, 4)), np.zeros((4, 4))
            for i, j in pairs:
                g[i, j] = g[j, i] = r[f"g{i}{j}"]
                m[i, j] = m[j, i] = r[f"m{i}{j}"]
            error = np.sqrt(g[1, 1] / g[0, 0]) / max(abs(theta[r["day"]]), np.finfo(float).tiny)
            worst = max(worst, error)
            if error > tol:
                theta[r["day"]], c = _combination(g, m)
            else:
                c = np.array([1.0, 0, 0, 0]) / np.sqrt(g[0, 0])
            moves.append((r["day"], *map(float, c)))
        coef = spark.createDataFrame(moves, f"day {kind}, " + ", ".join(f"c{v} double" for v in BASIS))
        part = lambda names, m="": sum((F.col(f"c{v}") * F.col(m + v) for v in names), F.lit(0.0))
        table = new.join(coef, "day").select("day", "cls", "n", part(BASIS).alias("x"), part(BASIS, "m").alias("mx"), part(BASIS[1:]).alias("p"), part(BASIS[1:], "m").alias("mp"))
        table._scratch_path = new._scratch_path
        if worst <= tol:
            out = table.withColumn("x", F.abs("x") / F.sqrt("n"))
            return attach(out, ["day"], {"_top": F.max("x")}).select("day", "cls", (F.col("x") / F.col("_top")).alias("x"))
    raise RuntimeError(f"centrality not settled after {max_iter} rounds: a residual of {worst:.3g}")


def eigen_centrality(weights: DataFrame, tol: float = 1e-11, max_iter: int = 500) -> DataFrame:
    """(day, node, centrality): leading eigenvector on the largest component, 0 elsewhere.

    Interchangeable people share an entry, so the problem is solved over classes.
    """
    nodes = cut_lineage(node_classes(weights))
    inside = largest_component(weights, nodes).select("day", "cls")
    links = cut_lineage(class_links(weights, nodes).where(F.col("w") > 0).join(inside, ["day", "cls"]).select("day", "grp", "w", "cls", "n"))
    x = _leading(links, tol, max_iter)
    return (nodes.join(x, ["day", "cls"], "left")
            .select("day", "node", F.coalesce("x", F.lit(0.0)).alias("centrality")))


def share_shift(df: DataFrame, k: str, day: str, exposure: str, shift: Column, eligible: Column | None = None) -> DataFrame:
    """Lagged exposure times the day's total shift: raw, scaled by its sd, and as a share.

    Lags, day totals and the raw form use every row. Shares are taken over the `eligible` rows (all, where none is given; a missing
    condition counts as false) and missing on the others; `share_scaled` is the share by its sd.

    `shift_total` is the day's sum of `shift`; the share is missing for a whole day when
    any lag on it is missing; `share_mean` is the entity's mean share.
    """
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    d = lag_lead(df.withColumns({"_s": shift, "_ok": ok}), [k], [day], exposure, 1, "lagged")
    mine = F.when(F.col("_ok"), F.col("lagged"))
    d = attach(cut_lineage(d), [day], {
        "shift_total": F.sum("_s"),
        "_sum": F.when(F.count(mine) == F.count_if("_ok"), F.sum(mine))})
    d = d.withColumns({"bartik": F.col("shift_total") * F.col("lagged"),
                       "share_z": F.when(F.col("_ok"), m_div(F.col("lagged"), F.col("_sum")) * F.col("shift_total"))})
    sd = lambda c: d.agg(F.stddev_samp(c)).scalar()
    return (d.withColumns({"bartik_scaled": m_div(F.col("bartik"), sd("bartik")), "share_scaled": m_div(F.col("share_z"), sd("share_z"))})
            .withColumn("share_mean", F.avg("share_z").over(W.partitionBy(k))).drop("_s", "_sum", "_ok"))


def snapshot_outcome(nodes: DataFrame, outcomes: DataFrame, k: str, day: str, at, horizon: int,
                     aggs: list[Column]) -> DataFrame:
    """Node measures on one day next to outcomes of the following `horizon` days."""
    later = (outcomes.where((F.col(day) > F.lit(at)) & (F.col(day) <= F.date_add(F.lit(at), horizon)))
             .groupBy(k).agg(*aggs))
    return nodes.where(F.col(day) == F.lit(at)).join(later, k, "left")
