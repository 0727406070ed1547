"""Contact network queries; the comparison SQL enumerates pairs on the small tables."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.catalog.registry import query
from panelspark.operators import graph as N
from panelspark.plans import network as C

CLASSES = "cls AS (SELECT day, emp, string_agg(div::VARCHAR, '+' ORDER BY div) AS cls FROM @contacts GROUP BY day, emp)"


@query("contact_edges", "day s, cls_a s, cls_b s, w d, n_pairs l", f"""
    WITH {CLASSES}
MAIN SELECT p.day, a.cls AS cls_a, b.cls AS cls_b, max(p.w) AS w, count(*) AS n_pairs
    FROM (SELECT day, least(i, j) AS i, greatest(i, j) AS j, w FROM @pairs WHERE i < j) p
    JOIN cls a0 ON a0.day = p.day AND a0.emp = p.i JOIN cls b0 ON b0.day = p.day AND b0.emp = p.j,
    LATERAL (SELECT least(a0.cls, b0.cls) AS cls) a, LATERAL (SELECT greatest(a0.cls, b0.cls) AS cls) b
    GROUP BY p.day, a.cls, b.cls""")
def q_contact_edges(spark, sf):
    return C.edges(spark, sf)


@query("self_cross_by_day", "day s, w d, n_pairs l", """
    WITH n AS (SELECT DISTINCT day, emp FROM @contacts)
MAIN SELECT a.day, coalesce(round(p.w, 12), 0) AS w, count(*) AS n_pairs
    FROM n a JOIN n b ON a.day = b.day AND a.emp < b.emp LEFT JOIN @pairs p ON p.day = a.day AND p.i = a.emp AND p.j = b.emp
    GROUP BY ALL""")
def q_self_cross_by_day(spark, sf):
    """All pairs of people present on a day, counted by weight without listing them."""
    return N.pair_histogram(C.edges(spark, sf), C.weights(spark, sf))


@query("node_strength", "day s, node l, strength d", """
    SELECT n.day, n.emp AS node, coalesce(sum(p.w), 0) AS strength FROM (SELECT DISTINCT day, emp FROM @contacts) n
    LEFT JOIN @pairs p ON p.day = n.day AND p.i = n.emp GROUP BY ALL""")
def q_node_strength(spark, sf):
    return N.node_strength(C.weights(spark, sf))


@query("node_strength_rolling", "day s, node l, strength d", """
    WITH n AS (SELECT DISTINCT day, emp FROM @contacts)
MAIN SELECT a.day, a.emp AS node, coalesce(sum(p.w), 0) AS strength FROM n a
    LEFT JOIN (SELECT p.*, b.day AS at FROM @pairs p JOIN n b ON b.emp = p.j) p
      ON p.i = a.emp AND p.at = a.day AND p.day BETWEEN a.day - 7 AND a.day
    WHERE EXISTS (SELECT 1 FROM @contacts c WHERE c.emp = a.emp AND c.day BETWEEN a.day - 7 AND a.day) GROUP BY ALL""")
def q_node_strength_rolling(spark, sf):
    """Contact strength over the last seven days and today, among people present today."""
    w = C.weights(spark, sf)
    return N.node_strength(N.rolling_members(w, w, 7))


SPANS = [7, 30, 90, 180, 1000]


@query("node_strength_windows", "day s, node l, " + ", ".join(f"strength_{s} d" for s in SPANS), f"""
    WITH n AS (SELECT emp, min(day) AS lo, max(day) AS hi FROM @panel GROUP BY emp),
    t AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day, emp FROM n),
    l AS (SELECT t.day, t.emp, t.day - p.day AS ago, p.w FROM t JOIN @pairs p ON p.i = t.emp AND p.day <= t.day
          JOIN n ON n.emp = p.j AND t.day BETWEEN n.lo AND n.hi)
MAIN SELECT t.day, t.emp AS node, {', '.join(f'coalesce(sum(l.w) FILTER (ago <= {s}), 0) AS strength_{s}' for s in SPANS)}
    FROM t LEFT JOIN l ON l.day = t.day AND l.emp = t.emp GROUP BY ALL""")
def q_node_strength_windows(spark, sf):
    """Contact strength over five windows for everyone in the panel on a day."""
    return C.rolling(spark, sf, SPANS)


COMPONENTS = """links AS (SELECT DISTINCT a.day, a.div AS a, b.div AS b FROM @contacts a JOIN @contacts b ON a.day = b.day AND a.emp = b.emp),
    reach AS (SELECT day, a, a AS b FROM links UNION SELECT r.day, r.a, l.b FROM reach r JOIN links l ON l.day = r.day AND l.a = r.b),
    comp AS (SELECT day, a AS div, min(b) AS label FROM reach GROUP BY day, a),
    nodes AS (SELECT DISTINCT c.day, c.emp, k.label FROM @contacts c JOIN comp k ON c.day = k.day AND c.div = k.div),
    size AS (SELECT day, label, count(*) AS n, min(emp) AS lo FROM nodes GROUP BY day, label),
    best AS (SELECT day, arg_max(label, (n, -lo)) AS label FROM size GROUP BY day),
    inside AS (SELECT n.day, n.emp FROM nodes n JOIN best b ON n.day = b.day AND n.label = b.label)"""


@query("largest_component", "day s, node l", f"""
    WITH RECURSIVE {COMPONENTS}
MAIN SELECT day, emp AS node FROM inside""")
def q_largest_component(spark, sf):
    w = C.weights(spark, sf)
    return N.node_classes(w).join(N.largest_component(w).select("day", "cls"), ["day", "cls"])


def eigen_sql(squarings: int = 14) -> str:
    """Centrality by repeated squaring of the class matrix, one SQL step per squaring."""
    ctes = [COMPONENTS, CLASSES,
            "ci AS (SELECT c.* FROM cls c JOIN inside i ON i.day = c.day AND i.emp = c.emp)",
            "k AS (SELECT day, cls, count(*) AS n FROM ci GROUP BY ALL)",
            "kg AS (SELECT DISTINCT c.day, c.cls, s.div, s.n AS size FROM ci c JOIN @sized s ON s.day = c.day AND s.emp = c.emp)",
            """q0 AS MATERIALIZED (SELECT a.day, a.cls AS r, b.cls AS c,
                 sum(1.0::DOUBLE / (a.size - 1) * (k.n - (a.cls = b.cls)::INT)) AS v
               FROM kg a JOIN kg b ON a.day = b.day AND a.div = b.div JOIN k ON k.day = b.day AND k.cls = b.cls
               WHERE a.size > 1 GROUP BY ALL)"""]
    ctes.append("""t0 AS MATERIALIZED (SELECT day, r, c, v / max(v) OVER (PARTITION BY day) AS v FROM
        (SELECT day, r, c, sum(v) AS v FROM (SELECT * FROM q0 UNION ALL SELECT DISTINCT day, r, r, 1.0::DOUBLE FROM q0) GROUP BY ALL))""")
    for i in range(1, squarings + 1):
        ctes.append(f"""t{i} AS MATERIALIZED (SELECT day, r, c, v / max(v) OVER (PARTITION BY day) AS v FROM
          (SELECT a.day, a.r, b.c, sum(a.v * b.v) AS v FROM t{i - 1} a JOIN t{i - 1} b ON a.day = b.day AND a.c = b.r GROUP BY ALL))""")
    ctes.append(f"x AS (SELECT day, r AS cls, sum(v) AS x FROM t{squarings} GROUP BY ALL)")
    ctes.append("y AS (SELECT day, cls, x / max(x) OVER (PARTITION BY day) AS x FROM x)")
    return "WITH RECURSIVE " + ",\n".join(ctes) + """
MAIN SELECT c.day, c.emp AS node, coalesce(y.x, 0) AS centrality FROM cls c LEFT JOIN y ON y.day = c.day AND y.cls = c.cls"""


@query("eigen_centrality", "day s, node l, centrality d", eigen_sql())
def q_eigen_centrality(spark, sf):
    return C.centrality(spark, sf)


@query("threshold_edges", "day s, cutoff d, kept_pairs l", """
    WITH n AS (SELECT DISTINCT day, emp FROM @contacts),
    p AS (SELECT a.day, coalesce(round(p.w, 12), 0) AS w FROM n a JOIN n b ON a.day = b.day AND a.emp < b.emp
          LEFT JOIN @pairs p ON p.day = a.day AND p.i = a.emp AND p.j = b.emp),
    c AS (SELECT day, quantile_cont(w, 0.95) AS cutoff FROM p GROUP BY day)
MAIN SELECT p.day, any_value(cutoff) AS cutoff, count(*) FILTER (w >= cutoff) AS kept_pairs FROM p JOIN c ON p.day = c.day GROUP BY p.day""")
def q_threshold_edges(spark, sf):
    return N.threshold_edges(C.edges(spark, sf), C.weights(spark, sf), 0.95)[1]


@query("threshold_edges_kept", "day s, cls_a s, cls_b s, w d, n_pairs l", f"""
    WITH {CLASSES}, n AS (SELECT DISTINCT day, emp FROM @contacts),
    p AS (SELECT a.day, a.emp AS i, b.emp AS j, coalesce(round(p.w, 12), 0) AS w FROM n a JOIN n b ON a.day = b.day AND a.emp < b.emp
          LEFT JOIN @pairs p ON p.day = a.day AND p.i = a.emp AND p.j = b.emp),
    c AS (SELECT day, quantile_cont(w, 0.95) AS cutoff FROM p GROUP BY day)
MAIN SELECT p.day, least(a.cls, b.cls) AS cls_a, greatest(a.cls, b.cls) AS cls_b, max(w) AS w, count(*) AS n_pairs
    FROM p JOIN c ON p.day = c.day AND p.w >= cutoff JOIN cls a ON a.day = p.day AND a.emp = p.i JOIN cls b ON b.day = p.day AND b.emp = p.j
    WHERE w > 0 GROUP BY ALL""")
def q_threshold_edges_kept(spark, sf):
    return N.threshold_edges(C.edges(spark, sf), C.weights(spark, sf), 0.95)[0]


SNAPSHOT = dt.date(2024, 1, 29)
WINDOWS = [7, 30, 1000]


def window_sql(span: int) -> str:
    """Every pair of people present, by its weight over the window; classes by their sets of groups."""
    return f"""
    (WITH n AS (SELECT emp FROM @panel GROUP BY emp HAVING DATE '{SNAPSHOT}' BETWEEN min(day) AND max(day)),
    p AS (SELECT i, j, sum(w) AS w FROM @pairs WHERE day BETWEEN DATE '{SNAPSHOT}' - {span} AND DATE '{SNAPSHOT}' GROUP BY ALL),
    e AS (SELECT a.emp AS i, b.emp AS j, coalesce(round(p.w, 12), 0) AS w FROM n a JOIN n b ON a.emp < b.emp LEFT JOIN p ON p.i = a.emp AND p.j = b.emp),
    c AS (SELECT quantile_cont(w, 0.95) AS cutoff FROM e),
    m AS (SELECT s.*, count(*) OVER (PARTITION BY day, div) AS k FROM @sized s JOIN n ON n.emp = s.emp
          WHERE day BETWEEN DATE '{SNAPSHOT}' - {span} AND DATE '{SNAPSHOT}'),
    s AS (SELECT emp, string_agg(day::VARCHAR || '/' || div::VARCHAR, '+' ORDER BY day, div) AS cls FROM m WHERE k > 1 GROUP BY emp),
    x AS (SELECT emp, min(emp) OVER (PARTITION BY cls) AS a FROM s),
    kept AS (SELECT e.*, cutoff FROM e, c WHERE w >= cutoff)
    SELECT {span} AS span, least(x.a, y.a) AS a, greatest(x.a, y.a) AS b, max(w) AS w, count(*) AS n_pairs, any_value(cutoff) AS cutoff,
           (SELECT count(*) FROM kept) AS kept_pairs
    FROM kept LEFT JOIN x ON x.emp = kept.i AND w > 0 LEFT JOIN x y ON y.emp = kept.j AND w > 0 GROUP BY ALL)"""


@query("threshold_edges_windows", "span l, a l, b l, w d, n_pairs l, cutoff d, kept_pairs l", f"""
    WITH one AS (SELECT 1)
MAIN SELECT * FROM ({' UNION ALL '.join(window_sql(s) for s in WINDOWS)})""")
def q_threshold_edges_windows(spark, sf):
    """The strongest twentieth of contacts over windows of days, among people in the panel on one day."""
    return C.snapshot_edges(spark, sf, SNAPSHOT, WINDOWS, 0.95)


NODE_DAYS = """
    nd AS (SELECT p.emp, p.day, (p.ot_hours > 0)::INT AS ot_work, (p.worked_hours > 0)::INT AS work, p.leave_hours, p.injured,
                  coalesce(s.strength, 0) AS strength
           FROM @panel p LEFT JOIN (SELECT day, i, sum(w) AS strength FROM @pairs GROUP BY ALL) s ON s.day = p.day AND s.i = p.emp)"""
SHARES = NODE_DAYS + """,
    lg AS (SELECT *, lag(strength) OVER (PARTITION BY emp ORDER BY day) AS lagged, sum(ot_work) OVER (PARTITION BY day) AS shift_total FROM nd),
    sh AS (SELECT *, shift_total * lagged AS bartik,
                  lagged / nullif(CASE WHEN count(lagged) OVER d = count(*) OVER d THEN sum(lagged) OVER d END, 0) * shift_total AS share_z
           FROM lg WINDOW d AS (PARTITION BY day))"""


@query("share_shift", "emp l, day s, shift_total l, lagged d, bartik d, bartik_scaled d, share_z d, share_mean d", f"""
    WITH {SHARES}
MAIN SELECT *, bartik / (SELECT stddev_samp(bartik) FROM sh) AS bartik_scaled, avg(share_z) OVER (PARTITION BY emp) AS share_mean FROM sh""")
def q_share_shift(spark, sf):
    return C.shares(spark, sf)


@query("share_shift_eligible", "emp l, day s, bartik d, share_z d, share_scaled d, share_mean d", f"""
    WITH {NODE_DAYS.replace("p.leave_hours,", "p.leave_hours, p.worked_hours,")},
    lg AS (SELECT *, lag(strength) OVER (PARTITION BY emp ORDER BY day) AS lagged, sum(ot_work) OVER (PARTITION BY day) AS shift_total,
                  coalesce((leave_hours = 0 OR worked_hours > 0) AND day BETWEEN DATE '2024-01-08' AND DATE '2024-01-24', false) AS ok FROM nd),
    sh AS (SELECT emp, day, shift_total * lagged AS bartik,
                  CASE WHEN ok THEN lagged / nullif(CASE WHEN count(lagged) FILTER (ok) OVER d = count(*) FILTER (ok) OVER d
                                                         THEN sum(lagged) FILTER (ok) OVER d END, 0) * shift_total END AS share_z
           FROM lg WINDOW d AS (PARTITION BY day))
MAIN SELECT *, share_z / (SELECT stddev_samp(share_z) FROM sh) AS share_scaled, avg(share_z) OVER (PARTITION BY emp) AS share_mean FROM sh""")
def q_share_shift_eligible(spark, sf):
    """Every row's exposure; its share among the rows at work or not on leave."""
    return C.eligible_shares(spark, sf)


@query("snapshot_outcome", "node l, strength d, ot_days l, work_share d", f"""
    WITH {NODE_DAYS}
MAIN SELECT s.i AS node, s.strength, o.ot_days, o.work_share FROM
      (SELECT n.emp AS i, coalesce(sum(p.w), 0) AS strength FROM (SELECT DISTINCT emp FROM @contacts WHERE day = DATE '2024-01-15') n
       LEFT JOIN @pairs p ON p.i = n.emp AND p.day = DATE '2024-01-15' GROUP BY 1) s
    LEFT JOIN (SELECT emp, sum(ot_work) AS ot_days, avg(work) AS work_share FROM nd
               WHERE day > DATE '2024-01-15' AND day <= DATE '2024-01-25' GROUP BY emp) o ON o.emp = s.i""")
def q_snapshot_outcome(spark, sf):
    """Contact strength on one day and overtime in the ten days after it."""
    nodes = N.node_strength(C.weights(spark, sf)).withColumnRenamed("node", "emp")
    s = N.snapshot_outcome(nodes, C.node_days(spark, sf).drop("strength"), "emp", "day", dt.date(2024, 1, 15), 10,
                           [F.sum("ot_work").alias("ot_days"), F.avg("work").alias("work_share")])
    return s.withColumnRenamed("emp", "node")
