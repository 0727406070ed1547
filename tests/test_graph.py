"""Contact network against dense matrices on a small day."""

import datetime as dt
import itertools

import numpy as np
import pytest

from panelspark.operators import graph as N

DAY = dt.date(2024, 1, 1)


def dense(members):
    """Pair weights of one day as a matrix over sorted nodes."""
    nodes = sorted({n for _, n in members})
    a = np.zeros((len(nodes), len(nodes)))
    for g in {g for g, _ in members}:
        inside = sorted({n for h, n in members if h == g})
        for i, j in itertools.permutations(inside, 2):
            a[nodes.index(i), nodes.index(j)] += 1 / (len(inside) - 1)
    return nodes, a


def weights(spark, members):
    d = spark.createDataFrame([(DAY, g, n) for g, n in members], "day date, grp string, node bigint")
    return N.contact_weights(d, "day", "grp", "node")


def test_path_and_pair(spark):
    """A path of three through two groups of two, and a separate pair."""
    w = weights(spark, [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 8), ("c", 9)])
    got = {r["node"]: r["centrality"] for r in N.eigen_centrality(w).collect()}
    assert [got[n] for n in (1, 2, 3, 8, 9)] == pytest.approx([0.70710678, 1, 0.70710678, 0, 0], abs=1e-7)


def test_alone_has_no_weight(spark):
    w = weights(spark, [("a", 1), ("b", 2), ("b", 3)])
    s = {r["node"]: r["strength"] for r in N.node_strength(w).collect()}
    assert s == {1: 0.0, 2: 1.0, 3: 1.0}


def test_random_day(spark):
    """All measures agree with the dense matrix, one group holding half the people."""
    rng = np.random.default_rng(4)
    members = set()
    for n in range(60):
        members.add(("big" if rng.random() < 0.5 else f"g{rng.integers(0, 5)}", n))
        if rng.random() < 0.4:
            members.add((f"g{rng.integers(0, 5)}", n))
    w = weights(spark, sorted(members))
    nodes, a = dense(members)
    s = {r["node"]: r["strength"] for r in N.node_strength(w).collect()}
    assert [s[n] for n in nodes] == pytest.approx(a.sum(1))
    e = N.contact_edges(w).collect()
    assert sum(r["n_pairs"] for r in e) == (a > 0).sum() / 2
    assert sum(r["n_pairs"] * r["w"] for r in e) == pytest.approx(a.sum() / 2)
    iu = np.triu_indices(len(nodes), 1)
    kept, cut = N.threshold_edges(N.contact_edges(w), w, 0.9)
    assert cut.first()["cutoff"] == pytest.approx(np.quantile(a[iu], 0.9))
    got = {r["node"]: r["centrality"] for r in N.eigen_centrality(w).collect()}
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert [got[n] for n in nodes] == pytest.approx(list(v / v.max()), abs=1e-8)


def test_days_of_all_sizes_together(spark):
    """One day of ten people and one of 3,000 classes, in the same search."""
    rng = np.random.default_rng(11)
    rows, days = [], {DAY: [], DAY + dt.timedelta(1): []}
    for n in range(10):
        days[DAY] += [(f"g{g}", n) for g in set(rng.integers(0, 4, 2).tolist())]
    for n in range(3000):  # nearly all sets of groups differ
        days[DAY + dt.timedelta(1)] += [(f"g{g}", n) for g in set((rng.integers(0, 400, 4) ** 2 // 400).tolist())]
    for day, members in days.items():
        rows += [(day, g, n) for g, n in members]
    d = spark.createDataFrame(rows, "day date, grp string, node bigint")
    got = {(r["day"], r["node"]): r["centrality"] for r in N.eigen_centrality(N.contact_weights(d, "day", "grp", "node")).collect()}
    for day, members in days.items():
        nodes, groups = sorted({n for _, n in members}), sorted({g for g, _ in members})
        inside = np.zeros((len(nodes), len(groups)))
        for g, n in members:
            inside[nodes.index(n), groups.index(g)] = 1
        size = inside.sum(axis=0)
        a = (inside * np.where(size > 1, 1 / np.maximum(size - 1, 1), 0)) @ inside.T
        np.fill_diagonal(a, 0)
        # largest component by a plain search
        seen, best = set(), []
        for i in range(len(nodes)):
            if i not in seen:
                part, todo = {i}, [i]
                while todo:
                    for j in np.flatnonzero(a[todo.pop()]).tolist():
                        if j not in part:
                            part.add(j)
                            todo.append(j)
                seen |= part
                best = max(best, sorted(part), key=len)
        v = np.abs(np.linalg.eigh(a[np.ix_(best, best)])[1][:, -1])
        want = np.zeros(len(nodes))
        want[best] = v / v.max()
        assert np.abs(np.array([got[(day, n)] for n in nodes]) - want).max() < 1e-8


def test_rolling_strength_over_windows(spark):
    """Against the definition, with people who come late, leave early, come back to nobody, and a group with half the people."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    day = lambda k: DAY + dt.timedelta(int(k))
    rows = set()
    for n in range(25):
        for t in range(40):
            if rng.random() < 0.3:
                rows.add((day(t), "big" if rng.random() < 0.5 else f"g{rng.integers(0, 4)}", n))
                if rng.random() < 0.2:
                    rows.add((day(t), f"g{rng.integers(0, 4)}", n))
    present = {n: sorted(rng.integers(-3, 45, 2).tolist()) for n in range(24)}  # one person is never present
    w = N.contact_weights(spark.createDataFrame(sorted(rows), "day date, grp string, node bigint"), "day", "grp", "node")
    p = spark.createDataFrame([(n, day(a), day(b)) for n, (a, b) in present.items()], "node bigint, start date, end date")
    got = N.rolling_strength(w, p, [0, 3, 30, 1000])
    have = {(r["day"], r["node"]): [r[f"strength_{s}"] for s in (0, 3, 30, 1000)] for r in got.collect()}
    link = {}
    for r in w.collect():
        link.setdefault((r["day"], r["grp"]), []).append((r["node"], r["w"]))
    want = {}
    for n, (a, b) in present.items():
        for t in range(a, b + 1):
            sums = [0.0] * 4
            for (d, _), group in link.items():
                mine = [x for m, x in group if m == n]
                ago = (day(t) - d).days
                if mine and ago >= 0:
                    others = sum(x for m, x in group if m != n and m in present and present[m][0] <= t <= present[m][1])
                    for k, s in enumerate((0, 3, 30, 1000)):
                        sums[k] += others if ago <= s else 0.0
            want[(day(t), n)] = sums
    assert have.keys() == want.keys()
    assert all(have[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert got.agg(F.min("strength_3")).first()[0] >= 0
