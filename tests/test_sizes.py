"""Steps whose cost must not grow with what the size statistics hide."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators.allocate import alloc_auction, alloc_full_info, alloc_list
from panelspark.operators.keys import cut_lineage
from panelspark.operators.merge import merge_report
from panelspark.operators.reshape import panel_skeleton


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_report_broadcasts_no_side(spark, tmp_path):
    # a few compressed bytes of people become many days
    people = spark.range(2000).select(F.col("id").alias("emp"), F.lit(dt.date(2024, 1, 1)).alias("hire"), F.lit(None).cast("date").alias("term"))
    people.write.parquet(str(tmp_path / "p"))
    days = panel_skeleton(spark.read.parquet(str(tmp_path / "p")), "emp", "hire", "term", dt.date(2024, 1, 1), dt.date(2024, 1, 30))
    right = spark.createDataFrame([(1, dt.date(2024, 1, 2), 8.0), (None, dt.date(2024, 1, 2), 4.0), (9000, dt.date(2024, 1, 5), 1.0)], "emp long, day date, hours double")
    merged, counts = merge_report(days, right, ["emp", "day"])
    assert "Broadcast" not in plan(counts)
    assert {r["_merge"]: r["n"] for r in counts.collect()} == {1: 59999, 2: 2, 3: 1}


def test_allocation_rules_do_not_move_the_rows(spark):
    # a cell of 400 rows, one of fewer rows than shifts, one without shifts
    cells = [(1, 1, 400, 90, 30), (1, 2, 3, 5, 4), (2, 1, 20, 0, 0)]
    rows = [(d, g, c, 10 * c + e, s, s - r, r) for d in (1, 2) for c, (g, _, n, s, r) in enumerate(cells) for e in range(1000 * c, 1000 * c + n)]
    d = spark.createDataFrame(rows, "draw int, grp int, day int, emp long, shifts long, additional long, regular long")
    u = lambda k: (F.hash(F.lit(k), "draw", "emp") % 997 + 997) / 2000.0
    d = cut_lineage(d.withColumns({"willing": (F.col("emp") % 3 > 0).cast("int"), "value": u(1) * 8 - 4, "risk": u(2) * 2 - 1,
                                   "u_list": u(3), "u_split": u(4), "u_best": u(5)}))
    pdf = d.toPandas()
    for fn, u_reg, key in ((alloc_list, None, None), (alloc_auction, "u_split", lambda r: -r.value), (alloc_full_info, "u_best", lambda r: r.risk)):
        out = fn(d, "work")
        assert "Window" not in plan(out) and "Exchange hashpartitioning" not in plan(out) and "Exchange rangepartitioning" not in plan(out)
        want = set()
        for _, cell in pdf.groupby(["draw", "grp", "day"]):
            rs = list(cell.itertuples())
            if u_reg is None:
                won = sorted(rs, key=lambda r: (r.u_list + 1 - r.willing, r.emp))[:rs[0].shifts]
            else:
                reg = sorted((r for r in rs if r.willing), key=lambda r: (getattr(r, u_reg), r.emp))[:rs[0].regular]
                rest = sorted((r for r in rs if r not in reg), key=lambda r: (key(r), r.emp))
                won = reg + rest[:rs[0].shifts - len(reg)]
            want |= {(r.draw, r.emp) for r in won}
        got = out.collect()
        assert len(got) == len(pdf) and {(r["draw"], r["emp"]) for r in got if r["work"] == 1} == want


def test_shares_do_not_wait_for_centrality(spark, sf, monkeypatch):
    from panelspark.plans import inputs as I, network as C

    def no(*_):
        raise AssertionError("centrality is not part of the shares")
    monkeypatch.setattr(C, "centrality", no)
    monkeypatch.setattr(I, "_stages", {})
    assert C.shares(spark, sf).count() > 0


def test_many_levels_are_not_broadcast(spark, monkeypatch):
    from panelspark.operators import linear as L
    d = cut_lineage(spark.range(600).select((F.col("id") % 100).alias("person"), (F.col("id") % 7).alias("day"), (F.col("id") * F.col("id") % 31).cast("double").alias("v")))
    plain, rank = L.absorb(d, ["v"], ["day", "person"])
    monkeypatch.setattr(L, "MANY", 50)
    merged, same = L.absorb(d, ["v"], ["day", "person"])
    assert plan(plain).count("SortMergeJoin") == 0 and plan(merged).count("SortMergeJoin") == 1
    key = lambda df: sorted((r["person"], r["day"], round(r["v"], 9)) for r in df.collect())
    assert rank == same and key(plain) == key(merged)


def test_window_strength_adds_steps_by_group_before_people_take_them(spark):
    """A person's steps are made in the task that adds them up: no shuffle or partial table holds every step of a group's members."""
    from panelspark.operators.graph import contact_weights, rolling_strength
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 10).cast("int"))
    d = spark.range(4000).select(day.alias("day"), (F.col("id") % 3).cast("string").alias("grp"), F.floor(F.col("id") / 10).alias("node"))
    # the last to leave has no contact
    present = cut_lineage(spark.range(402).select(F.col("id").alias("node"), F.lit(dt.date(2024, 1, 1)).alias("start"),
                                                  F.date_add(F.lit(dt.date(2024, 1, 10)), F.when(F.col("id") == 401, 5).otherwise((F.col("id") % 3).cast("int"))).alias("end")))
    out = rolling_strength(contact_weights(d, "day", "grp", "node"), present, [3, 1000])
    text = plan(out)
    assert text.count("Exchange hashpartitioning") == 1 and text.index("Exchange hashpartitioning") > text.index("Generate inline")
    got = {(r["day"], r["node"]): (r["strength_3"], r["strength_1000"]) for r in out.collect()}
    assert len(got) == sum(10 + (5 if n == 401 else n % 3) for n in range(402))
    assert got[dt.date(2024, 1, 15), 401] == (0, 0) and got[dt.date(2024, 1, 10), 0] == (4, 10)
    assert all(v == (0, 0) for v in (rolling_strength(contact_weights(d.limit(0), "day", "grp", "node"), present, [3, 1000]).agg(F.max("strength_3"), F.max("strength_1000")).first(),))
