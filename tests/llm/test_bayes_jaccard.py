import random

import numpy as np

from panelspark.llm import bayes_jaccard as J
from panelspark.operators.components import components


def brute(texts):
    """class and links by definition: five-word shingles, 0.8; short texts are one shingle."""
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(texts)
    root, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = root[i], root[j]
                low = min(x, y)
                root = [low if r in (x, y) else r for r in root]
    return root, links


def corpus(seed, groups=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([6, 20, 60, 300]))]
        for _ in range(r.randrange(1, 9)):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(t) // 12)):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t))
    out += [None, "", " ", "a b", "a b", "a b c d e", "a b c d e", "z " * 3000, "z " * 3000, "z " * 4]
    r.shuffle(out)
    return out


def check(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_classes(df).collect()}
    root, links = brute(texts)
    assert got == {i: (root[i], links[i]) for i in range(len(texts))}
    return df


def test_as_brute_force(spark):
    df = check(spark, corpus(1))
    kept = J.one_per_class(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute([r.text for r in df.orderBy("doc_id").collect()])[0]))


def test_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    r = random.Random(3)
    base, texts = [f"w{i}" for i in range(150)], []
    for _ in range(90):  # a chain of edits: near ones link, far ones don't
        base = list(base)
        base[r.randrange(150)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(base))
    check(spark, texts)


def test_missing_and_shared_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "q r s t u v"), (9, "q r s t u v"), (5, None)],
                               "doc_id long, text string")
    got = J.jaccard_classes(df).collect()
    assert len(got) == 6 and sorted(str(r.doc_id) for r in J.one_per_class(df).collect()) == ["4", "5", "None"]
    assert J.jaccard_classes(df.limit(0)).count() == 0 and J.one_per_class(df.limit(0)).count() == 0


def test_no_row_is_lost_by_its_id(spark):
    """Rows without an id, or with that of another, are kept by their texts."""
    x, q = "a b c d e f", "q r s t u v"
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda rows: sorted(map(str, map(tuple, J.one_per_class(table(rows)).collect())))
    assert kept([(4, x), (4, q), (9, q), (None, x)]) == sorted([str((None, x)), str((4, q))])
    clean = [(None, f"{i} b c d e f") for i in range(9)] + [(7, f"{i} q r s t") for i in range(9)]
    assert kept(clean + [clean[0], clean[-1]]) == sorted(str(r) for r in clean)
    empty = [(None, None), (None, ""), (3, " "), (3, None)]
    assert kept(empty) == sorted(str(r) for r in empty)


def test_unlike_classes_with_the_same_ids(spark):
    """Two pairs of near copies whose ids are the same stay two classes, and both have their link."""
    r = random.Random(5)
    a, b = ([f"{c}{r.randrange(10**6)}" for _ in range(200)] for c in "ab")
    rows = [(i, " ".join(w[:-1] + [f"end{i}"])) for w in (a, b) for i in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_classes(df).select("doc_id", "class_id", "n_links").collect())) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 1, 1)]
    assert sorted(map(tuple, J.one_per_class(df).collect())) == sorted([rows[0], rows[2]])


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "a b c d e f"), ("a", "a b c d e f"), (None, "q r s t u v"), ("z", "q r s t u v"), ("y", "")], "doc_id string, text string")
    got = J.jaccard_classes(df).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == [
        ("None", "None", 1), ("a", "a", 1), ("b", "a", 1), ("y", "y", 0), ("z", "None", 1)]
    low = spark.createDataFrame([(-2**63, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")
    assert {r.class_id for r in J.jaccard_classes(low).collect()} == {-2**63}


def test_strays_meet_the_whole_bucket(spark, monkeypatch):
    """Without pivots, blocks are only united by the second round."""
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "PIVOTS", 0)
    r = random.Random(8)
    base, texts = [f"w{i}" for i in range(120)], []
    for _ in range(40):
        base = list(base)
        base[r.randrange(120)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(base))
    check(spark, texts)


def rows_made(spark, run):
    """Rows of the largest table that `run` writes."""
    most = 0
    cut = J.cut_lineage

    def spy(df):
        nonlocal most
        out = cut(df)
        most = max(most, out.count())
        return out

    J.cut_lineage = spy
    try:
        run()
    finally:
        J.cut_lineage = cut
    return most


def test_rows_follow_the_members_of_a_group(spark, monkeypatch):
    """Groups of near copies: rows of every stage stay within a few times the members, and there is one class."""
    monkeypatch.setattr(J, "BLOCK", 64)
    r = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    for m in (250, 2500):
        texts = []
        for k in range(m):
            t = list(base)
            t[r.randrange(80)] = f"x{k}"
            texts.append(" ".join(t))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = J.Found(df, "doc_id", "text")
        members = found.members.count()
        kept = []
        most = rows_made(spark, lambda: kept.extend(J.Found.roots(found).collect()))
        assert len({k.root for k in kept}) == 1 and len(kept) == m
        assert most <= 2 * members + 16 * 24 * m / 64, (m, members, most)


def test_memberships_are_joined_by_class_once_a_round(spark, monkeypatch):
    """With the sets, after the hashes were compared; hashes come with the memberships."""
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "PIVOTS", 0)
    r = random.Random(8)
    base, texts = [f"w{i}" for i in range(120)], []
    for _ in range(40):
        base = list(base)
        base[r.randrange(120)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(base))
    found = J.Found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    plans, cut = [], J.cut_lineage

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(J, "cut_lineage", spy)
    found.roots()
    joins = lambda plan: sum("Join Inner, (rep#" in x for x in plan.splitlines())
    compared = [p for p in plans if "MapInArrow run" in p]
    assert len(compared) == 4  # hashes and sets of both rounds
    assert [joins(p) for p in compared] == [0, 2, 0, 2]  # one of the two finds the few classes whose sets are made


def shuffles(df):
    """Shuffles by the key of a row, which rows with their texts would take."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange" in x and "_k1" in x]


def test_texts_are_not_shuffled_for_their_sets(spark, monkeypatch):
    """Nor is a band whose bucket has one member; a small map lets more pass and loses none."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = corpus(6)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = sorted(set(brute(texts)[0]))
        for bits in (J.MAP_BITS, 1 << 10):
            monkeypatch.setattr(J, "MAP_BITS", bits)
            found = J.Found(df, "doc_id", "text")
            sets = found.sets(found.members)
            assert not shuffles(sets)
            assert {r.rep for r in sets.collect()} == {r.rep for r in found.members.select("rep").distinct().collect()}
            assert sorted(r.doc_id for r in J.one_per_class(df).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bayes_bound():
    rng = np.random.default_rng(1)
    for i, j, need in J.NEED:
        assert (rng.binomial(j, 0.8, 200_000) < need).mean() < 2e-5  # pairs at the threshold stay
    assert (rng.binomial(32, 0.2, 10_000) < J.NEED[1][2]).mean() > 0.9  # unlike pairs go early


def test_overlaps():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 3000, r.integers(1, 900)).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    want = [len(set(sets[i]) & set(sets[j])) for i, j in zip(a, b)]
    assert J.overlaps(sets, a, b).tolist() == want
    assert J.overlaps(sets, a, b, width=64, most=100).tolist() == want


def test_components_long_chain(spark):
    n = 500
    r = random.Random(2)
    names = list(range(n + 50))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(n - 1)] + [(names[n + i], names[n]) for i in range(1, 50)] + [(names[0], names[0])]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: min(names[:n]) for x in names[:n]} | {x: min(names[n:]) for x in names[n:]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
