import random

import numpy as np
import pytest

from panelspark.llm import cgk_decontam as C
from panelspark.llm.common import read
from panelspark.llm.queries import QUERIES


def words(t):
    import re
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x08\x0e-\x1f]+", (t or "").lower())


def distance(item, text):
    """(edits, start) of the best window, by the plain recurrence at every start."""
    best = None
    for s in range(len(text)):
        row = list(range(len(text[s:s + 2 * len(item)]) + 1))
        for i, w in enumerate(item):
            new = [i + 1]
            for j, x in enumerate(text[s:s + 2 * len(item)]):
                new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
            row = new
        got = (min(row), s)
        best = got if best is None or got < best else best
    return best


def edited(r, w, k):
    w = list(w)
    for _ in range(k):
        i = r.randrange(len(w))
        how = r.randrange(3)
        if how == 0:
            w[i] = f"new{r.randrange(999)}"
        elif how == 1:
            w.insert(i, f"new{r.randrange(999)}")
        elif len(w) > 1:
            del w[i]
    return w


def test_as_brute_force_with_target_recall(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items = [[r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 6, 9, 15, 24, 37, 59]))] for _ in range(30)]
    docs, n = [], 0
    for d in range(160):
        t = [r.choice(vocabulary) for _ in range(r.randrange(0, 150))]
        if d % 2:
            item = r.choice(items)
            at = r.randrange(len(t) + 1)
            t[at:at] = edited(r, item, r.randrange(0, len(item) // C.PART + 1))
        docs.append(" ".join(t))
    docs[0] = docs[2] = None
    docs[4] = ""
    docs[6] = docs[8] = " ".join(items[0]).upper() + "!"
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(100 + i, " ".join(w), "x") for i, w in enumerate(items)] + [(7, None, ""), (8, " ", ""), (9, "...", "")], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id): (x.n_edits, x.start_word) for x in C.contaminated(df, bench).collect()}
    want = {}
    for i, t in enumerate(docs):
        for k, item in enumerate(items):
            best = distance(item, words(t))
            if best and best[0] <= len(item) // C.PART:
                want[i, 100 + k] = best
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)
    exact = {k for k, v in want.items() if v[0] == 0}
    assert all(got.get(k) == want[k] for k in exact)
    assert sum(got[k][0] == want[k][0] for k in got) >= 0.97 * len(got)
    kept = C.clean_documents(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(range(len(docs))) - {i for i, _ in got}
    assert C.contaminated(df.limit(0), bench).count() == 0 and C.contaminated(df, bench.limit(0)).count() == 0
    assert C.clean_documents(df, bench.limit(0)).count() == len(docs)


def test_item_blocks(spark, sf, monkeypatch):
    d, b = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    whole = sorted(map(tuple, QUERIES["op8_cgk_decontam"](spark, sf).collect()))
    monkeypatch.setattr(C, "ITEM_BLOCK", 9)
    assert sorted(map(tuple, C.contaminated(d, b).collect())) == whole


def test_exact_items_of_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = read(spark, sf, "documents").collect(), read(spark, sf, "benchmark").collect()
    hold = {(d.doc_id, b.item_id) for d in docs for b in bench if b.text in d.text}
    got = {(x.doc_id, x.item_id) for x in QUERIES["op8_cgk_decontam"](spark, sf).collect()}
    assert hold and hold <= got


def test_edit_distances():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 9))] for _ in range(2))
        got = C.edit_distances(np.array(a, np.uint64), np.array([b], np.uint64))[0]
        row = list(range(len(b) + 1))
        for i, w in enumerate(a):
            new = [i + 1]
            for j, x in enumerate(b):
                new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
            row = new
        assert got == min(row)


def of_one_kind(r, w, k, how):
    """Exactly k insertions, deletions or substitutions by new words, at random places."""
    if how == "insert":
        w = list(w)
        for _ in range(k):
            w.insert(r.randrange(len(w) + 1), f"new{r.randrange(10**9)}")
        return w
    at = set(r.sample(range(len(w)), k))
    return [x if i not in at else f"new{r.randrange(10**9)}" for i, x in enumerate(w) if how != "delete" or i not in at]


@pytest.mark.parametrize("n", [25, 60, 100, 200, 500])
@pytest.mark.parametrize("how", ["delete", "insert", "substitute"])
def test_recall_on_long_items(n, how):
    """Items with all the edits that the definition allows, of one kind, inside other text."""
    r = random.Random(n)
    new = lambda k: [f"v{r.randrange(10**9)}" for _ in range(k)]
    bench = [new(n) for _ in range(100)]
    items = C.load_items([(i, " ".join(w)) for i, w in enumerate(bench)])
    texts = [" ".join(new(r.randrange(90)) + of_one_kind(r, w, n // C.PART, how) + new(r.randrange(90))) for w in bench]
    got = C.matches(texts, items)
    assert all(t == k and d <= n // C.PART for t, k, _, d in got)
    assert len(got) >= 98


def test_recall_of_each_length_looked_up():
    """The chance that walks of a piece meet, with its full share of edits, per length and kind."""
    r = np.random.default_rng(11)
    new = lambda k: r.integers(1, 2**63, k, dtype=np.uint64)
    for n in range(C.PART, C.PIECE + 1):
        c = int(C.CLASSES[np.searchsorted(C.CLASSES, n, side="right") - 1])
        k = n // C.PART
        for how in ("delete", "insert", "substitute"):
            seq, start, end = [], [], []
            for _ in range(400):
                w = new(n)
                at = np.sort(r.permutation(n)[:k])
                t = np.delete(w, at) if how == "delete" else np.insert(w, at, new(k)) if how == "insert" else w.copy()
                if how == "substitute":
                    t[at] = new(k)
                for x, size in ((w, n), (np.concatenate([t, new(2 * n)]), len(t) + 2 * n)):
                    start.append(sum(map(len, seq[-1:])) + (start[-1] if start else 0))
                    end.append(start[-1] + size)
                    seq.append(np.append(x, np.uint64(0)))
            keys = C.walk_keys(np.concatenate(seq), np.array(start), np.array(end), [c])[c]
            assert (keys[:, 0::2] == keys[:, 1::2]).any(axis=0).mean() >= 0.97, (n, how)


def test_best_window_of_a_long_item():
    r = random.Random(2)
    item = [f"v{r.randrange(10**9)}" for _ in range(120)]
    items = C.load_items([(0, " ".join(item))])
    for head in (0, 3, 40):
        text = [f"t{r.randrange(10**9)}" for _ in range(head)] + item[:1] + of_one_kind(r, item[1:], 20, "delete") + ["tail"] * 5
        assert C.matches([" ".join(text), None, " ".join(item[30:])], items) == [(0, 0, head, 20)]
    assert C.matches([" ".join(item[24:])], items) == [(0, 0, 0, 24)] and C.matches([" ".join(item[25:])], items) == []
