import random

import numpy as np
import pytest

from panelspark.llm import substring_dedup as S
from panelspark.llm.queries import QUERIES
from panelspark.llm.common import read


def same(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, vals string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.substring_dedup(df, **kw).collect()}
    want = S.pandas_reference(texts, kw.get("window", S.WINDOW))
    assert len(got) == len(texts)
    for i, row in enumerate(want.itertuples(index=False)):
        assert got[i] == tuple(row), (i, texts[i] and texts[i][:60])


def test_edges(spark):
    r = random.Random(5)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randrange(300))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "  \n", "short text", passage, "x y " + passage + " z", passage.replace(" ", "\n\t"), " ".join(passage.split()[:34]),
             " ".join(passage.split()[5:40]), "same " * 36, "same " * 35, "same " * 500, "ab cd " * 300, "é\xa0ü " + passage, passage, passage,
             " ".join(word() for _ in range(30_000)), " ".join(word() for _ in range(400))]
    texts += [" ".join([*(word() for _ in range(20)), *passage.split()[10:55], *(word() for _ in range(20))]) for _ in range(8)]
    same(spark, texts)


@pytest.mark.parametrize("window,gram", [(6, 3), (9, 9), (5, 1)])
def test_other_sizes(spark, window, gram):
    r = random.Random(window)
    same(spark, [" ".join(r.choice("a b c d e f".split()) for _ in range(r.randrange(90))) for _ in range(60)], window=window, gram=gram)


def test_given_table(spark, sf):
    docs = read(spark, sf, "documents").collect()
    want = S.pandas_reference([d.text for d in docs])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op3_count_min_dedup"](spark, sf).collect()}
    assert got == {d.doc_id: tuple(w) for d, w in zip(docs, want.itertuples(index=False))}
    assert sum(w[1] for w in got.values()) > 0


def test_equal_rows_and_missing_ids(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, t), (1, t), (None, t + " tail"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in S.substring_dedup(df).collect())
    assert got == [(0, 0), (50, 50), (50, 50), (51, 50)]
    assert S.substring_dedup(df.limit(0)).count() == 0


def test_sketch_never_undercounts():
    r = np.random.default_rng(2)
    v = r.integers(0, 2**32, 20000).astype(np.uint32)
    v = np.concatenate([v, v[:500]])
    parts = [S.sketch(p) for p in np.array_split(v, 7)]
    total = np.minimum(sum(p.astype(int) for p in parts), 2)
    bits = np.packbits(total >= 2).tobytes()
    assert S.repeated(v[:500], bits).all() and S.repeated(v, bits).mean() < 0.5


def test_stand_ins_of_very_long_texts(monkeypatch):
    """Grams are searched in runs, so the index of a gram never spills into its hash; runs change nothing."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 400, n)) for n in (2000, 0, 30, 900)]
    words = S.Words(texts)
    want = S.stand_ins(words, 35, 16)
    for run in (1, 7, 64, 1000):
        monkeypatch.setattr(S, "RUN", run)
        for a, b in zip(S.stand_ins(words, 35, 16), want):
            assert (a == b).all()
    grams = want[2]
    at, pick = want[0], want[1]
    high = grams >> np.uint64(24)
    assert all(pick[i] == a + int(np.argmin(high[a:a + 20])) for i, a in enumerate(at.tolist()))
