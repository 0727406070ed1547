"""Each stage against a plain version on its own input, and odd rows through all of them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import cgk_decontam, decision_list
from panelspark.llm.common import read
from panelspark.operators.keys import cut_lineage
from tests.llm.test_bayes_jaccard import brute


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = read(spark, sf, "documents"), []
    for _, f in corpus_pipeline.STAGES:
        new = cut_lineage(f(spark, docs, sf))
        out.append((docs, new))
        docs = new
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages, spark, sf):
    want = read(spark, sf, "documents").columns
    assert all(new.columns == want for _, new in stages[:-1])


def test_quality(stages, spark, sf):
    before, after = map(rows, stages[0])
    rules = decision_list.learn(decision_list.labelled(stages[0][0], read(spark, sf, "labels")))
    s = {r.doc_id: r for r in decision_list.with_stats(stages[0][0]).collect()}
    for d, r in s.items():
        w = r["_s"].w
        bad = w.n_words < 50 or 100 * w.n_repeat_words > 50 * w.n_words or any(all(c.holds(r["_f"].asDict()) for c in rule) for rule in rules)
        assert (d in after) == (not bad)
    good = {r.doc_id for r in read(spark, sf, "labels").where("quality = 1").collect()}
    assert len(good - set(after)) <= 0.1 * len(good)  # short ones go by the base rule
    assert all(after[d] == before[d] for d in after)


def test_near_duplicates(stages):
    before, after = map(rows, stages[1])
    ids = sorted(before)
    root, _ = brute([before[i].text for i in ids])
    assert sorted(after) == sorted({ids[r] for r in root})


def test_decontamination(stages, spark, sf):
    before, after = map(rows, stages[2])
    items = read(spark, sf, "benchmark").collect()
    hit = {d for d, r in before.items() if any(b.text in r.text for b in items)}
    assert hit.isdisjoint(after)
    found = {r.doc_id for r in cgk_decontam.contaminated(stages[2][0], read(spark, sf, "benchmark")).collect()}
    assert set(before) - set(after) == found


def test_personal_data(stages):
    from tests.llm.test_crf_pii import plain
    before, after = map(rows, stages[3])
    assert set(before) == set(after)
    for d, r in after.items():
        assert not plain(r.text) and r.n_chars == len(r.text)
        if not any(c in "0123456789@" for c in before[d].text):
            assert r.text == before[d].text


def test_tokens(stages):
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before, after = map(rows, stages[4])
    assert set(before) == set(after)
    for d, r in after.items():
        assert r.n_tokens == len(sp.encode(before[d].text)) and r.round_trip


def test_odd_rows(spark, sf, tmp_path):
    r = random.Random(1)
    long = " ".join(f"{r.choice('abcdefghij')}{r.randrange(10**5)}" for _ in range(120))
    texts = [None, "", " \n", "x", long, long, long + " tail", "y" * 100_000, " ".join(f"w{i}" for i in range(60_000)), "é " * 60, None]
    df = (spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(4, long)], "doc_id long, text string")
          .withColumn("n_chars", F.length("text")).withColumn("_s", F.lit("clash")).withColumn("_id", F.lit(1)).withColumn("class_id", F.lit(None).cast("string")).withColumn("d", F.lit(2)))
    for docs in (df, df.limit(0)):
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            new = cut_lineage(f(spark, docs, sf))
            assert k == 4 or new.columns == df.columns
            # every stage also gets the odd rows first hand
            first = f(spark, df, sf).count() if docs is df else 0
            assert first >= 0
            docs = new
        if docs.count():
            ids = sorted(x.doc_id for x in docs.collect())
            assert ids == [4, 8]
