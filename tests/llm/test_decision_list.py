"""Counts against plain Python, edge rows, and what the learned list does."""

import re

import pytest
from pyspark.sql import functions as F

from panelspark.llm import decision_list as D
from panelspark.llm import queries as Q
from panelspark.llm.common import read


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    threes = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = {x for x in threes if threes.count(x) > 1} if len(threes) < 3000 else {
        x for x, n in __import__("collections").Counter(threes).items() if n > 1}
    hit = {j for i, x in enumerate(threes) if x in often for j in range(i, i + 3)}
    lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


TEXTS = [None, "", " \t\r\n", "a", "a a a", "a a a a", "a b a b a b", "x y z x y z q", "é ñ 😀 é ñ 😀\n#|<\n#|<",
         "l\nl\n\n \n \nl ", "a\x0bb\x0cc\xa0d e\x85f", "b " * 5000, "one two three four\n" * 3]


def rows(spark, df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_edge_counts(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, _s string, _kept int")
        out = D.quality_rules(df, [[D.Condition("words", True, 3.0)]]).select("doc.*", F.col("_s").alias("s"), F.col("_base").alias("b")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    for r in out:
        s = r[4]
        assert (s.w.n_words, s.word_chars, s.n_symbols, s.lines.dup, s.w.n_repeat_words) == plain(r["text"]), r["text"]
        n, rep = s.w.n_words, s.w.n_repeat_words
        assert r["b"] == (n < 50 or 100 * rep > 50 * n)


def test_query_counts(spark, sf):
    docs = rows(spark, read(spark, sf, "documents"))
    got = Q.op5_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(docs[r.doc_id].text)
        assert r.kept == (not r.base_failed and r.rule is None)


def test_learned_list_is_precise(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(spark, Q.op5_quality_rules(spark, sf))
    lab = [r for r in read(spark, sf, "labels").collect() if r.quality is not None]
    good = [r for r in lab if r.quality == 1]
    bad = [r for r in lab if r.quality == 0]
    lost = sum(got[r.doc_id].rule is not None for r in good)
    caught = sum(not got[r.doc_id].kept for r in bad)
    assert lost <= 0.02 * len(good) and caught >= 0.7 * len(bad)


def test_no_labels_and_empty_table(spark, sf):
    docs = read(spark, sf, "documents")
    lab = read(spark, sf, "labels")
    assert D.learn(D.labelled(docs, lab.limit(0))) == []
    assert D.learn(D.labelled(docs, lab.where("quality = 1"))) == []
    assert D.quality_rules(docs.limit(0), []).count() == 0


def test_covering_finds_a_conjunction():
    import random
    r = random.Random(1)
    data = []
    for _ in range(900):
        f = {k: r.random() for k in D.FEATURES}
        data.append((f, f["words"] > 0.6 and f["symbol_share"] <= 0.4))
    rules = D.learn(data)
    assert rules and {c.feature for c in rules[0]} == {"words", "symbol_share"}
    wrong = sum(any(all(c.holds(f) for c in rule) for rule in rules) != bad for f, bad in data)
    assert wrong <= 45
