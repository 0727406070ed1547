"""Collocations against SQL on the test tables and against a plain count on odd rows and small settings."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import parse_phrases as pp
from panelspark.llm.queries import QUERIES, SQL
from tools.compare import duck

ODD = [None, "", "  \t", ".,;!", "One", "THE the The", "É é É é", "a b.c d\na b,c d", "x" * 5000, "w " * 3000, "\x0b\x0c a  b\tc"]


def plain(rows, longest, least, top):
    """By the definition, with a dictionary per language."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        rows = []
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def result(df, **how):
    return sorted(tuple(r) for r in pp.collocations(df, **how).collect())


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["the", "a", "New", "York", "city", "of", "light", "É", "x1", "naïve"]
    line = " ".join(rng.choices(words, k=60))
    out = []
    for _ in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ". ", "\n", "\t"]) for _ in range(rng.randrange(40)))
        out.append((rng.choice(["en", "de", None, "und"]), text + (line if rng.random() < 0.3 else "")))
    return out


@pytest.mark.parametrize("longest,least,every,top", [(3, 10, 32, 2000), (3, 2, 2, 7), (2, 5, 1, 50), (4, 3, 3, 2000), (3, 1, 4, 5000)])
def test_plain_count(spark, longest, least, every, top):
    rows = corpus(longest) + [("en", t) for t in ODD] * 3
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert result(df, longest=longest, least=least, every=every, top=top) == plain(rows, longest, least, top)


def test_every_occurrence_is_owned_once():
    """Chunks overlap, but the words that they own follow one another without a gap."""
    rng = np.random.default_rng(0)
    for every in (1, 2, 5, 32):
        text = " ".join(rng.choice(["a", "bb", "c", "dd."], 200)).encode()
        for overlap in (1, 2, 3):
            got, doc, own = pp.chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]), overlap, every)
            got = got.to_pylist()
            assert own.sum() == 200 and (own > 0).all() and set(doc) == {0}
            words = [re.split("[ \n]", c.lstrip("\n")) for c in got]
            assert sum((w[-n:] for w, n in zip(words, own.tolist())), []) == text.decode().replace(".", "").split()
            assert [c.startswith("\n") for c in got] == [True] + [False] * (len(got) - 1)


def test_copies_share_chunks(spark):
    """A copied passage costs its chunks once, and counts as often as it stands."""
    passage = " ".join(f"w{k}" for k in range(3000))
    df = spark.createDataFrame([("en", f"head{k} {passage} tail{k}") for k in range(50)], "lang string, text string")
    table = pp.dictionary(df).collect()
    assert sum(r.own * r.times for r in table) == 50 * 3002
    assert sum(r.times == 50 for r in table) > 50 and len(table) < 400


def test_maps_only_let_more_through(spark, monkeypatch):
    """With maps of a few bits nearly all is let through, with the same result."""
    rows = corpus(9)
    df = spark.createDataFrame(rows, "lang string, text string")
    want = result(df)
    monkeypatch.setattr(pp, "MAP_BITS", (pp.BLOCK_BITS + 3, pp.BLOCK_BITS + 3))
    assert result(df) == want == plain(rows, 3, 10, 2000)


def test_large_counts_are_exact(spark):
    """Scores of counts whose products pass 64 bits."""
    from pyspark.sql import functions as F
    a, left, right = 9_000_000_000, 9_500_000_001, 9_999_999_999
    df = spark.range(1).select(F.lit(a).cast("decimal(19,0)").alias("x"), F.lit(left).cast("decimal(19,0)").alias("l"), F.lit(right).cast("decimal(19,0)").alias("r"))
    got = df.select(F.expr("(CAST(x * x AS decimal(31,0)) * CAST(1000000 AS decimal(7,0))) div (l * r)")).first()[0]
    assert got == 1000000 * a * a // (left * right)


def test_empty_table_and_clashing_names(spark):
    assert result(spark.createDataFrame([], "lang string, text string")) == []
    rows = [("en", "a b c " * 20, 1, "x")] * 2
    df = spark.createDataFrame(rows, "lang string, text string, times int, chunk string")
    assert result(df) == plain([r[:2] for r in rows], 3, 10, 2000)


def test_given_tables_against_sql(spark, sf):
    con = duck(sf)
    want = sorted(map(tuple, con.execute(SQL["op11_parse_phrases"]).fetchall()))
    got = QUERIES["op11_parse_phrases"](spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_hash_columns():
    """Words of all lengths keep apart; equal words meet."""
    from panelspark.llm.spans import word_hashes, word_spans
    words = ["a" * k + c for k in range(60) for c in "xyz"] * 2
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = word_spans(raw, np.array([0, len(raw)]), pp.INSIDE)
    for h in word_hashes(raw, s, e):
        assert len(set(h.tolist())) == 180 and (h[:180] == h[180:]).all()
    assert pa.array(words)[5].as_py() == bytes(raw[s[5]:e[5]]).decode()
