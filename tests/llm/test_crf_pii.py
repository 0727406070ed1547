import hashlib
import random
import re

import numpy as np

from panelspark.llm import crf_pii as P
from panelspark.llm.common import read
from panelspark.llm.queries import QUERIES


def plain(t):
    """The patterns as stated, tried everywhere."""
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c in "0123456789"]
        s = sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


ODD = [None, "", "a@b.c", "a@@b.c", "a@b", "@b.c", "x@y@z.com", "a..b@c-d.e.f, next@x.y", "é.x@y.de", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 1.1.1.256 0255.000.1.1",
       "4111 1111 1111 1111", "4111-1111 11111111", "4111 1111  1111 1111", "+49 (30) 123-4567 8", "+1 2", "++12345678901", "+12345678901234567", "5" * 3000, "1." * 500,
       "a" * 20000, "+" * 3000 + "1", "@" * 3000, "card4111111111111111x", "١٢٣٤", "a@b.c\n1.2.3.4\t+1 555 123 4567.", "x@y.z.", "A.B@C.D@E.F", "+1 (((((((((((", "😀 a@b.cd 😀 10.0.0.1"]


def test_patterns_as_stated(spark, sf):
    texts = ODD + [d.text for d in read(spark, sf, "documents").collect()]
    r = random.Random(4)
    texts += ["".join(r.choice("1234.+-@ a(") for _ in range(60)) for _ in range(2000)]
    for t in texts:
        assert P.base_spans(t or "") == plain(t), (t or "")[:100]


def test_query_columns(spark, sf):
    docs = {d.doc_id: d.text for d in read(spark, sf, "documents").collect()}
    got = QUERIES["op1_crf_pii"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in range(4)]
        base = [f"{P.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(base) <= set(every) and len(every) == len(base) + r.n_added


def test_held_out_accuracy(spark):
    """Trained on one table, the field tags the patterns' spans in another by shape alone."""
    sf = "/root/testdata/sf0.01"
    table = P.training_runs(read(spark, sf, "documents"), "doc_id", "text")
    cut = len(table) * 2 // 3
    field = P.train(table[:cut])
    held = table[cut:]
    tags = field.decode([field.encode(w) for w, _ in held])
    gold = np.concatenate([np.array(y) for _, y in held])
    got = np.concatenate(tags)
    inside = gold > 0
    assert (got[inside] == gold[inside]).mean() > 0.9
    assert (got[~inside] > 0).mean() < 0.02


def test_viterbi_is_best_path():
    r = np.random.default_rng(0)
    f = P.Field({f"s={c}": i for i, c in enumerate("abc")})
    f.emit[:-1] = r.normal(size=(3, len(P.LABELS)))
    f.move = r.normal(size=f.move.shape)
    import itertools
    seqs = [r.integers(0, 4, (n, 7)) for n in (1, 2, 3, 1, 3)]
    for x, y in zip(seqs, f.decode(seqs)):
        e = f.scores(x)
        def worth(p):
            return f.begin[p[0]] + sum(e[t, k] for t, k in enumerate(p)) + sum((f.move + f.bar)[a, b] for a, b in zip(p, p[1:]))
        assert tuple(y) == max(itertools.product(range(len(P.LABELS)), repeat=len(x)), key=worth)


def test_redaction(spark):
    rows = [(i if i % 3 else None, t, "x", 1) for i, t in enumerate(ODD)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, _id int")
    field = P.train(P.training_runs(df, "doc_id", "text"))
    out = P.redacted(df, field)
    assert out.columns == df.columns and out.count() == len(rows)
    for r in out.collect():
        assert r.text is None or not [s for s in plain(r.text) if s[1] == 0]
    assert P.redact("a 1 b", [(2, 1, 3)]) == "a [IP] b" and P.redact("abcdef", [(1, 0, 3), (2, 1, 5)]) == "a[EMAIL]f"
    assert P.pii_spans(df.limit(0), field).count() == 0
    untrained = P.train(P.training_runs(df.limit(0), "doc_id", "text"))
    assert sum(r.n_added for r in P.pii_spans(df, untrained).collect()) == 0
