"""Packing: every id in one piece, no padding, balanced steps; ids equal the library's."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelspark.llm import tier_packing as tp
from panelspark.llm.queries import QUERIES
from panelspark.llm.spans import pieces, utf8
from panelspark.llm.word_ids import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [tp.END]


def check(rows, want, tiers=tp.TIERS):
    """rows: pieces with ids; want: ids by document. Each document is whole, each sequence gapless and of an allowed length."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        docs[r.doc_id].append((r.start, ids, r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    assert docs.keys() == want.keys()
    for d, parts in docs.items():
        assert sum((p[1] for p in sorted(parts)), []) == want[d] and {p[2] for p in parts} == {len(want[d])}
        assert [p[0] for p in sorted(parts)] == np.cumsum([0] + [len(p[1]) for p in sorted(parts)])[:-1].tolist()
    small = 0
    for parts in seqs.values():
        at = 0
        for offset, n, size in sorted(parts):
            assert offset == at
            at += n
        assert at == size and size & (size - 1) == 0 and size <= tiers[0]
        small += size not in tiers
    return seqs, small


def test_all_ids_once_without_padding(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(int(rng.paretovariate(0.6)) % 6000)) for _ in range(300)] + [None, "", "  ", "x" * 30000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = tp.pack_texts(df, PATH, pool=20_000).collect()
    seqs, small = check(got, {d: ids_of(t) for d, t in rows})
    pools = len(got) and sum(len(ids_of(t)) for t in texts) / 20_000 + 3
    assert small <= 8 * pools
    # most of what fits into a window of its tier stays whole
    parts = defaultdict(int)
    for r in got:
        parts[r.doc_id] += 1
    fits = [d for d, t in rows if len(ids_of(t)) <= 2048]
    assert np.mean([parts[d] for d in fits]) < 1.5


def test_tiers_hold_what_fits_them():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9000, 3000)
    rows = tp.pack(n)
    got = defaultdict(int)
    for size, row in rows:
        assert sum(p[2] for p in row) == size
        for d, _, m in row:
            got[d] += m
    assert [got[d] for d in range(3000)] == n.tolist()
    assert sum(size not in tp.TIERS for size, _ in rows) <= 8
    # a window of a tier holds a piece that is longer than the next tier, unless the pool had run out of them
    led = [max(p[2] for p in row) > size // 2 for size, row in rows if size in tp.TIERS[:-1]]
    assert np.mean(led) > 0.9


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049], [1, 1, 1], [2047] * 5, [255], [100_000], [256, 512, 1024, 2048], [1] * 5000])
def test_small_pools(lengths):
    rows = tp.pack(np.array(lengths, np.int64))
    assert sum(s for s, _ in rows) == sum(lengths) and all(s & (s - 1) == 0 and s <= 2048 for s, _ in rows)


def test_steps_are_balanced():
    rng = np.random.default_rng(2)
    rows = tp.pack(rng.integers(1, 3000, 4000))
    step, n = tp.steps(rows)
    by = defaultdict(list)
    for k, (size, row) in zip(step.tolist(), rows):
        by[k].append((size, sum(p[2] ** 2 for p in row)))
    assert len(by) == n and all(len({s for s, _ in v}) == 1 for v in by.values())
    for size in tp.TIERS:
        cost = [sum(c for _, c in v) for v in by.values() if v[0][0] == size]
        many = [len(v) for v in by.values() if v[0][0] == size]
        assert not many or max(many) - min(many) <= 1
        assert len(cost) < 3 or max(cost) < 1.35 * min(cost) or max(many) != min(many)


def test_repeated_ids_other_types_and_clashing_names(spark):
    rows = [("a", "one two", 1, "s"), ("a", "three", 2, "s"), (None, "four five six", 3, "s")]
    df = spark.createDataFrame(rows, "doc_id string, text string, start int, ids string")
    got = tp.pack_texts(df, PATH).collect()
    assert sorted((r.doc_id or "", r.doc_tokens) for r in got if r.start == 0) == sorted((d or "", len(ids_of(t))) for d, t, *_ in rows)
    assert tp.pack_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    with pytest.raises(ValueError):
        tp.pack_texts(df, PATH, tiers=(2048, 1000))


def test_given_table(spark, sf):
    got = QUERIES["op12_tier_packing"](spark, sf)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and "ids" not in got.columns
    docs = {r.doc_id: ids_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got.collect():
        part = np.array(docs[r.doc_id][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(docs[r.doc_id])


# ---- the ids

ODD = ["".join(random.Random(7 + k).choice(list("aB'tsre llvmd<|startoftext|>́éÀß×÷ÿÿµ日!?.,;12 \n\t\x85\x1c\x7f\x00\U0001f600") + ["<|endoftext|>", "  ", " "])
               for _ in range(k % 40)) for k in range(6000)] + ["a<|startoftext|>b <|endoftext|>", "x" * 300, "É" * 200 + " É", "ﬀ İ ı"]


def ids(enc, texts):
    buf, offsets = utf8(pa.array(texts, pa.string()))
    out = []
    for i, j in pieces(offsets, 20_000):
        flat, bound = enc.encode(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        out += [flat[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])]
    return out


@pytest.mark.parametrize("how", ["pieces", "words", "small table", "small pool"])
def test_ids_equal_the_library(how, spark, sf):
    enc = WordIds(PATH, slots=10 if how == "small table" else 22, pool=2000 if how == "small pool" else 32 << 20)
    assert enc.by_word and enc.by_piece
    enc.by_piece = how != "words"
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect()]
    want = [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids(enc, texts) == want and ids(enc, texts) == want  # the second time from the table


def test_other_files_go_the_whole_way():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = WordIds(path)
    assert not enc.by_word
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(ODD[:500], add_special_tokens=False)]
    assert ids(enc, ODD[:500]) == want


def test_missing_texts():
    assert ids(WordIds(PATH), [None, "", "a", None]) == [[], [], ids_of("a")[:-1], []]
