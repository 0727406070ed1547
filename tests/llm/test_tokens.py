"""Both tokenizers against their libraries, grammars by round trip, files by plain sums."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import repair_tokens as R
from panelspark.llm import shared_viterbi as V
from panelspark.llm.common import read
from panelspark.llm.word_ids import WordIds

BPE, SPM = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "a\nb", "\n\n a\tb \n", "▁a▁ b", "é́é ñ", "日本語 テキスト", "😀👍🏽 x😀",
       "don't we'll THE'S it's''s", "ΑΣ ΟΔΟΣ σς", "<s> </s> <0x0A> <unk>", "<|endoftext|> a<|startoftext|>b", "x" * 300, "ab" * 4000, "1234567890 12.5", "\x00\x01 \x7f",
       " a b\x85c\x1cd", "İstanbul ǅ ß", "www.Thing.com/a_b?c=d&e=%20", "the,, the., (the) [the] the!?", "ﬁne ①", "🇫🇷🇩🇪", "á" * 50, " " * 50 + "x"]


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    h = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    return ODD + t + h


def test_word_bpe_as_the_library(texts):
    e = WordIds(BPE)
    want = [x.ids for x in e.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    flat, bound = e.encode_column(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, np.split(flat, bound[1:-1]), want):
        assert a.tolist() == b, t[:80]
    # in other company, with a warm store
    for t, b in zip(texts, want):
        assert e.encode_column(pa.array([t], pa.string()))[0].tolist() == b


def test_sentencepiece_as_the_library(texts):
    m = V.Pieces(SPM)
    want = [m.processor.encode(t or "") for t in texts]
    for t, a, b in zip(texts, m.encode(texts), want):
        assert a.tolist() == b, (t or "")[:80]
        if t and "▁" not in t:
            assert m.decode(a) == t
            assert m.processor.decode(b) == t


def test_unigram_as_the_library(texts, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto.FromString(open(SPM, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for k, p in enumerate(proto.pieces):  # scores on the scale of log probabilities
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = -3.0 - k / 2000 - (0.37 * k % 1)
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(proto.SerializeToString())
    m = V.Pieces(path)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    total = lambda ids: sum(m.score[i] for i in ids)
    for t in texts:
        if t and all(ord(c) < 0x250 and c >= " " for c in t):
            a, b = m.encode([t])[0].tolist(), lib.encode(t)
            assert abs(total(a) - total(b)) < 1e-3 * len(t)
            assert m.decode(np.array(a)) == t.replace("▁", " ")


def test_prefixes_are_shared():
    m = V.Pieces(SPM)
    words = sorted(["▁then", "▁there", "▁the", "▁thereby", "▁x"])
    alone = [m.encode_words([w])[0] for w in words]
    assert m.encode_words(words) == alone


def test_grammar_round_trip():
    r = np.random.default_rng(1)
    for ids in [np.zeros(0, np.uint32), np.array([2], np.uint32), np.array([7] * 501 + [2], np.uint32), r.integers(0, 40, 30000).astype(np.uint32),
                np.tile(np.array([5, 6, 7, 5, 6, 9, 2], np.uint32), 4000), np.tile(r.integers(0, 49408, 300), 60).astype(np.uint32)]:
        g = R.compress(ids)
        assert (R.expand(g, g["symbols"]) == ids).all()
        assert R.symbol_lengths(g, g["symbols"]).sum() == len(ids)
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) // 2, len(ids) // 2 + 1)):
            if b > a:
                assert (R.expand_range(g, a, b) == ids[a:b]).all()
    assert len(R.compress(np.tile(np.array([5, 6, 7, 5, 6, 9, 2], np.uint32), 4000))["symbols"]) < 10000


def test_files(spark, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    path = str(tmp_path / "t")
    R.write_tokens(df, path, BPE)
    got = R.read_tokens(spark, path).collect()
    enc = WordIds(BPE)
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == [None] + sorted(i for i, _ in rows if i is not None)
    for r in got:
        own = [np.append(enc.encode_column(pa.array([t], pa.string()))[0], np.uint32(2)) for i, t in rows if i == r.doc_id]
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(x.astype("<u4").tobytes())) for x in own]
    empty = str(tmp_path / "e")
    R.write_tokens(df.limit(0), empty, BPE)
    assert R.read_tokens(spark, empty).count() == 0


def test_encode_decode(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in V.encode_decode(df, SPM).collect()}
    m = V.Pieces(SPM)
    for i, t in enumerate(ODD):
        assert got[i].n_tokens == len(m.processor.encode(t or "")) and got[i].round_trip == ("▁" not in (t or ""))
    assert V.encode_decode(df.limit(0), SPM).count() == 0


def frequent_pairs(symbols, end=R.END):
    """Most places of one pair that do not overlap, none across the end of a text."""
    from collections import Counter
    seen, last = Counter(), {}
    for i, p in enumerate(zip(symbols.tolist(), symbols.tolist()[1:])):
        if p[0] != end and last.get(p) != i - 1:
            seen[p] += 1
            last[p] = i
    return max(seen.values(), default=0)


@pytest.mark.parametrize("kind", ["copies", "same", "words", "runs", "near copies"])
def test_no_pair_stays_frequent(kind):
    rng = np.random.default_rng(5)
    passage = rng.integers(3, 40_000, 100)
    ids = {"copies": np.tile(np.append(passage, R.END), 3000), "same": np.full(50_000, 7), "words": rng.zipf(1.3, 60_000) % 5000 + 3,
           "runs": np.repeat(rng.integers(3, 6, 5000), rng.integers(1, 9, 5000)),
           "near copies": np.concatenate([np.where(rng.random(100) < 0.05, rng.integers(3, 40_000, 100), passage) for _ in range(800)])}[kind].astype(np.uint32)
    g = R.compress(ids)
    assert (R.expand(g, g["symbols"]) == ids).all()
    assert frequent_pairs(g["symbols"]) < R.LEAST
    if kind == "copies":
        assert len(g["symbols"]) < 300
    for a, b in ((0, 10), (777, 1500), (len(ids) - 5, len(ids))):
        assert (R.expand_range(g, a, b) == ids[a:b]).all()
