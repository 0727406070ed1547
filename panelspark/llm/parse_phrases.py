"""Phrase collocations from a prefix-free parse.

1. A text is a sequence of words, with marks where it is cut into pieces. A chunk ends where the hash of the last
   `longest - 1` words is a multiple of `EVERY`, and the next one begins with these words again. Where chunks end
   depends on the words alone, so repeated passages give equal chunks: the parse is a dictionary of distinct chunks, each with
   the number of times that it was met.
2. Phrases are counted inside distinct chunks, weighted by that number. A chunk owns the phrases whose last word is
   not among those it shares with the chunk before it, so every occurrence counts once.
3. A phrase is as frequent as its rarer half at most. So counts go up by length: of the hashes of the words and shorter
   phrases that reach the least frequency a bit map is kept, and longer phrases are only counted where both their parts are
   in it. Chance hits in the map let more through, never less.
4. The phrases themselves are counted last, as text, where every part passed the maps; counts are exact.

Cases: a null language is `und`; null or empty texts and those without a word have no phrases; A-Z alone are
lower-cased; equal rows count each; an empty table gives no rows; other columns are not read; a text of any length is
parsed whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm.common import mix
from panelspark.llm.spans import gather, pieces, strings, utf8, word_hashes, word_spans
from panelspark.operators.keys import cut_lineage

LONGEST = 3
LEAST = 10
COVERED = (50, 100)      # a phrase goes if a longer one around it has this share of its count
TOP = 2000
EVERY = 32               # words from one end of a chunk to the next, on average
HELD = 1 << 21           # phrases that a task counts before it passes them on
KEY_BITS = 40            # of a hash, in the counts that feed the maps
MAP_BITS = (20, 28)      # least and greatest size of a map, 32 MB at most
PARTS = 64               # of a language's phrases, ranked apart first
BLOCK_BITS = 12          # maps are put together in so many blocks

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CUT = np.zeros(256, bool)
CUT[[ord(c) for c in ".,;:!?"]] = CUT[0x0A:0x0E] = True
GAP = CUT.copy()
GAP[[0x20, 0x09]] = True
JOIN, MARK = 0x20, 0x0A   # what stands before a word in a chunk: a blank, or a mark where a piece or a text begins
INSIDE = np.zeros(256, bool)
INSIDE[[JOIN, MARK]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


# ---- the parse

def chunks(buf: np.ndarray, offsets: np.ndarray, overlap: int, every: int = EVERY) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks as text, the text each comes from, the words that each owns)."""
    low = LOWER[buf]
    start, end, first = word_spans(low, offsets, GAP)
    if not len(start):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(start)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head = head[:n]
    cuts = np.concatenate(([0], np.cumsum(CUT[low])))
    sep = np.full(n, JOIN, np.uint8)
    sep[1:][cuts[start[1:]] > cuts[end[:-1]]] = MARK
    sep[head] = MARK
    # all words again, each after what separates it from the one before
    size = end - start
    at = np.cumsum(size + 1) - size
    text = np.empty(int((size + 1).sum()), np.uint8)
    text[at - 1] = sep
    text[gather(at, size)] = low[gather(start, size)]
    doc = np.cumsum(head) - 1
    place = np.arange(n) - np.flatnonzero(head)[doc]
    window = word_hashes(low, start, end)[0]
    for _ in range(overlap - 1):
        window[1:] = mix(window[:-1] * STEP + window[1:])
    last = np.append(head[1:], True)
    # no chunk ends before it has enough words to share, and none begins after a text's last word, for it would own nothing
    trigger = (window % np.uint64(every) == 0) & (place >= overlap - 1) & ~last
    fresh = np.sort(np.concatenate([np.flatnonzero(head), np.flatnonzero(trigger) + 1]))  # first word that a chunk owns
    stop = np.append(fresh[1:], n)
    whole = head[fresh]
    begin = np.where(whole, fresh, fresh - overlap)
    names = np.flatnonzero(np.diff(first) > 0)  # texts with words
    return strings(text, at[begin] - whole, at[stop - 1] + size[stop - 1]), names[doc[fresh]], stop - fresh


def _parse(overlap: int, every: int):
    def run(batches):
        for b in batches:
            buf, offsets = utf8(b.column("_text"))
            for i, j in pieces(offsets):
                text, doc, own = chunks(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], overlap, every)
                if len(text):
                    yield pa.RecordBatch.from_arrays([b.column("lang").slice(i, j - i).take(pa.array(doc)), text, pa.array(own)], names=["lang", "chunk", "own"])
    return run


def dictionary(df: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, every: int = EVERY) -> DataFrame:
    """(lang, chunk, own, times): distinct chunks, the words each owns, and how often each was met."""
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("_text"))
    return rows.mapInArrow(_parse(longest - 1, every), "lang string, chunk string, own long").groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("times"))


# ---- counting inside chunks

@dataclass
class BitMap:
    bits: int
    data: bytes

    def has(self, h: np.ndarray) -> np.ndarray:
        k = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return (np.frombuffer(self.data, np.uint8)[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1


def _seed(langs: pa.Array) -> np.ndarray:
    code = langs.dictionary_encode()
    seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), 3) for x in code.dictionary.to_pylist()], np.uint64)
    return seeds[code.indices.to_numpy()]


class Grams:
    """The phrases of a batch of chunks by length: two hashes, whether they lie in a piece, whether the chunk owns them."""

    def __init__(self, batch: pa.RecordBatch, overlap: int):
        self.buf, offsets = utf8(batch.column("chunk"))
        self.start, self.end, first = word_spans(self.buf, offsets, INSIDE)
        many = np.diff(first)
        self.row = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(self.start)) - np.repeat(first[:-1], many)
        # a chunk that does not begin a text begins with the words that it shares with the one before
        shared = self.buf[offsets[:-1]] != MARK
        self.owned = ~shared[self.row] | (place >= overlap)
        before = self.buf[np.maximum(self.start - 1, 0)]
        self.joined = (before == JOIN) & (place > 0)  # goes on from the word before
        self.a, self.b = word_hashes(self.buf, self.start, self.end)
        seed = _seed(batch.column("lang"))[self.row]
        self.a, self.b = mix(self.a ^ seed), mix(self.b + seed)
        self.times = batch.column("times").to_numpy()[self.row]

    def levels(self, upto: int, maps: list[BitMap]):
        """Per length: (hashes a and b, index of the first word, of those in a piece whose parts are in the maps)."""
        at, a, b = np.arange(len(self.start)), self.a, self.b
        for k in range(1, upto + 1):
            if k > 1:
                # at and at + 1 begin phrases of length k - 1, which meet without a mark
                both = np.flatnonzero((at[1:] == at[:-1] + 1) & self.joined[np.minimum(at[:-1] + k - 1, len(self.start) - 1)]) if len(at) else at
                last = at[both] + k - 1
                a, b = mix(a[both] * STEP + self.a[last]), mix((b[both] ^ self.b[last]) * STEP + np.uint64(k))
                at = at[both]
            yield k, a, b, at
            if k <= len(maps):
                ok = maps[k - 1].has(a)
                at, a, b = at[ok], a[ok], b[ok]


def _sums(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.add.reduceat(times, cut) if len(cut) else times


def _count_keys(length: int, maps: list[BitMap], overlap: int):
    """(key, times) of the phrases of one length that a task holds."""
    def run(batches):
        keys, times, held = [], [], 0

        def flush():
            k, t = _sums(np.concatenate(keys), np.concatenate(times))
            return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(t)], names=["key", "times"])

        for b in batches:
            if b.num_rows:
                g = Grams(b, overlap)
                *_, (k, a, _, at) = g.levels(length, maps)
                own = g.owned[at + k - 1]
                key, t = _sums(a[own] >> np.uint64(64 - KEY_BITS), g.times[at[own]])
                keys.append(key)
                times.append(t)
                held += len(key)
                if held >= HELD:
                    yield flush()
                    keys, times, held = [], [], 0
        if keys:
            yield flush()
    return run


def frequent_map(chunk_table: DataFrame, length: int, maps: list[BitMap], least: int, overlap: int) -> BitMap:
    """The phrases of `length` words met at least `least` times, as a map of hashes; its size follows their number up to a bound."""
    counted = (chunk_table.select("lang", "chunk", "times").mapInArrow(_count_keys(length, maps, overlap), "key long, times long")
               .groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("key"))
    keys = cut_lineage(counted)
    bits = int(np.clip(np.ceil(np.log2(max(1, keys.count()) * 16.0)), *MAP_BITS))
    width = bits - BLOCK_BITS  # bits in a block

    def blocks(batches):
        now, held = None, np.zeros(1 << width, bool)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for b in batches:
            k = b.column("key").to_numpy() >> (KEY_BITS - bits)
            block = k >> width
            for part in np.unique(block).tolist():
                if part != now:
                    if now is not None:
                        yield done()
                    now, held = part, np.zeros(1 << width, bool)
                held[k[block == part] & ((1 << width) - 1)] = True
        if now is not None:
            yield done()

    block = F.shiftright("key", KEY_BITS - BLOCK_BITS)
    rows = keys.repartition(block).sortWithinPartitions(block).mapInArrow(blocks, "block int, bits binary").collect()
    data = bytearray(1 << (bits - 3))
    for r in rows:
        data[r["block"] << (width - 3): (r["block"] + 1) << (width - 3)] = r["bits"]
    return BitMap(bits, bytes(data))


def _count_phrases(longest: int, maps: list[BitMap], overlap: int):
    """(lang, words, phrase, times) of the phrases that the maps let through, added up over what a task holds at once."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            g = Grams(b, overlap)
            for k, a, c, at in g.levels(longest, maps):
                own = g.owned[at + k - 1]
                if k <= len(maps):
                    own &= maps[k - 1].has(a)
                a, c, at = a[own], c[own], at[own]
                order = np.lexsort((c, a))
                a, c, at = a[order], c[order], at[order]
                if not len(a):
                    continue
                cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))))
                times, one = np.add.reduceat(g.times[at], cut), at[cut]
                yield pa.RecordBatch.from_arrays(
                    [b.column("lang").take(pa.array(g.row[one])), pa.array(np.full(len(one), k, np.int32)), strings(g.buf, g.start[one], g.end[one + k - 1]), pa.array(times)],
                    names=["lang", "words", "phrase", "times"])
    return run


def phrase_counts(chunk_table: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, times): every phrase of up to `longest` words met at least `least` times in its language."""
    maps: list[BitMap] = []
    for k in range(1, longest):
        maps.append(frequent_map(chunk_table, k, maps, least, longest - 1))
    return (chunk_table.select("lang", "chunk", "times").mapInArrow(_count_phrases(longest, maps, longest - 1), "lang string, words int, phrase string, times long")
            .groupBy("lang", "words", "phrase").agg(F.sum("times").alias("times")).where(F.col("times") >= least))


# ---- scores

def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP,
                 every: int = EVERY) -> DataFrame:
    """Per language the `top` phrases of two and more words by score: (lang, rank, phrase, a, l, r, n, score).

    score = floor(1000000 a a / (l r)) at the cut with the least score, where a, l and r count the phrase and its two
    parts; n is the language's number of words. Phrases inside a longer one of at least half their count are left out.
    """
    table = cut_lineage(dictionary(df, lang, text, longest, every))
    totals = table.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    counts = cut_lineage(phrase_counts(table, longest, least))
    long = counts.where("words > 1").select("lang", "words", "phrase", F.col("times").alias("a"))
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("times").alias("f"))
    w = F.split("phrase", " ")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("left"),
                       F.array_join(F.slice(w, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    cuts = (cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
            .withColumns({"aa": _exact(F.col("a")) * _exact(F.col("a")), "lr": _exact(F.col("l")) * _exact(F.col("r"))})
            .withColumn("score", F.expr("(CAST(aa AS decimal(31,0)) * CAST(1000000 AS decimal(7,0))) div lr")))
    scored = (cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*"))
    # a phrase of one word less at either end: what lies inside a longer phrase lies inside one of these, which is as frequent
    inner = long.where("words > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(w, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (_exact(F.col("around")) * COVERED[1] < _exact(F.col("a")) * COVERED[0]))
    # the best of each part of a language first, so that the last step meets a bounded number of phrases
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
