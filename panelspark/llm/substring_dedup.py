"""Repeated passages: windows of words that occur twice are removed, found through a count-min prefilter.

1. Every window of `window` words is stood for by one of its shorter grams, the one with the smallest hash. Equal
   windows have the same stand-in, so a window occurs at most as often as its stand-in does, and a tenth as many
   stand-ins as windows go on.
2. Stand-ins are dealt by hash block. Each partition makes a count-min sketch of its part of a block; the sketches
   of a block are added up. The merged estimate is never below the true count.
3. Only windows whose stand-in is estimated at two or more are grouped exactly, by a 96-bit hash of their words.
   Estimates are never too low, so no repeated window is lost; a chance collision only costs a row. Repeats within
   a batch are settled there; of a window found so one row goes on, to meet the same window elsewhere, so a hot
   window has at most a row per batch.
4. All words of a window found twice are removed.

A block holds about `BLOCK` stand-ins at every input size (the number of blocks follows the bytes of text), hot
blocks are split by adaptive rebalancing, and sketches join their block's rows. A bit map of fixed size thins out the
texts before they are dealt, compressed; where it fills up it lets more pass and nothing is lost.

Cases: a null or empty text has no words; a text shorter than the window keeps all words; rows that are equal in
id and text are each other's copies and both lose their windows; an empty table gives no rows. Only the id and
text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Rolling, Words, mix, row_key, slices
from panelspark.operators.keys import cut_lineage, release

WINDOW, GRAM = 35, 16
BLOCK = 1 << 13          # stand-ins per block, on average
WIDTH = 1 << 15          # counters per sketch row and block
DEPTH = 2
DENSE = 4096             # most stand-ins in one row
FILTER_BITS = 1 << 26    # of the bit map that thins out texts: 8 MB
RUN = 1 << 23            # grams whose smallest is looked for at a time
A, B, C = Rolling(11), Rolling(12), Rolling(13)


def stand_ins(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, index of each one's stand-in gram, hash of the gram at every index)."""
    at = words.windows(window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    sums = A.sums(words.hashes(A))
    n = len(words.start) - gram + 1
    grams = A.stretch(sums, np.arange(n), np.arange(n) + gram)
    pick, width = np.empty(len(at), np.int64), window - gram + 1
    for k in range(0, n, RUN):  # the index within a run of grams has 24 bits
        first, last = np.searchsorted(at, (k, k + RUN))
        if first < last:
            pick[first:last] = k + _least(grams[k:k + RUN + width - 1], width)[at[first:last] - k]
    return at, pick, grams


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of every `width` neighbours, by the high bits of the hash."""
    low = ((grams >> np.uint64(24)) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span:])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)


def short(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, 32 bits within the block) of stand-ins; two that share both only make more candidates."""
    return ((hashes >> np.uint64(34)) % np.uint64(blocks)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def cells(values: np.ndarray, row: int) -> np.ndarray:
    return ((values >> np.uint32(17 * row)) & np.uint32(WIDTH - 1)).astype(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """Count-min sketch with counters that stop at 2, which is all the question needs."""
    return np.stack([np.minimum(np.bincount(cells(values, r), minlength=WIDTH), 2) for r in range(DEPTH)]).astype(np.uint8)


def repeated(values: np.ndarray, bits: bytes) -> np.ndarray:
    """Which values the merged sketch (one bit per counter: at least two) estimates as repeated."""
    table = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(DEPTH, WIDTH).astype(bool)
    out = np.ones(len(values), bool)
    for r in range(DEPTH):
        out &= table[r][cells(values, r)]
    return out


def _lists(cut: np.ndarray, x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.view(np.int32)))


def _emit(blocks: int, window: int, gram: int):
    """Rows (block, values, keys) of one batch, a row per block that it has stand-ins in."""
    def run(batches):
        for b in batches:
            keys = b.column("_k2").to_numpy(zero_copy_only=False)
            texts = b.column("_text").to_pylist()
            values, owner = [], []
            for i, j in slices(texts):
                w = Words(texts[i:j])
                at, pick, grams = stand_ins(w, window, gram)
                if len(at):
                    new = np.concatenate(([True], pick[1:] != pick[:-1]))
                    values.append(grams[pick[new]])
                    owner.append(keys[i + w.doc_of(at[new])])
            if not values:
                continue
            (block, values), owner = short(np.concatenate(values), blocks), np.concatenate(owner)
            order = np.argsort(block, kind="stable")
            block, values, owner = block[order], values[order], owner[order]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
            yield pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), _lists(cut, values), _lists(cut, owner)], names=["block", "vals", "keys"])
    return run


def _densify(batches):
    """Small rows of a block become rows of up to DENSE stand-ins, each with its sketch."""
    held: dict = {"block": None, "v": [], "k": [], "n": 0}

    def flush():
        if held["n"]:
            v, k = np.concatenate(held["v"]), np.concatenate(held["k"])
            s, cut = sketch(v), np.array([0, len(v)])
            yield pa.RecordBatch.from_arrays([pa.array([held["block"]], pa.int64()), _lists(cut, v), _lists(cut, k),
                                              pa.array([np.packbits(np.stack([s == 1, s == 2])).tobytes()], pa.binary())],
                                             names=["block", "vals", "keys", "counts"])
        held.update(v=[], k=[], n=0)

    for b in batches:
        vals, keys = b.column("vals"), b.column("keys")
        offs, koffs = vals.offsets.to_numpy(), keys.offsets.to_numpy()
        allv, allk = vals.values.to_numpy().view(np.uint32), keys.values.to_numpy()
        for i, block in enumerate(b.column("block").to_numpy(zero_copy_only=False)):
            if block != held["block"] or held["n"] >= DENSE:
                yield from flush()
                held["block"] = block
            held["v"].append(allv[offs[i]:offs[i + 1]])
            held["k"].append(allk[koffs[i]:koffs[i + 1]])
            held["n"] += int(offs[i + 1] - offs[i])
    yield from flush()


def _merge(batches):
    """Adds the sketches of each block (rows come sorted by block); one bit per counter says two or more."""
    block, total = None, None
    shape = (2, DEPTH, WIDTH)

    def done():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], names=["block", "bits"])

    for b in batches:
        for k, raw in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
            if k != block:
                if block is not None:
                    yield done()
                block, total = k, np.zeros(shape[1:], np.uint8)
            one, two = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(shape)
            total = np.minimum(total + one + 2 * two, 2)
    if block is not None:
        yield done()


def _filter(batches):
    """Rows (key, block and value) of the stand-ins estimated as repeated."""
    for b in batches:
        keys, values = [], []
        for block, v, k, bits in zip(b.column("block").to_pylist(), b.column("vals"), b.column("keys"), b.column("bits").to_pylist()):
            v = v.values.to_numpy().view(np.uint32)
            hit = repeated(v, bits)
            values.append((np.int64(block) << 32) | v[hit].astype(np.int64))
            keys.append(k.values.to_numpy()[hit])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(values))], names=["_k2", "val"])


def _thinned(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts (compressed) whose key may be wanted, by a bit map of FILTER_BITS bits, however many keys there are."""
    piece = 1 << 20
    spot = F.pmod(F.col("_k2").cast("bigint"), F.lit(FILTER_BITS))
    rows = (wanted.select(spot.alias("s")).distinct().groupBy((F.col("s") / piece).cast("int").alias("p"))
            .agg(F.collect_list((F.col("s") % piece).cast("int")).alias("at"))
            .mapInArrow(_bit_map_pieces(piece), "p int, bits binary").collect())  # 64 pieces of 128 KB at most
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        bits[r["p"] * piece // 8:(r["p"] + 1) * piece // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            at = b.column("_k2").to_numpy(zero_copy_only=False).astype(np.int64) % FILTER_BITS
            b = b.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            z = [pack(t.encode("utf-8", "surrogatepass")) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_k1"), b.column("_k2"), pa.array(z, pa.binary())], names=["_k1", "_k2", "_z"])

    return docs.mapInArrow(run, "_k1 long, _k2 int, _z binary")


def _unpacked(column: pa.Array) -> list[str]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(z).decode("utf-8", "surrogatepass") for z in column.to_pylist()]


def _bit_map_pieces(piece: int):
    def run(batches):
        for b in batches:
            out = []
            for at in b.column("at"):
                bits = np.zeros(piece, bool)
                bits[at.values.to_numpy()] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("p"), pa.array(out, pa.binary())], names=["p", "bits"])
    return run


def block_count(docs: DataFrame, window: int, gram: int) -> int:
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return max(1, math.ceil(size / 6 * 2 / (window - gram + 2) / BLOCK))  # about six bytes a word


def candidates(docs: DataFrame, blocks: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (_k2, _text): the stand-ins each text shares with another place, by estimate: (_k2, vals)."""
    dense = cut_lineage(docs.select("_k2", "_text").mapInArrow(_emit(blocks, window, gram), "block long, vals array<int>, keys array<int>")
                        .hint("rebalance", "block").sortWithinPartitions("block")
                        .mapInArrow(_densify, "block long, vals array<int>, keys array<int>, counts binary"))
    sketches = (dense.select("block", "counts").repartition("block").sortWithinPartitions("block")
                .mapInArrow(_merge, "block long, bits binary"))
    hits = dense.select("block", "vals", "keys").join(sketches, "block").select("block", "vals", "keys", "bits").mapInArrow(_filter, "_k2 int, val long")
    out = cut_lineage(hits.groupBy("_k2").agg(F.collect_set("val").alias("vals")))
    release(dense)
    return out


def _windows(blocks: int, window: int, gram: int, chars: int = 5_000_000):
    """Windows whose stand-in is among their text's candidates.

    Those found twice in a piece of the batch are settled: a row (hash of the row id, null, rid, ranges of starts) per text, and
    one row of the window without a text. The others are a row (h1, half of h2 and the start, rid, null) each.
    """
    def find(texts, lists):
        for i, j in slices(texts):
            w = Words(texts[i:j])
            at, pick, grams = stand_ins(w, window, gram)
            if not len(at):
                continue
            wanted = np.unique(np.concatenate([lists[d].values.to_numpy() for d in range(i, j)]))
            block, value = short(grams, blocks)
            at = at[np.isin((block << 32 | value)[pick], wanted)]
            doc = w.doc_of(at)
            h1, h2 = (r.stretch(r.sums(w.hashes(r)), at, at + window).view(np.int64) for r in (B, C))
            yield h1, h2 & -(1 << 32), i + doc, at - w.first[doc]

    def run(batches):
        for b in batches:
            texts, lists, rids = _unpacked(b.column("_z")), b.column("vals"), b.column("rid").to_numpy(zero_copy_only=False)
            for i, j in slices(texts, chars):
                got = list(find(texts[i:j], lists.slice(i, j - i)))
                if not got:
                    continue
                h1, h2, doc, at = map(np.concatenate, zip(*got))
                order = np.lexsort((at, doc, h2, h1))
                h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
                same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
                before, after = np.concatenate(([False], same)), np.concatenate((same, [False]))
                settled, witness = before | after, after & ~before
                go = ~settled | witness
                rid = np.where(witness, -1, rids[i + doc])
                yield pa.RecordBatch.from_arrays([pa.array(h1[go]), pa.array(h2[go] | np.where(witness, 0, at)[go]), pa.array(rid[go]), pa.nulls(int(go.sum()), pa.list_(pa.int32()))],
                                                 names=["h1", "h2", "rid", "ranges"])
                doc, at = doc[settled], at[settled]
                if len(doc):
                    order = np.lexsort((at, doc))
                    doc, at = doc[order], at[order]
                    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)))
                    lo, hi, doc = at[new], at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))], doc[new]
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
                    ids = rids[i + doc[cut[:-1]]]
                    yield pa.RecordBatch.from_arrays([pa.array(mix(ids.astype(np.uint64)).view(np.int64)), pa.nulls(len(ids), pa.int64()), pa.array(ids),
                                                      _lists(2 * cut, np.stack([lo, hi], axis=1).ravel().astype(np.int32))], names=["h1", "h2", "rid", "ranges"])
    return run


def _matched(batches):
    """Rows come sorted by window: a row equal to its neighbour is a repeat. Settled rows pass through. Out: (rid, ranges)."""
    last = None  # (h1, h2, rid, start, told) of the row before

    def pack(rid, at):
        own = rid >= 0
        rid, at = rid[own], at[own].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(rid), _lists(2 * np.arange(len(rid) + 1), np.repeat(at, 2))], names=["rid", "ranges"])

    for b in batches:
        ready = b.column("ranges").is_valid().to_numpy(zero_copy_only=False)
        if ready.any():
            yield b.filter(pa.array(ready)).select(["rid", "ranges"])
        b = b.filter(pa.array(~ready))
        if not b.num_rows:
            continue
        h1, both, rid = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "rid"))
        h2, at = both >> 32, both & 0xFFFFFFFF
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        first = last is not None and (h1[0], h2[0]) == last[:2]
        if first and not last[4]:
            yield pack(np.array([last[2]]), np.array([last[3]]))
        hit = np.concatenate(([first], same)) | np.concatenate((same, [False]))
        yield pack(rid[hit], at[hit])
        last = (h1[-1], h2[-1], rid[-1], at[-1], bool(hit[-1]))


def _remove(window: int):
    def run(batches):
        for b in batches:
            out = []
            for t, ranges in zip(_unpacked(b.column("_z")), b.column("ranges")):
                words = t.encode("utf-8", "surrogatepass").split()
                r = np.concatenate([x.values.to_numpy() for x in ranges]).reshape(-1, 2)
                step = np.bincount(r[:, 0], minlength=len(words) + 1) - np.bincount(np.minimum(r[:, 1] + window, len(words)), minlength=len(words) + 1)
                gone = np.cumsum(step)[: len(words)] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            n, sha, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("_k1"), b.column("_k2"), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(kept, pa.string())], names=["_k1", "_k2", "n_removed", "sha", "kept"])
    return run


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_k1, _k2, n_removed, sha, kept): the texts that lose words, one row per distinct id and text."""
    docs = df.select(*row_key(F.col(doc_id), F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    blocks = block_count(docs, window, gram)
    some = candidates(docs, blocks, window, gram)
    texts = cut_lineage(_thinned(docs, some).join(some, "_k2").withColumn("rid", F.monotonically_increasing_id()))
    release(some)
    found = (texts.select("rid", "_z", "vals").mapInArrow(_windows(blocks, window, gram), "h1 long, h2 long, rid long, ranges array<int>")
             .repartition("h1").sortWithinPartitions("h1", "h2").mapInArrow(_matched, "rid long, ranges array<int>")
             .groupBy("rid").agg(F.collect_list("ranges").alias("ranges")))
    return (texts.select("rid", "_k1", "_k2", "_z").join(found, "rid").select("_k1", "_k2", "_z", "ranges")
            .mapInArrow(_remove(window), "_k1 long, _k2 int, n_removed long, sha string, kept string").dropDuplicates(["_k1", "_k2"]))


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    every = (df.select(F.col(doc_id).alias("_id"), *row_key(F.col(doc_id), F.col(text)), words.alias("w"))
             .select("_id", "_k1", "_k2", F.size("w").cast("bigint").alias("n_words"),
                     F.sha2(F.encode(F.array_join("w", " "), "utf-8"), 256).alias("whole")))
    cut = repeated_passages(df, doc_id, text, window, gram).select("_k1", "_k2", "n_removed", "sha")
    return (every.join(cut, ["_k1", "_k2"], "left")
            .select(F.col("_id").alias(doc_id), "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
                    F.coalesce("sha", "whole").alias("kept_sha256")))


def pandas_reference(texts: list[str | None], window: int = WINDOW) -> pd.DataFrame:
    """The plain definition, for tests on small inputs."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
