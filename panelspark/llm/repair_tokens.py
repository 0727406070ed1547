"""Token ids in compressed binary shards: Re-Pair grammars with random access.

Texts are encoded with a public tokenizer file in ascending order of id, each ends with one end id, and shards hold
whole texts. A shard's ids are shortened by repeatedly replacing frequent neighbours by a new symbol; it stores the
rules, the length that every symbol expands to, and the symbols. Any stretch is decoded from the symbols that cover
it. One row of a Parquet folder is one shard, written by Spark, so any store that Spark reaches will do.

In each round the pairs are counted in hashed bins, those in full bins are counted exactly, and every pair met at least
`LEAST` times becomes a rule; of overlapping pairs the more frequent one wins, and a rule that is left with fewer places
waits for a later round. The most frequent pair always wins, so every round shortens the ids, and rounds go on until no
pair is met as often. No pair crosses a text's end.

Ids come from `word_ids`: new words go to the library, words met before to a table of bounded size.

Cases: a null or empty text is the end id alone; a null id comes first; equal ids keep any order; an empty table
writes no shards; a text longer than a shard has one to itself. Only id and text are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelspark.llm.spans import pieces, utf8
from panelspark.llm.word_ids import word_ids

END = 2
SHARD = 1 << 20           # ids in a shard, unless one text has more
PART_BYTES = 16 << 20     # text in a partition
LEAST = 24                # a pair met less often is no rule
BINS = 18


def _apart(at: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without every other position in a run of one pair (a a a a holds a a twice), so that counts are of what can be replaced; and those."""
    run = (np.diff(at) == 1) & (pair[1:] == pair[:-1])
    if not run.any():
        return at, pair, at[:0]
    run = np.concatenate(([False], run))
    place = np.arange(len(at))
    keep = (place - np.maximum.accumulate(np.where(run, 0, place))) % 2 == 0
    return at[keep], pair[keep], at[~keep]


def compress(ids: np.ndarray, end: int = END) -> dict[str, np.ndarray]:
    """left, right: rules of the symbols from `base` on; first: where each round's rules begin; length: of their expansions; symbols."""
    seq = ids.astype(np.int64)
    base = int(seq.max()) + 1 if len(seq) else 0
    size, left, right, first = base, [], [], []
    live = np.arange(len(seq) - 1) if len(seq) else np.zeros(0, np.int64)  # where a pair begins that may be frequent
    live = live[seq[live] != end]                                            # nothing crosses the end of a text
    while True:
        pair = seq[live] * size + seq[live + 1]
        bins = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BINS)).astype(np.int64)
        full = (np.bincount(bins, minlength=1 << BINS) >= LEAST)[bins]
        at, pair, spare = _apart(live[full], pair[full])
        names, n = np.unique(pair, return_counts=True)
        best = np.flatnonzero(n >= LEAST)
        if not len(best):
            break
        chosen = names[best]
        where = np.minimum(np.searchsorted(chosen, pair), len(chosen) - 1)
        hit = chosen[where] == pair
        at, rule = at[hit], where[hit]
        may = np.zeros(len(seq) + 1, bool)
        may[at] = may[spare] = True
        # of overlapping pairs the more frequent one; a rule must still be worth its place after that
        rank = np.zeros(len(seq) + 1, np.int64)
        rank[at + 1] = n[best][rule] * len(chosen) + rule + 1
        win = (rank[at + 1] >= rank[at]) & (rank[at + 1] > rank[np.minimum(at + 2, len(seq))])
        at, rule = at[win], rule[win]
        used = np.bincount(rule, minlength=len(chosen)) >= LEAST
        at, rule, chosen = at[used[rule]], (np.cumsum(used) - 1)[rule[used[rule]]], chosen[used]
        alive = np.ones(len(seq), bool)
        seq[at] = size + rule
        alive[at + 1] = False
        # only pairs with a new symbol, and those that were frequent before, can be frequent now
        may[at] = may[np.maximum(at - 1, 0)] = True
        may[np.maximum(at - 2, 0)[~alive[at - 1]]] = True
        seq, may = seq[alive], may[:-1][alive]
        live = np.flatnonzero(may[:-1] & (seq[:-1] != end))
        first.append(size)
        left.append(chosen // size)
        right.append(chosen % size)
        size += len(chosen)
    cat = lambda x: np.concatenate(x).astype(np.uint32) if x else np.zeros(0, np.uint32)
    left, right = cat(left), cat(right)
    length = np.ones(len(left), np.int64)
    of = lambda s, upto: np.where(s < base, 1, length[np.maximum(s.astype(np.int64) - base, 0)])
    for k, f in enumerate(first):
        a, b = f - base, (first[k + 1] if k + 1 < len(first) else size) - base
        length[a:b] = of(left[a:b], a) + of(right[a:b], a)
    return {"base": base, "left": left, "right": right, "first": np.array(first, np.uint32), "length": length.astype(np.uint32), "symbols": seq.astype(np.uint32)}


def symbol_lengths(g: dict, symbols: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    rule = symbols >= g["base"]
    out[rule] = g["length"][symbols[rule].astype(np.int64) - g["base"]]
    return out


def expand(g: dict, symbols: np.ndarray) -> np.ndarray:
    """The ids of some symbols: rounds are undone from the last to the first."""
    seq = symbols
    for f in g["first"][::-1]:
        rule = seq >= f
        if not rule.any():
            continue
        k = seq[rule].astype(np.int64) - g["base"]
        n = 1 + rule.astype(np.int64)
        at = (np.cumsum(n) - n)[rule]
        seq = np.repeat(seq, n)
        seq[at], seq[at + 1] = g["left"][k], g["right"][k]
    return seq


def expand_range(g: dict, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a shard, from the symbols that cover them alone."""
    ends = np.cumsum(symbol_lengths(g, g["symbols"]))
    i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    before = int(ends[i - 1]) if i else 0
    return expand(g, g["symbols"][i:j])[start - before: stop - before]


ARRAYS = ("left", "right", "first", "length", "symbols")
SHARD_SCHEMA = ("part int, shard int, n_ids long, doc_ids array<{id}>, doc_lengths array<int>, base long, "
                "left binary, right binary, first binary, length binary, symbols binary")


def _shards(path: str, kind: pa.DataType):
    def run(batches):
        enc, part, shard = word_ids(path), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def flush():
            g = compress(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(kind)),
                 pa.array([[len(x) for x in held]], pa.list_(pa.int32())), pa.array([g["base"]], pa.int64()), *(pa.array([g[a].astype("<u4").tobytes()], pa.binary()) for a in ARRAYS)],
                names=["part", "shard", "n_ids", "doc_ids", "doc_lengths", "base", *ARRAYS])

        for b in batches:
            names = b.column("_id").to_pylist()
            buf, offsets = utf8(b.column("_text"))
            for i, j in pieces(offsets):
                flat, bound = enc.encode(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                for name, x in zip(names[i:j], np.split(flat, bound[1:-1])):
                    if held and size + len(x) + 1 > SHARD:
                        yield flush()
                        shard, ids, held, size = shard + 1, [], [], 0
                    ids.append(name)
                    held.append(np.append(x, np.uint32(END)))
                    size += len(x) + 1
        if held:
            yield flush()
    return run


def write_tokens(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Shards of the ids of all texts, in ascending order of id, as a Parquet folder."""
    from pyspark.sql.pandas.types import to_arrow_type
    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    parts = max(1, math.ceil((rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) / PART_BYTES))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    kind = df.schema[doc_id].dataType
    (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
     .mapInArrow(_shards(tokenizer, to_arrow_type(kind)), SHARD_SCHEMA.format(id=kind.simpleString())).write.parquet(path))


def grammar(row) -> dict:
    return {"base": row["base"]} | {a: np.frombuffer(row[a], "<u4") for a in ARRAYS}


def read_tokens(spark: SparkSession, path: str, doc_id: str = "doc_id", blocks: int = 1000) -> DataFrame:
    """Per text of the files: id, start (ids before it in all shards), n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    # two levels, so that neither window holds more than a small share of the shards
    sizes = shards.select("part", "shard", "n_ids", F.floor(F.col("part") / blocks).alias("block"))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    over = sizes.groupBy("block").agg(F.sum("n_ids").alias("n")).select("block", F.coalesce(F.sum("n").over(ahead.orderBy("block")), F.lit(0)).alias("before"))
    starts = (sizes.join(over, "block")
              .select("part", "shard", (F.col("before") + F.coalesce(F.sum("n_ids").over(ahead.partitionBy("block").orderBy("part", "shard")), F.lit(0))).alias("before")))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                one = {c: row.column(c)[0].as_py() for c in ("base", *ARRAYS, "part", "shard")}
                g = grammar(one)
                ids = expand(g, g["symbols"]).astype("<u4")
                n = row.column("doc_lengths").flatten().to_numpy().astype(np.int64)
                at = np.cumsum(n) - n
                crc = [zlib.crc32(ids[a:a + m]) for a, m in zip(at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([one["part"]] * len(n), pa.int32()), pa.array([one["shard"]] * len(n), pa.int32()), row.column("doc_ids").flatten(),
                                                  pa.array(at), pa.array(n), pa.array(crc, pa.int64())], names=["part", "shard", "_id", "at", "n_tokens", "ids_crc32"])

    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    docs = shards.mapInArrow(run, f"part int, shard int, _id {kind}, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select(F.col("_id").alias(doc_id), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
