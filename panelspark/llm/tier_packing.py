"""Packing of token ids into sequences of several lengths, without padding.

1. A text's ids, closed by an end id, give full windows of the longest size; the rest is routed to the tier of the
   smallest window that holds it.
2. Tiers are packed from the longest to the shortest. A window takes a rest of its own tier, the longest first; its gap
   is filled from the shorter tiers by the longest rest that fits, and last by a stretch cut off the shortest rest that
   is longer than the gap. What is left of that one is routed anew.
3. So all windows of a pool are full, but for the last. Its ids become sequences whose lengths are powers of two.
4. Sequences of a tier are dealt to steps of `STEP` ids. Attention costs the sum of the squared lengths of a sequence's
   pieces; by falling cost sequences go to the steps in turn, there and back, so that steps of a pool cost about the same.

A pool is a run of texts with about `POOL` ids of one partition: nothing is shuffled, memory is bounded by a pool and
one text, and a lost task makes its sequences again from its own rows. Sequence numbers hold the partition's number.

Cases: a null or empty text is the end id alone; rows that share an id, or have none, are packed each for itself; an
empty table gives no rows; a text of any length is cut into as many pieces as it needs; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.spans import pieces, utf8
from panelspark.llm.word_ids import word_ids

TIERS = (2048, 1024, 512, 256)
END = 1
POOL = 1 << 21
STEP = 8 * TIERS[0]
LOCAL = 40  # bits of a sequence number below the partition's

Piece = tuple[int, int, int]  # document of the pool, start, length


def pack(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """(size, pieces) of every sequence for documents of these lengths; size is the sum of its pieces' lengths."""
    top = tiers[0]
    out: list[tuple[int, list[Piece]]] = []
    rests: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]  # by length: (document, start)
    seen = 0                                                         # bit k: there is a rest of length k
    for d, n in enumerate(lengths.tolist()):
        full = n // top * top
        out += [(top, [(d, s, top)]) for s in range(0, full, top)]
        if n > full:
            rests[n - full].append((d, full))
            seen |= 1 << (n - full)

    def take(n: int) -> tuple[int, int]:
        nonlocal seen
        got = rests[n].pop()
        if not rests[n]:
            seen &= ~(1 << n)
        return got

    for size, below in zip(tiers, (*tiers[1:], 0)):
        while seen >> (below + 1):
            n = seen.bit_length() - 1
            d, s = take(n)
            window, gap = [(d, s, n)], size - n
            while gap and seen:
                fits = seen & ((2 << gap) - 1)
                if fits:
                    n = fits.bit_length() - 1
                    window.append((*take(n), n))
                    gap -= n
                else:
                    n = (seen & -seen).bit_length() - 1
                    d, s = take(n)
                    window.append((d, s, gap))
                    rests[n - gap].append((d, s + gap))
                    seen |= 1 << (n - gap)
                    gap = 0
            if not gap:
                out.append((size, window))
            else:
                out += powers(window)
    return out


def powers(window: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The pieces as sequences whose lengths are the powers of two of their sum, the longest first."""
    left = sum(n for _, _, n in window)
    out, todo = [], window[::-1]
    while left:
        size = room = 1 << (left.bit_length() - 1)
        row = []
        while room:
            d, s, n = todo.pop()
            row.append((d, s, min(n, room)))
            if n > room:
                todo.append((d, s + room, n - room))
            room -= row[-1][2]
        out.append((size, row))
        left -= size
    return out


def steps(sequences: list[tuple[int, list[Piece]]], step: int = STEP) -> tuple[np.ndarray, int]:
    """Step of every sequence, and the number of steps; a step holds sequences of one size."""
    size = np.array([n for n, _ in sequences], np.int64)
    cost = np.array([sum(p[2] ** 2 for p in row) for _, row in sequences], np.float64)
    out, made = np.zeros(len(sequences), np.int64), 0
    for n in np.unique(size)[::-1].tolist():
        at = np.flatnonzero(size == n)
        at = at[np.argsort(-cost[at], kind="stable")]
        groups = -(-len(at) * n // step)
        turn, k = np.divmod(np.arange(len(at)), groups)
        out[at] = made + np.where(turn % 2 == 0, k, groups - 1 - k)
        made += groups
    return out, made


COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step"]


def _pack(path: str, tiers: tuple[int, ...], pool: int, end: int, with_ids: bool):
    def run(batches):
        enc, first = word_ids(path), TaskContext.get().partitionId() << LOCAL
        names, ids, size, made, done = [], [], 0, 0, 0

        def flush():
            nonlocal made, done
            lengths = np.array([len(x) for x in ids], np.int64)
            rows = pack(lengths, tiers)
            step, n_steps = steps(rows)
            col: dict[str, list] = {c: [] for c in ["doc", *COLUMNS]}
            parts = []
            for k, (n, row) in enumerate(rows):
                at = 0
                for d, s, m in row:
                    part = ids[d][s:s + m]
                    for c, v in zip(col, (d, s, m, zlib.crc32(part), len(ids[d]), first + made + k, at, n, first + done + int(step[k]))):
                        col[c].append(v)
                    if with_ids:
                        parts.append(part.tobytes())
                    at += m
            made, done = made + len(rows), done + n_steps
            doc = col.pop("doc")
            extra = [pa.array(parts, pa.binary())] if with_ids else []
            return pa.RecordBatch.from_arrays([pa.concat_arrays(names).take(pa.array(doc, pa.int64())), *(pa.array(v, pa.int64()) for v in col.values()), *extra],
                                              names=["id", *COLUMNS, *(["ids"] if with_ids else [])])

        for b in batches:
            buf, offsets = utf8(b.column("_text"))
            for i, j in pieces(offsets):
                flat, bound = enc.encode(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                names.append(b.column("id").slice(i, j - i))
                ids += [np.append(flat[x:y], np.uint32(end)).astype("<u4", copy=False) for x, y in zip(bound[:-1].tolist(), bound[1:].tolist())]
                size += len(flat) + j - i
                if size >= pool:
                    yield flush()
                    names, ids, size = [], [], 0
        if ids:
            yield flush()
    return run


def pack_texts(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS,
               pool: int = POOL, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, where it lies in its document and in its sequence, its step, and its ids (little-endian uint32).

    `tiers` are falling powers of two. A sequence's length is a tier or, once in a pool, a smaller power of two.
    """
    if any(t & (t - 1) or t < 1 for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers must be falling powers of two")
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("_text"))
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS) + (", ids binary" if with_ids else "")
    return rows.mapInArrow(_pack(tokenizer, tiers, pool, end, with_ids), schema).withColumnRenamed("id", doc_id)
