"""Words of a text column as numpy arrays, straight from Arrow's buffers: no Python object per text or word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from panelspark.llm.common import mix

WIDE = 24  # bytes of a word that are read as three numbers; longer words go through xxhash
MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a missing text is empty."""
    a = column.cast(pa.large_string())
    if a.null_count:
        a = pc.fill_null(a, "")
    _, off, data = a.buffers()
    o = np.frombuffer(off, np.int64)[a.offset: a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0]:o[-1]], o - o[0]


def pieces(offsets: np.ndarray, most: int = 2_000_000):
    """Runs (i, j) of texts with about `most` bytes, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start and end of every word, and the index of each text's first word (one more at the end)."""
    word = ~blank[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    stop[:-1] &= ~word[1:] | first[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    padded = np.concatenate([buf, np.zeros(WIDE + 8, np.uint8)])
    view = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    n = end - start
    x = view[start] & MASK[np.minimum(n, 8)]
    size = n.astype(np.uint64)
    a = mix(x ^ (size * np.uint64(0x9E3779B97F4A7C15)))
    b = mix(x * np.uint64(0xA24BAED4963EE407) + size)
    for k in (8, 16):
        at = np.flatnonzero(n > k)
        if not len(at):
            break
        x = view[start[at] + k] & MASK[np.minimum(n[at] - k, 8)]
        a[at] = mix(a[at] * np.uint64(0x9FB21C651E98DF25) + x)
        b[at] = mix((b[at] ^ x) * np.uint64(0xD1342543DE82EF95) + np.uint64(k))
    for i in np.flatnonzero(n > WIDE).tolist():
        w = buf[start[i]:end[i]].tobytes()
        a[i], b[i] = xxhash.xxh3_64_intdigest(w, 1), xxhash.xxh3_64_intdigest(w, 2)
    return a, b


def gather(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of n each, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Stretches of the bytes as a string column."""
    n = end - start
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    data = buf[gather(start, n)]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
