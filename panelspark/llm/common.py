"""Shared pieces: table reads, row keys, words and hashes over whole batches of texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(id_col: Column, text_col: Column) -> list[Column]:
    """96 bits of id and text. Rows with equal keys are equal rows, and so get equal results;
    unlike the id alone, the key is never missing."""
    parts = [F.coalesce(id_col.cast("string"), F.lit("\x00")), F.coalesce(text_col, F.lit(""))]
    return [F.xxhash64(*parts).alias("_k1"), F.hash(*parts).alias("_k2")]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (shift, multiply), so that equal inputs alone stay equal."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hash of any stretch of a sequence from one running sum, modulo 2^64.

    sum(v[i] * base^i) over the stretch, divided by base^start (the base is odd, so it has an
    inverse) and scrambled. Two of them with different bases make a 128-bit hash.
    """

    def __init__(self, salt: int):
        rng = np.random.default_rng(salt)
        self.base = int(rng.integers(1, 2**62)) * 4 + 3
        self.byte = rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = pow(self.base, -1, 2**64)
            both = []
            for b in (self.base % 2**64, inverse):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p))
            self.up, self.down = both

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


IS_BLANK = np.zeros(256, bool)
IS_BLANK[[ord(c) for c in BLANKS]] = True


class Words:
    """The words of a batch of texts: byte ranges in one buffer, and where each text begins.

    `first[d]:first[d + 1]` are the words of text d.
    """

    def __init__(self, texts: list[str | None], lower: bool = False, blank: np.ndarray = IS_BLANK):
        parts = [("" if t is None else t.lower() if lower else t).encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b"\n".join(parts) + b"\n"
        self.buf = np.frombuffer(self.raw, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank[self.buf]))))
        self.start, self.end = edge[0::2], edge[1::2]
        offsets = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)

    def hashes(self, rolling: Rolling, byte: np.ndarray | None = None) -> np.ndarray:
        sums = rolling.sums((rolling.byte if byte is None else byte)[self.buf])
        return rolling.stretch(sums, self.start, self.end)

    def windows(self, size: int) -> np.ndarray:
        """Word indices where a window of `size` words fits in its text."""
        room = np.repeat(self.first[1:], self.n)
        at = np.arange(len(self.start))
        return at[at + size <= room]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def slices(texts: list[str | None], chars: int = 1_500_000):
    """Consecutive pieces of a batch with a bounded number of characters (at least one text each)."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > begin and size + n > chars:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
