"""Benchmark decontamination: edit distance by CGK embedding, sampled LSH and exact verification.

Texts and items are sequences of words (lower case, ASCII punctuation as white space). A text holds an item if some
window is within floor(n / 5) word insertions, deletions and substitutions of the item's n words.

0. Items of more than `PIECE` words are cut into even pieces. Of the pieces of an item some one takes no more than its
   own share of the edits, floor(m / 5) of its m words, so it is enough to look for pieces; this loses nothing.
1. A window that close shares at least (m - q + 1) - q * floor(m / 5) word q-grams with a piece of m words. Window
   starts with fewer shared grams ahead than any piece needs are passed over; this loses nothing.
2. At the others a random walk reads the window: each step writes the word under it and moves on by a random bit of
   step and word (the CGK embedding). Windows that differ by few edits fall into step again, so edit distance
   becomes Hamming distance. The walk stops where a window of the piece's size class ends.
3. `REPEATS` times `SAMPLED` steps of an own walk form a key; windows and pieces with an equal key are candidates.
   Walks agree less the longer they are and the more words are missing; up to `PIECE` words the repeats find a piece
   with its full share of edits at random places, deletions alone included, with a chance of at least 0.98 (measured
   by a test for every length). Equal sequences always meet.
4. The exact edit distance of the whole item is worked out for all window starts that a candidate piece allows.

Items go through in blocks of about `ITEM_BLOCK` pieces, each against all texts, so what a task is sent is bounded.

Cases: null or empty texts and items match nothing; an empty table on either side gives no rows; repeated rows give
a row each; the best window (fewest edits, then first) of each text and item is returned. Other columns play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import IS_BLANK, Rolling, Words, mix, slices

PART = 5                  # at most one edit for so many words
SAMPLED = 3
PIECE = 24                # words of the longest sequence that is looked up
REPEATS = 60
ITEM_BLOCK = 20_000
BREAK = IS_BLANK.copy()
BREAK[[c for c in range(33, 128) if not chr(c).isalnum()]] = True
A = Rolling(31)


def _classes():
    c, out = 1, []
    while c < 1 << 20:
        out.append(c)
        c = max(c + 1, c * 4 // 3)
    return np.array(out)


CLASSES = _classes()


@dataclass
class Items:
    """A block of items, with the gram filter and the LSH tables of all size classes of their pieces."""
    ids: list
    words: list[np.ndarray]
    item: np.ndarray = None                       # per piece: item number, words before it
    offset: np.ndarray = None
    filters: list = field(default_factory=list)   # (q, sorted grams, least shared, longest reach, classes)
    tables: dict = field(default_factory=dict)    # (class, repeat) -> (sorted keys, piece numbers)

    def __post_init__(self):
        cuts = [len(w) * np.arange(p + 1) // p for w in self.words for p in (math.ceil(len(w) / PIECE),)]
        pieces = [w[a:b] for w, c in zip(self.words, cuts) for a, b in zip(c[:-1], c[1:])]
        self.item = np.repeat(np.arange(len(cuts)), [len(c) - 1 for c in cuts])
        self.offset = np.concatenate([c[:-1] for c in cuts])
        n = np.array([len(w) for w in pieces])
        self.group = CLASSES[np.searchsorted(CLASSES, n, side="right") - 1]
        for q, here in ((3, n >= 6), (1, n < 6)):
            if here.any():
                grams = np.unique(np.concatenate([q_grams(w, q) for w, h in zip(pieces, here) if h]))
                need = min(int(m - q + 1 - q * (m // PART)) for m in n[here])
                self.filters.append((q, grams, max(1, need), int((n[here] + n[here] // PART).max()), sorted(set(self.group[here].tolist()))))
        for c in set(self.group.tolist()):
            mine = np.flatnonzero(self.group == c)
            longest = int(n[mine].max())
            seq = np.zeros((len(mine), longest + 1), np.uint64)
            for i, k in enumerate(mine):
                seq[i, : n[k]] = pieces[k]
            start = np.arange(len(mine)) * (longest + 1)
            for r, k in enumerate(walk_keys(seq.ravel(), start, start + n[mine], [c])[c]):
                order = np.argsort(k, kind="stable")
                self.tables[c, r] = (k[order], mine[order])


def q_grams(w: np.ndarray, q: int) -> np.ndarray:
    at = np.arange(max(0, len(w) - q + 1))
    return A.stretch(A.sums(w), at, at + q)


def plan(c: int) -> list[np.ndarray]:
    """The sampled steps of each repeat for windows of size class c: within one and a half steps a word."""
    rng = np.random.default_rng(1000 + c)
    steps = max(1, c * 3 // 2)
    return [np.sort(rng.integers(0, steps, SAMPLED)) for _ in range(REPEATS)]


SEEDS = mix(np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def walk_keys(seq: np.ndarray, start: np.ndarray, end: np.ndarray, classes: list[int], most: int = 8192) -> dict[int, np.ndarray]:
    """Per size class, keys (repeat, start) of the windows that begin at each start; past `end` a walk reads blanks.

    All repeats walk side by side, and the classes differ only in the steps they look at, so one walk serves them all.
    """
    plans = {c: plan(c) for c in classes}
    steps = 1 + max(int(p[-1]) for ps in plans.values() for p in ps)
    looks: dict[int, dict[int, list[int]]] = {}
    for c, ps in plans.items():
        for r, sampled in enumerate(ps):
            for j in sampled.tolist():
                looks.setdefault(j, {}).setdefault(c, []).append(r)
    out = {c: np.zeros((REPEATS, len(start)), np.uint64) for c in classes}
    rows = np.arange(REPEATS)[:, None]
    for k in range(0, len(start), most):
        s = start[k:k + most]
        n = np.minimum(end[k:k + most] - s, steps)
        # only the words that some walk can reach, close together
        reach = np.zeros(len(seq) + 1, np.int32)
        np.add.at(reach, s, 1)
        np.add.at(reach, s + n, -1)
        used = np.cumsum(reach[:-1]) > 0
        word = np.append(seq[used], np.uint64(0))
        at = np.repeat((np.cumsum(used) - 1)[np.minimum(s, len(seq) - 1)][None, :], REPEATS, axis=0)
        stop = at[:1] + n
        bits = mix(word[None, :] ^ SEEDS[:, None])
        bits = [bits, mix(bits + np.uint64(1))]
        for j in range(steps):
            if j and j % 64 == 0 and j // 64 >= len(bits):
                bits.append(mix(bits[-1] + np.uint64(1)))
            inside = at < stop
            here = np.minimum(at, len(word) - 1)
            for c, who in looks.get(j, {}).items():
                for r in who:
                    w = np.where(inside[r], word[here[r]], np.uint64(0))
                    out[c][r, k:k + most] = mix(out[c][r, k:k + most] * np.uint64(31) + w + np.uint64(j + 1))
            at = at + (inside & ((bits[j // 64][rows, here] >> np.uint64(j % 64)) & np.uint64(1)).astype(bool))
    return out


def start_distances(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least edits between the item and a stretch of any length that begins at each place of each window."""
    back = windows[:, ::-1]  # from the end, a stretch may begin anywhere at no cost
    ramp = np.arange(back.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(back), len(ramp)), np.int32)
    for i, w in enumerate(item[::-1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (back != w), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row[:, ::-1]


def edit_distances(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Least edits between the item and a window's beginning of any length; one row per window."""
    return start_distances(item, windows)[:, 0]


def stretches(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, most: int) -> np.ndarray:
    """Ranges lo:hi of equal documents united where they meet, and cut at `most`; rows of (begin, end), in order."""
    order = np.lexsort((lo, doc))
    lo, hi, doc = lo[order], hi[order], doc[order]
    cut = np.flatnonzero((lo[1:] > hi[:-1]) | (doc[1:] != doc[:-1])) + 1
    lo, hi = lo[np.concatenate(([0], cut))], hi[np.concatenate((cut - 1, [len(hi) - 1]))]
    n = -(-(hi - lo) // most)
    begin = np.repeat(lo, n) + most * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return np.stack([begin, np.minimum(begin + most, np.repeat(hi, n))], axis=1)


def matches(texts: list[str | None], items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item number, first word, edits): the best window of each text and item that match."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in slices(texts):
        w = Words(texts[i:j], lower=True, blank=BREAK)
        seq = w.hashes(A)
        if not len(seq):
            continue
        stop = np.repeat(w.first[1:], w.n)
        for q, grams, need, reach, classes in items.filters:
            shared = np.zeros(len(seq) + 1, np.int64)
            mine = q_grams(seq, q)
            where = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
            shared[1: len(mine) + 1] = grams[where] == mine
            total = np.cumsum(shared)
            at = np.arange(len(seq))
            ahead = total[np.minimum(np.minimum(at + reach, stop), len(seq))] - total[at]
            alive = at[ahead >= need]
            if not len(alive):
                continue
            pairs = []
            for c, walks in walk_keys(seq, alive, stop[alive], classes).items():
                for r, keys in enumerate(walks):
                    have, number = items.tables[c, r]
                    lo, hi = np.searchsorted(have, keys, side="left"), np.searchsorted(have, keys, side="right")
                    n = hi - lo
                    hit = np.flatnonzero(n)
                    if len(hit):
                        each = np.repeat(hit, n[hit])
                        offset = np.arange(len(each)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
                        pairs.append(np.stack([number[lo[each] + offset], alive[each]]))
            if not pairs:
                continue
            piece, at = np.concatenate(pairs, axis=1)
            # windows of the item that may hold its piece here begin so many words before, give or take the edits
            pairs = np.unique(np.stack([items.item[piece], at - items.offset[piece], w.doc_of(at)]), axis=1)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(pairs[0])) + 1, [pairs.shape[1]]))
            for a, b in zip(cut[:-1], cut[1:]):
                k = int(pairs[0, a])
                item = items.words[k]
                most = len(item) // PART
                _, base, doc = pairs[:, a:b]
                lo, hi = np.maximum(base - most, w.first[doc]), np.minimum(base + most + 1, w.first[doc + 1])
                fits = lo < hi
                if not fits.any():
                    continue
                begins = stretches(lo[fits], hi[fits], doc[fits], max(4096, len(item)))
                begins = begins[np.argsort(begins[:, 1] - begins[:, 0], kind="stable")]
                wide = int((begins[:, 1] - begins[:, 0]).max()) + len(item) + most
                step = max(1, (1 << 20) // wide)
                for s in range(0, len(begins), step):
                    lo, hi = begins[s:s + step].T
                    col = lo[:, None] + np.arange(int((hi - lo).max()) + len(item) + most)
                    windows = np.where(col < stop[lo][:, None], seq[np.minimum(col, len(seq) - 1)], np.uint64(0))
                    d = start_distances(item, windows)[:, :-1]
                    for x, y in zip(*np.nonzero((d <= most) & (col < hi[:, None]))):
                        doc = int(w.doc_of(lo[x]))
                        got = (int(d[x, y]), int(col[x, y] - w.first[doc]))
                        best[i + doc, k] = min(got, best.get((i + doc, k), got))
    return [(t, k, s, d) for (t, k), (d, s) in sorted(best.items())]


def load_items(rows: list[tuple]) -> Items | None:
    """Items of (id, text) rows that have a word."""
    w = Words([t for _, t in rows], lower=True, blank=BREAK)
    seq = w.hashes(A) if rows else np.zeros(0, np.uint64)
    parts = [(r[0], seq[w.first[i]:w.first[i + 1]]) for i, r in enumerate(rows) if w.n[i]]
    return Items([p[0] for p in parts], [p[1] for p in parts]) if parts else None


def block_count(some: DataFrame) -> int:
    """Blocks of items (t) of about ITEM_BLOCK pieces each."""
    pieces = F.ceil(F.size(F.split("t", r"[\s\p{Punct}]+")) / PIECE)
    return math.ceil((some.agg(F.sum(pieces)).first()[0] or 0) / ITEM_BLOCK)


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """Rows (id, item id, start_word, n_edits): the texts that hold an item, with its best window."""
    kinds = df.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType
    schema = f"_id {kinds[0]}, _item {kinds[1].simpleString()}, start_word long, n_edits long"
    docs = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    some = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    parts = block_count(some)
    out = None
    for part in range(parts):
        items = load_items(sorted(some.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect(), key=repr))
        if items is None:
            continue

        def run(batches, items=items):
            from pyspark.sql.pandas.types import to_arrow_type
            kind = to_arrow_type(kinds[1])
            for b in batches:
                got = matches(b.column("_text").to_pylist(), items)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").take(pa.array([g[0] for g in got], pa.int64())), pa.array([items.ids[g[1]] for g in got], kind),
                     pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64())], names=["_id", "_item", "start_word", "n_edits"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = df.sparkSession.createDataFrame([], schema)
    return out.select(F.col("_id").alias(doc_id), F.col("_item").alias(item_id), "start_word", "n_edits")


def clean_documents(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of `df`, same columns, whose text holds no item; each row is judged where it stands."""
    at = df.columns.index(text)
    some = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    parts = block_count(some)
    for part in range(parts):
        items = load_items(sorted(some.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect(), key=repr))
        if items is None:
            continue

        def run(batches, items=items):
            for b in batches:
                bad = {g[0] for g in matches(b.column(at).to_pylist(), items)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
