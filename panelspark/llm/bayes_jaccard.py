"""Near duplicates by Jaccard similarity of word shingles, with Bayesian pruning of candidate pairs.

1. Texts with the same set of shingles form a class; one of its documents speaks for it. Classes go by a number written
   with them and rows by a hash of id and text; ids are only mapped to in the result.
2. 96 MinHash values of 16 bits; four at a time they are bands. Classes equal in a band share a bucket. At the
   threshold of 0.8 a pair shares none with a chance of (1 - 0.8^4)^24 = 3e-6.
3. Within a bucket the values of a pair are compared 16 at a time. Agreements among n values are binomial in the
   similarity, so under a uniform prior the chance of reaching the threshold is a binomial tail; a pair is dropped
   when it falls under `TOLERANCE`.
4. What is left is verified by the exact overlap of the 64-bit shingle sets.

Texts and bands that no later step wants are left out before the shuffle by bit maps of `MAP_BITS` bits, which let others pass but
lose none. A membership of a class in a bucket carries the MinHash values; it is joined by class once a round, with the sets, and
only if a pair of it survived.

A bucket is cut into blocks of at most `BLOCK` members, so no task sees a bucket whole. Classes need two rounds:

a. Members meet those of their own block and the bucket's pivots (about `PIVOTS` members that join every block). In a group of near
   copies nearly all link to a pivot, which unites the blocks.
b. What is still apart from its bucket's largest united set meets all members of the bucket. Those already united never
   meet, so rows follow the members, and grow faster only with members that do not link to what they share a bucket with:
   those pairs have to be looked at, in blocks.

Numbers of links do need every pair of a bucket. Where they are asked for, the blocks of a bucket travel packed, one row a block
and pair of blocks; the answer for a pair of blocks is again one row a block. A pair counts in the first band that it shares, and buckets with the
same members are kept once.

Result: one row per row of the input with class_id (the smallest id reachable over links) and n_links (documents of
similarity 0.8 or more, copies included).

Cases: a text of fewer than five words is its own single shingle; null or empty texts have no links, and the filter
keeps them all; a null id comes first; rows that share an id, or have none, are judged each by its text; an empty table
gives no rows. Ids of any type that can be ordered will do. Only id and text are read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Rolling, Words, mix, row_key, slices
from panelspark.operators.components import components
from panelspark.operators.keys import cut_lineage, release

SHINGLE = 5
OVER, UNDER = 4, 5       # the threshold as a fraction
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512
PIVOTS = 16              # members of a bucket in several blocks that meet all the others, on average
BLOCK_BYTES = 64 << 20
MAP_BITS = 1 << 26       # 8 MB
BLANK = r"\x20\x09-\x0D"
A, B = Rolling(21), Rolling(22)
_rng = np.random.default_rng(23)
MULTIPLY = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def least_agreements(n: int) -> int:
    """Fewest agreements in n that leave a chance of at least TOLERANCE; Beta(1, 1) prior, so a binomial tail."""
    t = OVER / UNDER
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t)**(n + 1 - m)
        if total >= TOLERANCE:
            return m
    return n


NEED = [(k, k + STEP, least_agreements(k + STEP)) for k in range(0, HASHES, STEP)]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    out = []
    for i, j in slices(texts):
        w = Words(texts[i:j])
        sums = A.sums(w.hashes(A))
        for d in range(j - i):
            a, b = w.first[d], w.first[d + 1]
            size = min(SHINGLE, b - a)
            at = np.arange(a, b - size + 1) if size else np.zeros(0, np.int64)
            out.append(np.unique(A.stretch(sums, at, at + size)))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: sums of two scrambles of its members."""
    both = [mix(s ^ np.uint64(k)).sum(dtype=np.uint64) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return tuple(int(x.view(np.int64)) for x in both)


def min_hashes(s: np.ndarray) -> bytes:
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    x = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for k in range(0, len(x), 2048):
        low = np.minimum(low, (x[None, k:k + 2048] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    return (mix(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def _describe(batches):
    for b in batches:
        sets = shingle_sets(b.column("_text").to_pylist())
        sig = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("_k1"), b.column("_k2"), pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([min_hashes(s) if len(s) else None for s in sets], pa.binary())], names=["id", "_k1", "_k2", "h1", "h2", "n", "mh"])


def bit_map(spots: DataFrame):
    """Broadcast bits, set at the column `spot` (from 0 to MAP_BITS - 1) of any number of rows; tasks merge pieces, the driver joins them."""
    piece = min(MAP_BITS, 1 << 20)
    parts = (spots.select(F.floor(F.col("spot") / piece).cast("int").alias("p"), (F.col("spot") % piece).cast("int").alias("at"))
             .distinct().groupBy("p").agg(F.collect_list("at").alias("at"))
             .mapInArrow(_pieces(piece), "p int, bits binary").collect())  # 64 pieces of 128 KB at most
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts:
        bits[r["p"] * piece // 8:(r["p"] + 1) * piece // 8] = np.frombuffer(r["bits"], np.uint8)
    return spots.sparkSession.sparkContext.broadcast(bits)


def _pieces(piece: int):
    def run(batches):
        for b in batches:
            out = []
            for at in b.column("at"):
                bits = np.zeros(piece, bool)
                bits[at.values.to_numpy()] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("p"), pa.array(out, pa.binary())], names=["p", "bits"])
    return run


def marked(bits: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return (bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)


def _bands(shared=None, size: int = 0):
    """The bands of each class; with bits `shared`, only those whose bucket may be marked, and with what comparisons need."""
    def run(batches):
        for b in batches:
            mh = np.frombuffer(b"".join(b.column("mh").to_pylist()), np.int64).reshape(-1, BANDS)
            each, band, key = np.repeat(np.arange(len(mh)), BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(mh)), mh.ravel()
            names = ["rep", "n"]
            if shared is not None:
                ok = marked(shared.value, (key ^ band.astype(np.int64) << 21) & (size - 1))
                each, band, key, names = each[ok], band[ok], key[ok], ["rep", *CLASS]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(each)) for c in names), pa.array(band), pa.array(key)], names=[*names, "band", "key"])
    return run


def surviving(mh: np.ndarray, a: np.ndarray, b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first shared band is this one and that no round of comparisons drops."""
    if band:
        keys = mh.view(np.uint64)
        first = ~(keys[a, :band] == keys[b, :band]).any(axis=1)
        a, b = a[first], b[first]
    agree = np.zeros(len(a), np.int64)
    for i, j, need in NEED:
        agree += (mh[a, i:j] == mh[b, i:j]).sum(axis=1)
        ok = agree >= need
        a, b, agree = a[ok], b[ok], agree[ok]
    return a, b


def group_pairs(left: np.ndarray, right: np.ndarray | None, mh: np.ndarray, band: int, apart: np.ndarray | None = None,
                most: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of a member on the left with one on the right (or two on the left), in pieces of at most `most` pairs.

    `apart` holds a mark of each member; members with the same one are not compared.
    """
    other = left if right is None else right
    out_a, out_b = [], []
    step = max(1, most // max(1, len(other)))
    for k in range(0, len(left), step):
        a, b = np.repeat(left[k:k + step], len(other)), np.tile(other, len(left[k:k + step]))
        ok = a < b if right is None else a != b
        if apart is not None:
            ok &= apart[a] != apart[b]
        a, b = surviving(mh, a[ok], b[ok], band)
        out_a.append(a)
        out_b.append(b)
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, width: int = 1 << 14, most: int = 1 << 19) -> np.ndarray:
    """Exact sizes of the intersections, by bit maps over slices of the members' common vocabulary."""
    if len(a) <= 4:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros(len(a), np.int64)
    for k in range(0, len(names), width):
        cols = min(width, -(-(len(names) - k) // 64) * 64)
        here = (code >= k) & (code < k + width)
        bits = np.zeros((len(sets), cols), bool)
        bits[row[here], code[here] - k] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, most // words.shape[1])
        for i in range(0, len(a), step):
            out[i:i + step] += np.bitwise_count(words[a[i:i + step]] & words[b[i:i + step]]).sum(axis=1, dtype=np.int64)
    return out


def _groups(batches, keys: list[str], columns: list[str]):
    """Row lists of consecutive equal keys; rows come sorted by them."""
    held, key = [], None
    for b in batches:
        cols = [b.column(c).to_pylist() for c in (*keys, *columns)]
        for r in zip(*cols):
            if r[:len(keys)] != key:
                if held:
                    yield key, held
                held, key = [], r[:len(keys)]
            held.append(r[len(keys):])
    if held:
        yield key, held


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(-1, HASHES)


def _collect(rows_of, schema: pa.Schema, size: int = 20_000):
    out = []
    for r in rows_of:
        out.append(r)
        if len(out) >= size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)


def _sides(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray | None]:
    """Members of a group by side; a group of one side compares its members with each other, a guest only with the hosts."""
    side = np.array([r[1] for r in rows])
    hosts, guests = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return hosts, (guests if len(guests) else None)


def _group_candidates(rows: list[tuple], within: bool) -> tuple[np.ndarray, np.ndarray]:
    hosts, guests = _sides(rows)
    apart, band, mh = np.array([r[2] for r in rows]), rows[0][3], _matrix([r[5] for r in rows])
    a, b = group_pairs(hosts, None, mh, band, apart) if within else (np.zeros(0, np.int64),) * 2
    if guests is not None:
        c, d = group_pairs(guests, hosts, mh, band, apart)
        a, b = np.concatenate([a, c]), np.concatenate([b, d])
    return a, b


CLASS = ["copies", "mh"]  # what a membership carries of its class, so that only sets are joined
ROLES = ["rep", "side", "mark", "band", *CLASS]
GROUP = ["bucket", "bi", "bj"]
MEMBER = pa.schema([("bucket", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("rep", pa.int64()), ("side", pa.int32()), ("mark", pa.int64()),
                    ("band", pa.int32()), ("copies", pa.int64()), ("mh", pa.binary())])


def _active(within: bool):
    """Members that have a surviving pair in their group."""
    def run(batches):
        def rows():
            for key, g in _groups(batches, GROUP, ROLES):
                a, b = _group_candidates(g, within)
                for i in np.union1d(a, b):
                    yield *key, *g[i]
        yield from _collect(rows(), MEMBER)
    return run


def linked_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that reach the threshold, exactly."""
    size = np.array([len(s) for s in sets], np.int64)
    both = overlaps(sets, a, b)
    ok = UNDER * both >= OVER * (size[a] + size[b] - both)
    return a[ok], b[ok]


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n members is linked to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _settle(sets: list[np.ndarray], reps: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per member of a group: the first one that it is linked to in the end, and how many documents it is linked to."""
    a, b = linked_pairs(sets, a, b)
    links = np.zeros(len(reps), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    return reps[united(len(reps), a, b)], links


LINKS = "u long, v long, links long"


def _verify(within: bool):
    """(u, v, links) of every member with links: links (u, v) span those of the group, and links counts documents."""
    def run(batches):
        def rows():
            for _, g in _groups(batches, GROUP, [*ROLES, "shingles"]):
                reps = np.array([r[0] for r in g])
                to, links = _settle([np.frombuffer(r[6], np.uint64) for r in g], reps, np.array([r[4] for r in g]), *_group_candidates(g, within))
                for i in np.flatnonzero(links):
                    yield int(reps[i]), int(to[i]), int(links[i])
        yield from _collect(rows(), pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())]))
    return run


def _settle_blocks(batches):
    """Per block of a pair of blocks one row, with the same for each of its members, in order."""
    def rows():
        for (bucket, bi, bj), g in _groups(batches, GROUP, ["block", "members"]):
            row = [(block, m) for block, members in g for m in members]
            block = np.array([b for b, _ in row])
            left, right = np.flatnonzero(block == bi), None if bi == bj else np.flatnonzero(block == bj)
            pairs = group_pairs(left, right, _matrix([m["mh"] for _, m in row]), row[0][1]["band"])
            to, links = _settle([np.frombuffer(m["shingles"], np.uint64) for _, m in row], np.array([m["rep"] for _, m in row]), np.array([m["copies"] for _, m in row]), *pairs)
            for k in dict.fromkeys((bi, bj)):
                yield bucket, k, to[block == k].tolist(), links[block == k].tolist()
    yield from _collect(rows(), pa.schema([("bucket", pa.int64()), ("block", pa.int32()), ("to", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))]), 200)


def _shingles(shared, size: int):
    """The sets of the texts whose key may be marked."""
    def run(batches):
        for b in batches:
            b = b.filter(pa.array(marked(shared.value, b.column("_k2").to_numpy(zero_copy_only=False).astype(np.int64) & (size - 1))))
            sets = shingle_sets(b.column("_text").to_pylist())
            sig = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["h1", "h2", "shingles"])
    return run


class Found:
    """What the texts of `df` share: rows, classes of equal shingle sets, and the buckets that classes meet in."""

    def __init__(self, df: DataFrame, doc_id: str, text: str):
        self.docs = df.select(F.col(doc_id).alias("id"), *row_key(F.col(doc_id), F.col(text)), F.col(text).alias("_text"))
        self.kind = df.schema[doc_id].dataType.simpleString()
        self.each = cut_lineage(self.docs.mapInArrow(_describe, f"id {self.kind}, _k1 long, _k2 int, h1 long, h2 long, n long, mh binary"))
        first = F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "_k1", "_k2"))  # a null id comes first
        self.classes = cut_lineage(self.each.where("n > 0").groupBy("h1", "h2")
                                   .agg(first.alias("own"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("mh").alias("mh"))
                                   .withColumn("rep", F.monotonically_increasing_id()))
        own = self.classes.select("rep", "n", *CLASS)
        buckets = cut_lineage(own.mapInArrow(_bands(), "rep long, n long, band int, key long").groupBy("band", "key")
                              .agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who"), F.sum("n").alias("w")).where("m > 1")
                              .groupBy("m", "who").agg(F.min(F.struct("band", "key", "w")).alias("b"))  # the same members once, in their first band
                              .select("b.band", "b.key", "m", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(8 * F.col("b.w") / BLOCK_BYTES)).cast("int").alias("blocks")))
        spot = F.col("key").bitwiseXOR(F.shiftleft(F.col("band").cast("long"), 21)).bitwiseAND(F.lit(MAP_BITS - 1))
        bits = bit_map(buckets.select(spot.alias("spot")))
        self.members = cut_lineage(own.mapInArrow(_bands(bits, MAP_BITS), "rep long, copies long, mh binary, band int, key long").join(buckets, ["band", "key"])
                                   .select("rep", *CLASS, "band", F.xxhash64("band", "key").alias("bucket"), "m", "blocks", _spot("rep", "blocks", 1).alias("block")))
        release(buckets)

    def sets(self, reps: DataFrame) -> DataFrame:
        """(rep, shingles) of the classes in `reps`, made again from a text of each; no text is shuffled."""
        wanted = reps.select("rep").distinct().join(self.classes.select("rep", "h1", "h2", "own._k2"), "rep")
        bits = bit_map(wanted.select(F.col("_k2").cast("long").bitwiseAND(F.lit(MAP_BITS - 1)).alias("spot")))
        return (self.docs.select("_k2", "_text").mapInArrow(_shingles(bits, MAP_BITS), "h1 long, h2 long, shingles binary")
                .join(wanted.select("rep", "h1", "h2"), ["h1", "h2"]).dropDuplicates(["rep"]).select("rep", "shingles"))

    def _compare(self, rows: DataFrame, within: bool) -> DataFrame:
        """(u, v, links) in groups of (bucket, bi, bj) and ROLES."""
        dealt = lambda d: d.repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "rep")
        active = cut_lineage(dealt(rows.select(*GROUP, *ROLES))
                             .mapInArrow(_active(within), "bucket long, bi int, bj int, rep long, side int, mark long, band int, copies long, mh binary"))
        found = cut_lineage(dealt(active.join(self.sets(active), "rep").select(*GROUP, *ROLES, "shingles"))
                            .mapInArrow(_verify(within), LINKS))
        release(active)
        return found

    def roots(self) -> DataFrame:
        """(rep, root) of all classes that are linked to another."""
        own = F.col("rep").alias("mark")
        m = self.members
        hosts = m.select("rep", *CLASS, "band", "bucket", F.col("block").alias("bi"), F.lit(0).alias("side"), own)
        pivots = (m.where((F.col("blocks") > 1) & (_spot("rep", "m", 2) < PIVOTS)).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .where("bi <> block").select("rep", *CLASS, "band", "bucket", "bi", F.lit(1).alias("side"), own))
        near = self._compare(hosts.unionByName(pivots).withColumn("bj", F.lit(0)), True)
        united = _roots(near)
        # what its bucket's largest united set has not reached
        if m.where("blocks > 1").isEmpty():
            return united
        cut = cut_lineage(m.where("blocks > 1").join(united, "rep", "left").withColumn("mark", F.coalesce("root", "rep")).drop("root"))
        sizes = cut.groupBy("bucket", "mark").agg(F.count(F.lit(1)).alias("c"))
        largest = sizes.groupBy("bucket").agg(F.max(F.struct("c", "mark")).alias("top"), F.sum("c").alias("all")).where("top.c < all")
        left = cut_lineage(cut.join(largest.select("bucket", F.col("top.mark").alias("top"), (F.col("all") - F.col("top.c")).alias("s")), "bucket")
                           .withColumn("parts", F.ceil(F.col("s") * F.col("blocks") / F.col("m")).cast("int")))  # as large as the bucket's blocks
        release(cut)
        if left.isEmpty():
            return united
        hosts = left.withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("rep", *CLASS, "band", "bucket", F.col("block").alias("bi"), "bj", F.lit(0).alias("side"), "mark")
        guests = (left.where("mark <> top").withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .select("rep", *CLASS, "band", "bucket", "bi", _spot("rep", "parts", 3).alias("bj"), F.lit(1).alias("side"), "mark"))
        far = self._compare(hosts.unionByName(guests), False)
        return _roots(near.unionByName(far))

    def links(self) -> DataFrame:
        """(u, v, links) over all pairs of every bucket: (u, v) span the links, and links add up to the documents u is linked to."""
        m = self.members
        small = m.where("blocks = 1").select("rep", *CLASS, "band", "bucket", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side"), F.col("rep").alias("mark"))
        large = m.where("blocks > 1")
        full = large.join(self.sets(large), "rep")
        packed = cut_lineage(full.groupBy("bucket", "block", "blocks").agg(F.array_sort(F.collect_list(F.struct("rep", "band", "copies", "mh", "shingles"))).alias("members")))
        pairs = (packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("bucket", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "members"))
        found = (pairs.repartition(*GROUP).sortWithinPartitions(*GROUP, "block").mapInArrow(_settle_blocks, "bucket long, block int, to array<long>, links array<long>")
                 .join(packed.select("bucket", "block", F.col("members.rep").alias("u")), ["bucket", "block"])
                 .select(F.explode(F.arrays_zip("u", "to", "links")).alias("x")).select("x.u", F.col("x.to").alias("v"), "x.links").where("links > 0"))
        return cut_lineage(self._compare(small, True).unionByName(found))

    def tops(self, roots: DataFrame) -> DataFrame:
        """(h1, h2, rep, copies, top): top is (some, id, _k1, _k2) of the first row in reach."""
        own = self.classes.select("h1", "h2", "rep", "own", "copies")
        first = roots.join(own.select("rep", "own"), "rep").groupBy("root").agg(F.min("own").alias("top"))
        return own.join(roots.join(first, "root").select("rep", "top"), "rep", "left").select("h1", "h2", "rep", "copies", F.coalesce("top", "own").alias("top"))


def _spot(column: str, into: str, salt: int):
    return F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.col(into)).cast("int")


def _roots(links: DataFrame) -> DataFrame:
    return components(links.select("u", "v")).select(F.col("node").alias("rep"), "root")


def jaccard_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, class_id, n_links, n_shingles."""
    f = Found(df, doc_id, text)
    found = f.links()
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    known = (f.tops(_roots(found)).join(counts, "rep", "left")
             .select("h1", "h2", "top", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    some = f.each.where("n > 0").join(known, ["h1", "h2"]).select(F.col("id").alias(doc_id), F.col("top.id").alias("class_id"), "n_links", F.col("n").alias("n_shingles"))
    none = f.each.where("n = 0").select(F.col("id").alias(doc_id), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("n").alias("n_shingles"))
    return some.unionByName(none)


def one_per_class(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `df`, same columns: of each class the first by id and text hash (equal rows once), and all without a word."""
    f = Found(df, doc_id, text)
    keep = f.tops(f.roots()).select("top._k1", "top._k2").distinct()
    rows = df.select(F.struct("*").alias("d"), *row_key(F.col(doc_id), F.col(text)), F.coalesce(F.col(text).rlike(f"[^{BLANK}]"), F.lit(False)).alias("_words"))
    first = rows.where("_words").join(keep, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    return first.select("d.*").unionByName(rows.where("NOT _words").select("d.*"))
