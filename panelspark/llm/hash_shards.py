"""Sharding by extendible hashing, in DataFrame functions only.

A row's place is the bits of its key's hash. Buckets are hash prefixes; a bucket over the byte limit splits
on the next bit, and only such buckets do. The directory of leaves is what is left. Sizes are first added up
per prefix of a few more bits than the data need, so the splits work on sums, not rows.

Cases: a null key is a key; a null or empty text has no bytes and still a shard; equal keys share a hash, so
rows of a key that exceeds the limit by itself get their row number hashed in; a single row over the limit is
a shard of its own, marked `over`; an empty table has no shards. A row's columns stay in the struct `doc`, so
their names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.operators.keys import cut_lineage

BITS = 60


def hash_bits(key: Column) -> Column:
    """60 bits of the key's MD5 as text of 0 and 1."""
    hexa = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.lpad(F.conv(hexa, 16, 2), BITS, "0")


def _leaf_depths(cells: DataFrame, at: int, to: int, limit: int) -> DataFrame:
    """cells (cell, bytes, rows): with depth, the shortest prefix length from `at` to `to` whose bucket fits
    (or holds one row); null where none does."""
    each = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(at), F.lit(to))).alias("depth"))
    each = each.withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    fits = (each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("n"))
            .where((F.col("b") <= limit) | (F.col("n") == 1)))
    found = (each.select("cell", "depth", "prefix").join(fits.select("depth", "prefix"), ["depth", "prefix"], "left_semi")
             .groupBy("cell").agg(F.min("depth").alias("depth")))
    return cells.select("cell").join(found, "cell", "left")


def assign_shards(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """`doc` (the row as a struct), `_shard` (the leaf's bits), `_bytes` (of the row) and `_hash`."""
    sized = df.select(F.struct("*").alias("doc"), F.coalesce(size, F.lit(0)).cast("bigint").alias("_bytes"),
                      hash_bits(F.col(key)).alias("_hash"))
    by_hash = sized.groupBy("_hash").agg(F.sum("_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    heavy = by_hash.where((F.col("b") > limit) & (F.col("n") > 1)).select("_hash", F.lit(True).alias("_heavy"))
    if not heavy.isEmpty():
        # one write fixes the row numbers; a heavy key's rows then spread over the whole range
        sized = cut_lineage(sized.withColumn("_row", F.monotonically_increasing_id()))
        sized = (sized.join(heavy, "_hash", "left")
                 .withColumn("_hash", F.when(F.col("_heavy"), hash_bits(F.concat_ws("/", F.coalesce(F.col("doc").getField(key).cast("string"), F.lit("")), F.col("_row"))))
                             .otherwise(F.col("_hash"))).drop("_heavy", "_row"))
    sums = cut_lineage(sized.groupBy("_hash").agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    fine = min(BITS, math.ceil(math.log2(max(1, total / limit))) + 6)
    leaves, at, left = None, 0, sums
    while left is not None:
        # cells of `fine` bits, each holding all hashes that begin with it
        cell = F.substring("_hash", 1, fine)
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        depths = cut_lineage(_leaf_depths(cells, at, fine, limit))
        done = depths.where("depth IS NOT NULL").select(F.lit(fine).alias("bits"), "cell", "depth")
        rest = depths.where("depth IS NULL").select("cell")
        if fine == BITS:
            done = done.unionByName(rest.select(F.lit(fine).alias("bits"), "cell", F.lit(BITS).alias("depth")))
            left = None
        else:
            left = left.join(rest, cell == F.col("cell"), "left_semi")
            left = None if rest.isEmpty() else left
        leaves = done if leaves is None else leaves.unionByName(done)
        at, fine = fine + 1, min(BITS, fine + 6)
    steps = sorted(r[0] for r in leaves.select("bits").distinct().collect())  # at most BITS / 6 + 1 numbers
    if not steps:
        return sized.withColumn("_shard", F.lit(""))
    # one row of the directory fits each hash: a cell is either a leaf's or split further
    places = sums.select("_hash", F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.substring("_hash", 1, b).alias("cell"))
                                                      for b in steps])).alias("p"))
    depth = (places.select("_hash", "p.bits", "p.cell").join(leaves, ["bits", "cell"])
             .select("_hash", F.expr("substring(_hash, 1, depth)").alias("_shard")))
    return sized.join(depth, "_hash", "left")


def directory(assigned: DataFrame, limit: int) -> DataFrame:
    """One row per shard: bits, depth, rows, bytes, and whether a single row exceeds the limit."""
    return (assigned.groupBy("_shard").agg(F.count(F.lit(1)).alias("shard_rows"), F.sum("_bytes").alias("shard_bytes"))
            .withColumn("depth", F.length("_shard").cast("bigint")).withColumn("over", F.col("shard_bytes") > limit))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard; a shard is at most the limit, so a task that writes it is bounded."""
    (assigned.select("doc", F.concat(F.lit("b"), F.col("_shard")).alias("shard"))
     .repartition("shard").write.partitionBy("shard").parquet(path))
