"""Joins on keys where missing equals missing, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def key_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
             nullable: bool = True) -> DataFrame:
    """Equi-join on `keys`; with `nullable`, a missing key matches a missing key.

    The null-safe test is still an equi-join for Spark (hash or sort-merge, with
    adaptive skew splitting), never a nested loop.
    """
    if not nullable:
        return left.join(right, keys, how)
    r = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    out = left.join(r, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.drop(*[f"_r_{k}" for k in keys])


def large(df: DataFrame) -> DataFrame:
    """Mark a join side that grows with the input: shuffled and merged, never collected by the driver for a broadcast.

    Size statistics count a file's compressed bytes and not the rows that `explode` adds, so they call such a side small.
    """
    return df.hint("merge")


def attach(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Group statistics written on every row of their group.

    An aggregate with map-side partials, joined back. A window over the group would
    put a whole group in one task; this form lets one key hold any share of rows.
    `df` is read twice, so persist it first when it is expensive.
    """
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return key_join(df, stats, keys)


_own_folders: dict[str, str] = {}
_scratch: dict[str, list[str]] = {}


def shared_folder(spark) -> str:
    """The session's `spark.checkpoint.dir`; only a local session may go without one, and then has a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="panelspark-")
        folder = _own_folders[app]
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Readers get a short plan, column pruning and pushdown, and a lost executor costs a
    re-read instead of a re-run of everything before. `drop_scratch` deletes what a session wrote.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/panelspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of `cut_lineage` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        mine = _scratch.get(df.sparkSession.sparkContext.applicationId, [])
        if path in mine:
            mine.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark) -> int:
    """Delete the tables this session's operators wrote; results that read them must have been stored before."""
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)
