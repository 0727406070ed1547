"""Scans, sinks and row stacking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan_table(spark: SparkSession, path: str, cols: list[str] | None = None,
               schema: str | None = None) -> DataFrame:
    """A stored table, or some of its columns. A stated schema saves the footer pass."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*cols) if cols else df


def scan_csv(spark: SparkSession, path: str, schema: str, header: bool = True,
             sep: str = ",") -> DataFrame:
    """Delimited text under a stated schema, so no inference pass is needed."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep,
                          quote='"', escape='"', mode="PERMISSIVE")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header, quote='"', escape='"')


def append_rows(*dfs: DataFrame) -> DataFrame:
    """Stack by column name; a column one input lacks is missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def replicate_rows(df: DataFrame, n: int, idx: str = "copy") -> DataFrame:
    """Each row n times, numbered 1..n, without a join."""
    return df.withColumn(idx, F.explode(F.sequence(F.lit(1), F.lit(n))))
