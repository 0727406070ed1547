"""Session settings for tests and benchmarks on one machine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str | int | None = None, memory: str = "12g") -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("panelspark")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", memory)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
