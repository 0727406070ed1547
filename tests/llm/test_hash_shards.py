from pyspark.sql import functions as F

from panelspark.llm import hash_shards as H


def place(spark, rows, limit):
    df = spark.createDataFrame(rows, "k long, b long, _hash string")
    a = H.assign_shards(df, "k", F.col("b"), limit)
    return a, {r["_shard"]: r for r in H.directory(a, limit).collect()}


def test_limits_and_prefixes(spark):
    rows = [(i, i % 97, "x") for i in range(3000)] + [(None, None, None), (7, 0, "")]
    a, d = place(spark, rows, 1500)
    assert a.count() == len(rows)
    assert all(s.shard_bytes <= 1500 for s in d.values())
    names = sorted(d)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # leaves never nest
    # a bucket split only because it was too large
    for n in names:
        if n:
            assert sum(s.shard_bytes for m, s in d.items() if m.startswith(n[:-1])) > 1500
    assert all(r["_hash"].startswith(r["_shard"]) for r in a.collect())


def test_one_key_over_the_limit_is_dealt_by_row(spark):
    a, d = place(spark, [(5, 10, "")] * 400 + [(i, 1, "") for i in range(100, 200)], 300)
    assert a.count() == 500 and all(s.shard_bytes <= 300 for s in d.values())


def test_large_row_stands_alone(spark):
    a, d = place(spark, [(1, 5000, "")] + [(i, 10, "") for i in range(2, 60)], 100)
    over = [s for s in d.values() if s.over]
    assert len(over) == 1 and over[0].shard_rows == 1


def test_empty_and_zero(spark):
    a, d = place(spark, [(1, 0, ""), (2, None, "")], 10)
    assert list(d) == [""] and d[""].shard_rows == 2
    a, d = place(spark, [(1, 0, "")], 10)
    assert H.assign_shards(spark.createDataFrame([], "k long, b long"), "k", F.col("b"), 10).count() == 0


def test_written_shards(spark, tmp_path):
    a, d = place(spark, [(i, 10, "") for i in range(100)], 200)
    H.write_shards(a, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == len(d)
