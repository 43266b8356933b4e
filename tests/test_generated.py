"""Hashes in SQL, generation over given keys, sketches kept by day."""

from pyspark.sql import functions as F
from tidemark.operators import generate, sketches
from tidemark.sources import hashes

SALTS = ["", "a", "ab", "abc", "abcd", "abcde", "u3001", "category", "é", "ip0"]


def test_hash_in_sql_is_sparks(spark, duck):
    ids = [0, 1, 7, 2**31 - 1, 2**31, 2**32 - 1, 2**32, 10**12 + 3, 2**62 + 5]
    want = spark.createDataFrame([(i,) for i in ids], "i long").select("i", *[F.hash("i", F.lit(s)).alias(f"h{k}") for k, s in enumerate(SALTS)]).collect()
    values = ", ".join(f"({i})" for i in ids)
    got = duck.sql(f"SELECT i, {', '.join(f'{hashes.spark_hash('i', s)} AS h{k}' for k, s in enumerate(SALTS))} FROM (SELECT CAST(i AS BIGINT) AS i FROM (VALUES {values}) t(i))").fetchall()
    assert sorted(got) == sorted(map(tuple, want))


def test_keyed_facts_do_not_depend_on_the_layout(spark):
    sizes, ids = generate.Sizes(50, 20, 30, 400), spark.range(1, 401).withColumnRenamed("id", "transaction_id")
    made = [sorted(map(str, generate.fact_transactions(spark, sizes, ids=x, keyed=True).collect())) for x in (ids.coalesce(1), ids.repartition(5))]
    assert made[0] == made[1] and len(made[0]) == 400
    held = generate.dim_device(spark, sizes, ids.withColumnRenamed("transaction_id", "device_id"), keyed=True)
    assert 0 < held.where("rooted_device_flag").count() < 40 and held.columns == generate.dim_device(spark, sizes).columns
    assert {r[0] for r in generate.dim_customer(spark, generate.Sizes(customers=600)).select("age_band").distinct().collect()} == set(generate.AGES)


def test_daily_sketches(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rows = lambda day, low, n, k="a": spark.range(low, low + n).select(F.lit(day).cast("date").alias("day"), F.lit(k).alias("k"), F.col("id").cast("double").alias("v"))
    sketches.write_daily(rows("2024-01-01", 0, 4000).unionByName(rows("2024-01-01", 0, 10, None)), path, "day", ["k"], "v")
    sketches.write_daily(rows("2024-01-02", 0, 5), path, "day", ["k"], "v")
    sketches.write_daily(rows("2024-01-02", 4000, 6000), path, "day", ["k"], "v")  # the day again, as it is now
    held = spark.read.parquet(path)
    got = {r["k"]: r for r in sketches.merged(held, ["k"]).select("k", sketches.size("sketch").alias("n")).collect()}
    assert got["a"]["n"] == 10_000 and got[None]["n"] == 10
    found = {r["k"]: r["quantiles"] for r in sketches.merged_quantiles(held, ["k"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    assert all(abs(q - f * 10_000) <= 10_000 * sketches.ERROR + 1 for q, f in zip(found["a"], (0, 0.1, 0.5, 0.9, 1)))
