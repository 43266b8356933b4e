from pyspark.sql import functions as F
from tidemark.sources import tables


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = tables.upsert(target, changes, "k")
    assert sorted(once.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tables.upsert(once, changes, "k").collect()) == sorted(once.collect())


def test_sinks(spark, tmp_path):
    df = spark.range(100).withColumn("p", F.col("id") % 3)
    path = f"file://{tmp_path}/t"
    tables.overwrite(df, path, ["p"])
    tables.overwrite(df.where("id < 50"), path, ["p"])
    assert spark.read.parquet(path).count() == 50
    one = spark.read.parquet(path).where("p = 1")
    assert one.count() == 17 and all("/p=1/" in r[0] for r in one.select(F.input_file_name()).distinct().collect())
    tables.overwrite_clustered(df, f"{path}2", ["id"], 4)
    tables.compact(spark, f"{path}2", f"{path}3", ["p"], 2)
    assert spark.read.parquet(f"{path}3").count() == 100
    tables.append(df, f"{path}4", df.schema)
    assert tables.append_or_log(df.select("id"), f"{path}4", df.schema, log=lambda _: None) is False
    assert spark.read.parquet(f"{path}4").count() == 100
    assert tables.load_path_or_empty(spark, f"{path}9", "a int").count() == 0
    assert tables.load_path_or_empty(spark, f"{path}4", "id long").count() == 100
    assert "root" in tables.preview(df, 2)


def test_violations(spark):
    bad = spark.createDataFrame([(1, None), (1, "x"), (2, "y")], "k int, v string")
    assert {r[0]: r[1] for r in tables.violations(bad, "k", ["v"]).collect()} == {"not_null_v": 1, "primary_key_k": 1}


def test_namespace(spark):
    tables.create_namespace(spark, "tidemark_test")
    assert spark.catalog.currentDatabase() == "tidemark_test"
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE tidemark_test")
