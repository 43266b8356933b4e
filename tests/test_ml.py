import pytest
from conftest import TINY
from pyspark.sql import functions as F
from tidemark.operators import features, ml
from tidemark.sources import fixtures as fx


@pytest.fixture(scope="module")
def table(spark):
    tx = fx.event_transactions(spark, TINY)
    labels = tx.select("transaction_id", (F.col("amount") > 100).cast("int").alias("fraud_label"))
    return ml.prepare(features.feature_table(tx, labels)).cache()


def test_models(spark, table, tmp_path):
    train, test = ml.split(table, bucket=(F.col("transaction_id") * 7919 + 42) % 100)
    assert train.count() + test.count() == table.count()
    train = ml.weighted(train).cache()
    forest, linear = ml.fit(train, ml.random_forest(10, 4)), ml.fit(train, ml.logistic_regression())
    scored = ml.scores(test, forest, linear)
    assert scored.count() == test.count() and scored.where("rf_fraud_score NOT BETWEEN 0 AND 1 OR lr_fraud_score IS NULL").count() == 0
    m = ml.metrics("rf", forest.transform(test))
    assert m["auc"] > 0.9 and ml.metrics_table(spark, [m]).first()["model_name"] == "rf"
    cells = ml.confusion(scored, "fraud_label", "rf_prediction").collect()
    assert sum(r["predicted_0"] + r["predicted_1"] for r in cells) == test.count()
    top = ml.importance(spark, forest, forest.transform(test)).first()
    assert top["feature"] == "amount_imp"
    ml.save(linear, f"file://{tmp_path}/m")
    assert ml.load(f"file://{tmp_path}/m").transform(test).count() == test.count()


def test_one_class_has_no_auc(spark, table):
    none = ml.weighted(table.withColumn("fraud_label", F.lit(0.0)))
    model = ml.fit(none, ml.random_forest(3, 2))
    out = ml.metrics("rf", model.transform(none))
    assert out["auc"] is None and out["f1"] == 1.0


def test_split_takes_any_key(spark):
    for rows in (spark.range(5000).selectExpr("id * 1000000007 * 1000 as k"), spark.range(5000).selectExpr("concat('t', id) as k")):
        train, test = ml.split(rows, key="k")
        assert train.count() + test.count() == 5000 and 3800 < train.count() < 4200
        again, _ = ml.split(rows.repartition(7), key="k")
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, train.collect()))


def test_a_class_is_not_one_tasks(spark):
    rows = spark.range(0, 60_000, 1, 6).select(F.col("id").alias("transaction_id"), F.when(F.col("id") % 50 == 0, 1.0).otherwise(0.0).alias("fraud_label"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # as if the rows were too many for Spark to guess that the classes are few
    try:
        met = ml.weighted(rows)
        assert {(r[0], round(r[1], 6)) for r in met.select("fraud_label", "class_weight").distinct().collect()} == {(1.0, 25.0), (0.0, 0.510204)}
        held = met.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in held) <= 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_training_rows_are_spread(spark):
    rows = spark.range(0, 50_000, 1, 1)
    held = ml.spread(rows, 5_000).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 10 and max(r["count"] for r in held) <= 5_100
