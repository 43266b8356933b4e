"""Training, evaluation and scoring with Spark ML."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
PER_TASK = 200_000  # training rows of a partition; a forest of 100 trees keeps some 600 bytes for each
# The candidates for the model's inputs; those that a table lacks are left out.
CATEGORICAL = ["merchant_risk_level", "amount_bucket", "transaction_country", "customer_segment", "transaction_channel"]
NOT_ENCODED = {"transaction_country"}
NUMERIC = ["amount", "txn_count_1h", "txn_count_24h", "txn_count_7d", "avg_amount_7d", "avg_amount_30d", "amount_vs_avg_ratio", "distinct_countries_7d", "high_risk_merchant_ratio_30d", "distinct_merchants_30d", "distinct_devices_30d", "risky_device_ratio_30d", "nighttime_txn_ratio_30d", "declined_txn_ratio_7d", "risk_signal_count"]
BOOLEAN = ["is_nighttime_transaction", "is_cross_border", "is_international_transaction", "card_present_flag", "is_card_not_present", "rooted_device_flag", "emulator_flag"]


def prepare(features: DataFrame, label: str = "fraud_label") -> DataFrame:
    """Rows that can be trained on; booleans as int, categories without nulls, in one select."""
    rows = features.where(F.col(label).isNotNull() & F.col("transaction_id").isNotNull() & F.col("customer_id").isNotNull() & F.col("amount").isNotNull())
    made = {c: F.col(c).cast("int") for c in BOOLEAN if c in rows.columns}
    made |= {c: F.coalesce(F.col(c), F.lit("UNKNOWN")) for c in CATEGORICAL if c in rows.columns}
    made |= {c: F.col(c).cast("double") for c in NUMERIC if c in rows.columns}
    return rows.withColumns({**made, label: F.col(label).cast("double")})


def split(rows: DataFrame, train_percent: int = 80, key: str = "transaction_id", bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the key, of any type: the same rows whatever the layout of the table. bucket, 0 to 99,
    takes the hash's place where another engine must find the same rows."""
    part = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(100)) if bucket is None else bucket
    return rows.where(part < train_percent), rows.where(part >= train_percent)


def weighted(rows: DataFrame, label: str = "fraud_label") -> DataFrame:
    """Adds class_weight, all rows over twice the label's.

    The joined side has a row per class and is sent to the rows: dealt by the label, all rows of a class would be one task's.
    (Spark finds that side's size too late, and then keeps the shuffle as it has left nearly all partitions empty.)
    """
    counts = rows.groupBy(label).count()
    total = rows.agg(F.count("*")).scalar()
    return rows.join(F.broadcast(counts.select(label, (total / (2 * F.col("count"))).alias("class_weight"))), label)


def stages(columns: list[str]) -> list:
    categories, numbers, flags = ([c for c in group if c in columns] for group in (CATEGORICAL, NUMERIC, BOOLEAN))
    encoded = [c for c in categories if c not in NOT_ENCODED]
    out = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}_imp" for c in numbers])]
    if categories:
        out.append(StringIndexer(inputCols=categories, outputCols=[f"{c}_idx" for c in categories], handleInvalid="keep"))
    if encoded:
        out.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in encoded], outputCols=[f"{c}_ohe" for c in encoded], handleInvalid="keep"))
    inputs = [*(f"{c}_imp" for c in numbers), *flags, *(f"{c}_ohe" for c in encoded), *(f"{c}_idx" for c in categories if c in NOT_ENCODED)]
    return [*out, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]


def logistic_regression() -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="fraud_label", weightCol="class_weight", maxIter=50, regParam=0.01, elasticNetParam=0.0)


def random_forest(trees: int = 100, depth: int = 8) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="fraud_label", weightCol="class_weight", numTrees=trees, maxDepth=depth, subsamplingRate=0.8, featureSubsetStrategy="sqrt", seed=SEED)


def spread(rows: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """rows dealt evenly in partitions of at most about per_task: learners keep each partition's rows, blown up, and read them whole each time."""
    return rows.repartition(max(math.ceil(rows.count() / per_task), rows.sparkSession.sparkContext.defaultParallelism))


def fit_all(train: DataFrame, estimators: list, per_task: int = PER_TASK) -> list[PipelineModel]:
    """A model per estimator; the rows are spread and kept once for all passes of all learners."""
    held = spread(train, per_task).persist()
    try:
        return [Pipeline(stages=[*stages(train.columns), e]).fit(held) for e in estimators]
    finally:
        held.unpersist()


def fit(train: DataFrame, estimator) -> PipelineModel:
    return fit_all(train, [estimator])[0]


def scores(rows: DataFrame, forest: PipelineModel, linear: PipelineModel) -> DataFrame:
    """Both models' verdicts in one pass over the rows, instead of a join of two scored tables."""
    keep = ["transaction_id", "customer_id", "transaction_ts", "event_date", "amount", "fraud_label"]
    p = lambda name: F.try_element_at(vector_to_array("probability"), F.lit(2)).alias(name)
    base = rows.columns
    first = forest.transform(rows).select(*base, F.col("prediction").alias("rf_prediction"), p("rf_fraud_score"))
    both = linear.transform(first).select(*keep, "rf_prediction", "rf_fraud_score", F.col("prediction").alias("lr_prediction"), p("lr_fraud_score"))
    return both


def metrics(model_name: str, scored: DataFrame, label: str = "fraud_label") -> dict:
    """AUC, AUPRC, and precision, recall and F1 weighted over classes; AUCs are None where there is one class.

    The evaluators pass over the scores one after the other, so what they need is kept meanwhile.
    """
    kept = scored.select(label, "rawPrediction", "prediction").persist()
    try:
        single = len(kept.select(label).distinct().limit(2).collect()) < 2
        area = lambda m: None if single else BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName=m).evaluate(kept)
        multi = lambda m: MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName=m).evaluate(kept)
        return {"model_name": model_name, "auc": area("areaUnderROC"), "auprc": area("areaUnderPR"), "precision": multi("weightedPrecision"), "recall": multi("weightedRecall"), "f1": multi("f1")}
    finally:
        kept.unpersist()


METRICS_DDL = "model_name string, auc double, auprc double, precision double, recall double, f1 double"


def metrics_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in METRICS_DDL.split(", ")) for r in rows], METRICS_DDL)


def confusion(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """label, predicted_0, predicted_1."""
    return scored.groupBy(label).agg(F.count_if(F.col(prediction) == 0).alias("predicted_0"), F.count_if(F.col(prediction) == 1).alias("predicted_1"))


def importance(spark: SparkSession, model: PipelineModel, scored: DataFrame) -> DataFrame:
    """feature, importance by the names in the vector's metadata, so that encoded slots have their own names."""
    attrs = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(names[i], float(v)) for i, v in enumerate(values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
