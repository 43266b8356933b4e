from pyspark.sql import functions as F
from tidemark.operators import generate
from tidemark.plans import medallion
from tidemark.streaming import live

SIZES = generate.Sizes(customers=200, merchants=100, devices=200, transactions=3000)


def test_star_schema_and_medallion(spark, tmp_path):
    dims = {"customer": generate.dim_customer(spark, SIZES), "merchant": generate.dim_merchant(spark, SIZES), "device": generate.dim_device(spark, SIZES)}
    fact = generate.fact_transactions(spark, SIZES)
    b = fact.agg(F.min("customer_id"), F.max("customer_id"), F.min("amount"), F.max("amount")).first()
    assert 1 <= b[0] and b[1] <= 200 and b[2] >= 1 and b[3] <= 10_000
    hot = fact.where("merchant_id <= 50").count() / fact.count()
    assert 0.5 < hot < 0.6  # half of the rest and a tenth on top
    bronze = generate.bronze_dirty(fact)
    bronze.write.parquet(f"file://{tmp_path}/bronze")
    bronze = spark.read.parquet(f"file://{tmp_path}/bronze")
    out = f"file://{tmp_path}/lake"
    medallion.run(spark, bronze, dims, out, F.lit("2026-06-01").cast("timestamp"))
    s = spark.read.parquet(f"{out}/summary").first()
    clean = spark.read.parquet(f"{out}/clean").count()
    assert s["total_bronze_records"] == bronze.count() == clean + spark.read.parquet(f"{out}/quarantine").count()
    assert spark.read.parquet(f"{out}/enriched").count() == clean == spark.read.parquet(f"{out}/features").count()
    assert len(spark.read.parquet(f"{out}/features").columns) == 31
    assert spark.read.parquet(f"{out}/gold/by_hour").agg(F.sum("total_transactions")).first()[0] == clean


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "2024-01-01 00:10:00", 5.0), (1, 1, "2024-01-01 00:10:00", 5.0), (2, 1, "2024-01-01 00:50:00", 7.0)], "transaction_id long, customer_id long, t string, amount double")
    rows = rows.withColumn("transaction_ts", F.to_timestamp("t")).withColumn("ingestion_ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    asked = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    asked(live.first_arrivals(stream), "firsts", "append")
    assert spark.table("firsts").count() == 2
    asked(live.windowed_velocity(stream), "velocity", "complete")
    assert spark.table("velocity").first()["txn_count"] == 3
