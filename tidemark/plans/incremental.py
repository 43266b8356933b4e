"""Marts that follow deliveries: only the periods that a delivery touches are aggregated anew.

A table of sums per period (a day, or a month where days are small), mart and key stands between the facts and the marts.
Facts and sums are partitioned by period; a delivery replaces its own part of each of its periods (so a delivery that is
sent again changes nothing), the sums of those periods are made again from their facts, and the marts are added up from
the sums of all periods, which are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marts


def _replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that df has rows of; a partition's rows are written by as many tasks as their size asks for."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def deliver(spark: SparkSession, facts: DataFrame, out: str, delivery: str, unit: str = "day") -> list[str]:
    """Adds a delivery of enriched facts (with event_date and suspected_fraud_flag) and brings the sums of its periods up to date.

    Gives the periods, as the text of their first days: one value per period reaches the driver. Facts without a date are a
    period of their own. The unit must be the same for all deliveries of a table.
    """
    period = F.coalesce(F.date_format(F.date_trunc(unit, "event_date"), "yyyy-MM-dd"), F.lit("none"))
    _replace_partitions(facts.withColumns({"period": period, "delivery": F.lit(delivery)}), f"{out}/facts", ["period", "delivery"])
    mine = spark.read.parquet(f"{out}/facts").where(F.col("delivery") == delivery)
    periods = sorted(r["period"] for r in mine.select(F.col("period").cast("string").alias("period")).distinct().collect())
    refresh(spark, out, periods)
    return periods


def facts_of(spark: SparkSession, out: str, periods: list[str]) -> DataFrame:
    """The facts of these periods; the filter is on the partitions, so others' are not read."""
    return spark.read.parquet(f"{out}/facts").where(F.col("period").cast("string").isin(periods))


def refresh(spark: SparkSession, out: str, periods: list[str]) -> None:
    """Makes the sums of these periods again."""
    _replace_partitions(marts.partials(facts_of(spark, out, periods), by=["period"]), f"{out}/sums", ["period"])


def all_sums(spark: SparkSession, out: str) -> DataFrame:
    """The sums over all periods, by mart and key."""
    return marts.merged(spark.read.parquet(f"{out}/sums").drop("period"))


def publish(spark: SparkSession, out: str) -> None:
    """Writes every mart anew from the sums."""
    held = f"{out}/merged"
    all_sums(spark, out).write.mode("overwrite").parquet(held)
    for name in marts.KEYS:
        marts.mart_of(spark.read.parquet(held), name).write.mode("overwrite").parquet(f"{out}/gold/{name}")
