"""The whole run: bronze, silver, gold, features. Each layer is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, features, marts, quality
from ..sources.tables import overwrite, side_session


def silver(spark: SparkSession, bronze: DataFrame, dims: dict[str, DataFrame], out: str, as_of: Column) -> None:
    """Clean, quarantine, enriched and summary tables. The judged rows are written once; the summary is counted while the clean
    and quarantined ones are written, without a scan of its own, and must add up to what was judged."""
    known = [dims[d] for d in ("customer", "merchant", "device")]
    quality.judged(bronze, *known, as_of).write.mode("overwrite").parquet(f"{out}/judged")
    overwrite(split_observed(spark, f"{out}/judged", out, as_of), f"{out}/summary")
    overwrite(quality.dashboard_of(spark.read.parquet(f"{out}/summary"), spark.read.parquet(f"{out}/quarantine")), f"{out}/dashboard")
    clean = spark.read.parquet(f"{out}/clean")
    overwrite(enrich.with_signals(enrich.enrich(clean, *known)), f"{out}/enriched", ["event_date"])


def split_observed(spark: SparkSession, judged: str, out: str, as_of: Column) -> DataFrame:
    """Writes the clean and the quarantined rows of a judged table; the summary's row, from counts taken on the way."""
    kept, bad = Observation("clean"), Observation("quarantine")
    rows = side_session(spark).read.parquet(judged)
    overwrite(quality.clean(quality.observed(rows.where(quality.is_clean()), kept)), f"{out}/clean", ["event_date"])
    overwrite(quality.quarantine(quality.observed(rows.where(~quality.is_clean()), bad), as_of), f"{out}/quarantine")
    return quality.summary_of(spark, [kept.get, bad.get], spark.read.parquet(judged).count())  # the count stands in the files' footers


def gold(spark: SparkSession, out: str) -> None:
    """All marts from one scan of the enriched table: its sums by the keys of all are written once, each mart is cut from those."""
    fact = enrich.with_suspected(spark.read.parquet(f"{out}/enriched"))
    overwrite(marts.partials(fact), f"{out}/gold/partials", ["mart"])
    parts = spark.read.parquet(f"{out}/gold/partials")
    for name in marts.KEYS:
        overwrite(marts.mart_of(parts, name), f"{out}/gold/{name}")


def feature_layer(spark: SparkSession, out: str, labels: DataFrame | None = None) -> None:
    labels = labels if labels is not None else spark.createDataFrame([], "transaction_id long, fraud_label int")
    overwrite(features.feature_table(spark.read.parquet(f"{out}/enriched"), labels), f"{out}/features", ["event_date"])


def run(spark: SparkSession, bronze: DataFrame, dims: dict[str, DataFrame], out: str, as_of: Column = None) -> None:
    silver(spark, bronze, dims, out, F.current_timestamp() if as_of is None else as_of)
    gold(spark, out)
    feature_layer(spark, out)
