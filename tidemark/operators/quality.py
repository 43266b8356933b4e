"""Standardise, validate, deduplicate, quarantine, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import amount_bucket, as_int, column_or, is_night, null_as_false, safe_rate

# What is valid, and the names of reasons and flags.
CURRENCIES = ("USD", "EUR", "GBP", "CHF", "CAD", "AUD")
STATUSES = ("APPROVED", "DECLINED", "PENDING")
NO_CUSTOMER, NO_MERCHANT = 0, -1

#: First match wins.
REASONS = ["duplicate_transaction", "null_customer", "null_merchant", "null_device", "null_amount", "suspicious_default_customer", "suspicious_default_merchant", "orphan_customer", "orphan_merchant", "orphan_device", "invalid_amount", "invalid_currency", "invalid_status", "future_timestamp"]

FLAGS = [f"is_{r}" for r in ("null_customer", "null_merchant", "null_device", "null_amount", "invalid_amount", "invalid_currency", "invalid_status", "future_timestamp", "orphan_customer", "orphan_merchant", "orphan_device", "late_arriving", "suspicious_default_customer", "suspicious_default_merchant")]


def standardize(bronze: DataFrame) -> DataFrame:
    """Trimmed upper-case codes, timestamps as such (those written as text are read, null where they can't be),
    event_date from the transaction's time."""
    kinds = dict(bronze.dtypes)
    bronze = bronze.withColumns({c: F.col(c).try_cast("timestamp") for c in ("transaction_ts", "ingestion_ts") if kinds.get(c) == "string"})
    codes = [c for c in ("currency", "transaction_status", "transaction_country", "transaction_channel", "payment_type") if c in bronze.columns]
    return bronze.withColumns({**{c: F.upper(F.trim(c)) for c in codes}, "event_date": F.to_date("transaction_ts")})


def _known(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Adds _known_<key>. The dimension's keys are one column wide: Spark broadcasts them if their size allows."""
    return rows.join(dim.select(key).distinct().withColumn(f"_known_{key}", F.lit(True)), key, "left")


def with_flags(rows: DataFrame, customers: DataFrame, merchants: DataFrame, devices: DataFrame, as_of: Column) -> DataFrame:
    """Adds FLAGS (never null). Rows stay whatever they lack; as_of is the clock for future timestamps."""
    probed = _known(_known(_known(rows, customers, "customer_id"), merchants, "merchant_id"), devices, "device_id")
    c = F.col
    orphan = lambda key, sentinel=None: null_as_false(c(key).isNotNull() & (F.lit(True) if sentinel is None else c(key) != sentinel) & c(f"_known_{key}").isNull())
    flags = {
        **{f"is_null_{n}": c(k).isNull() for n, k in (("customer", "customer_id"), ("merchant", "merchant_id"), ("device", "device_id"), ("amount", "amount"))},
        "is_suspicious_default_customer": null_as_false(c("customer_id") == NO_CUSTOMER),
        "is_suspicious_default_merchant": null_as_false(c("merchant_id") == NO_MERCHANT),
        "is_invalid_amount": null_as_false(c("amount").isNotNull() & (c("amount") <= 0)),
        "is_invalid_currency": null_as_false(c("currency").isNotNull() & ~c("currency").isin(*CURRENCIES)),
        "is_invalid_status": null_as_false(c("transaction_status").isNotNull() & ~c("transaction_status").isin(*STATUSES)),
        "is_future_timestamp": null_as_false(c("transaction_ts") > as_of),
        "is_late_arriving": null_as_false(c("ingestion_ts") > c("transaction_ts") + F.expr("INTERVAL 2 DAYS")),
        "is_orphan_customer": orphan("customer_id", NO_CUSTOMER),
        "is_orphan_merchant": orphan("merchant_id", NO_MERCHANT),
        "is_orphan_device": orphan("device_id"),
    }
    return probed.withColumns(flags).drop("_known_customer_id", "_known_merchant_id", "_known_device_id")


def with_dedup(rows: DataFrame, key: str = "transaction_id", order: list[Column] = None) -> DataFrame:
    """Adds dedup_rn (1: the latest to arrive) and is_duplicate_candidate (the survivor's too). One shuffle, one sort."""
    order = order or [F.col("ingestion_ts").desc_nulls_last(), F.col("transaction_ts").desc_nulls_last()]
    same = Window.partitionBy(key)
    return rows.select("*", F.row_number().over(same.orderBy(*order)).alias("dedup_rn"), (F.count(key).over(same) > 1).alias("is_duplicate_candidate"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row in this order of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def with_reason(rows: DataFrame) -> DataFrame:
    """Adds quarantine_reason, null for rows without one."""
    out = F.when(F.col("dedup_rn") > 1, REASONS[0])
    for reason in REASONS[1:]:
        out = out.when(F.col(f"is_{reason}"), reason)
    return rows.withColumn("quarantine_reason", out)


def judged(bronze: DataFrame, customers: DataFrame, merchants: DataFrame, devices: DataFrame, as_of: Column) -> DataFrame:
    return with_reason(with_dedup(with_flags(standardize(bronze), customers, merchants, devices, as_of)))


def is_clean() -> Column:
    return F.col("quarantine_reason").isNull() & (F.col("dedup_rn") == 1)


def clean(rows: DataFrame) -> DataFrame:
    """Rows without a reason, with hour, night flag and amount bucket."""
    kept = rows.where(is_clean()).drop("dedup_rn", "quarantine_reason")
    hour = F.hour("transaction_ts")
    return kept.withColumns({"transaction_hour": hour, "is_nighttime_transaction": is_night(hour), "amount_bucket": amount_bucket(F.col("amount"))})


def quarantine(rows: DataFrame, at: Column = None) -> DataFrame:
    return rows.where(F.col("quarantine_reason").isNotNull()).drop("dedup_rn").withColumn("quarantine_ts", F.current_timestamp() if at is None else at)


def _totals() -> list[Column]:
    n = lambda cond: F.coalesce(F.sum(as_int(cond)), F.lit(0)).cast("long")
    bad = F.col("quarantine_reason").isNotNull()
    counts = [n(F.col(f)).alias(f.removeprefix("is_") + "_count") for f in FLAGS]
    return [F.count("*").alias("total_bronze_records"), n(F.col("dedup_rn") > 1).alias("duplicate_records"), n(bad).alias("quarantined_records"), n(~bad & (F.col("dedup_rn") == 1)).alias("clean_records"), *counts]


def _reasons() -> list[Column]:
    return [F.count_if(F.col("quarantine_reason") == r).alias(r) for r in REASONS]


def summary(rows: DataFrame) -> DataFrame:
    """One row: totals and the count of every flag, in one pass."""
    return rows.agg(*_totals())


def observed(rows: DataFrame, counts: Observation) -> DataFrame:
    """rows, whose totals and flag counts are taken by whatever action reads them."""
    return rows.observe(counts, *_totals())


def summary_of(spark: SparkSession, parts: list[dict], read: int) -> DataFrame:
    """The summary's row from the counts taken while its parts were written; they must add up to the rows that were read."""
    total = {k: sum(p[k] for p in parts) for k in parts[0]}
    if total["total_bronze_records"] != read or total["clean_records"] + total["quarantined_records"] != read:
        raise ValueError(f"{read} rows were read, but {total['clean_records']} clean and {total['quarantined_records']} quarantined ones written")
    return spark.createDataFrame([tuple(total.values())], ", ".join(f"{k} long" for k in total))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("quarantine_reason").isNotNull()).groupBy("quarantine_reason").agg(F.count("*").alias("records"))


def reason_pivot(rows: DataFrame) -> DataFrame:
    """One row, a column per reason: the reasons are given, so nothing is scanned to find them, and an empty
    quarantine gives zeros instead of no row."""
    return rows.where(F.col("quarantine_reason").isNotNull()).agg(*_reasons())


def occurring_reasons(quarantined: DataFrame) -> DataFrame:
    """One row with a column per reason that occurs; no columns but the first for an empty quarantine."""
    return quarantined.groupBy(F.lit(1).alias("one")).pivot("quarantine_reason").agg(F.count(F.lit(1)))


def _dashboard(both: DataFrame) -> DataFrame:
    orphans = [column_or(both.columns, f"orphan_{n}", 0) for n in ("customer", "merchant", "device")]
    return both.select(
        "total_bronze_records", "clean_records", "quarantined_records", safe_rate(F.col("quarantined_records"), F.col("total_bronze_records")).alias("quarantine_rate"), F.col("duplicate_records").alias("duplicate_count"),
        "invalid_amount_count", "invalid_currency_count", sum((F.coalesce(o, F.lit(0)) for o in orphans), F.lit(0)).cast("long").alias("orphan_key_count"), "late_arriving_count",
    )


def dashboard(rows: DataFrame) -> DataFrame:
    """The data-quality mart: totals and reasons in one pass over the judged rows."""
    return _dashboard(rows.agg(*_totals(), *_reasons()))


def dashboard_of(summary_row: DataFrame, quarantined: DataFrame) -> DataFrame:
    """The same from stored tables: the summary's one row beside the one row of reasons that occur; others count 0."""
    return _dashboard(summary_row.join(occurring_reasons(quarantined), how="left"))


def sample_per_issue(rows: DataFrame, label: str = "data_quality_issue_type", key: str = "transaction_id") -> DataFrame:
    """The row with the smallest key (then arrival) of each label, without a shuffle of whole rows' windows."""
    picked = rows.groupBy(label).agg(F.min_by(F.struct("*"), F.struct(key, "ingestion_ts")).alias("row"))
    return picked.select("row.*")


def key_bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.agg(*[f(k).alias(f"{n}_{k}") for k in keys for n, f in (("min", F.min), ("max", F.max))])
