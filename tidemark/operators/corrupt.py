"""Controlled defects: labels, mutated columns, duplicate copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels of the defects and their shares.
ISSUES = ["null_customer", "null_merchant", "null_device", "null_amount", "negative_amount", "invalid_currency", "future_timestamp", "orphan_customer", "orphan_merchant", "late_event", "zero_amount", "invalid_status", "suspicious_default", "null_country"]

#: Shares of 10,000 in the generated data, in the order of ISSUES.
GENERATED_WIDTHS = [20, 20, 20, 30, 30, 20, 20, 20, 20, 50, 10, 20, 20, 20]


def portable_bucket(id_col: str = "transaction_id") -> Column:
    """0 to 9999, the same in any engine."""
    return (F.col(id_col) * 7919 + 11) % 10000


def hashed_bucket(id_col: str = "transaction_id") -> Column:
    return F.pmod(F.hash(F.col(id_col), F.lit("issue")), F.lit(10000))


def issue_label(bucket: Column, widths: list[int]) -> Column:
    """The issue whose range of buckets holds the row; ranges are disjoint and start at 0; the rest is clean."""
    out, low = F.lit("clean"), sum(widths)
    for name, width in reversed(list(zip(ISSUES, widths))):
        low -= width
        out = F.when((bucket >= low) & (bucket < low + width), name).otherwise(out)
    return out


def corrupt(clean: DataFrame, bucket: Column, widths: list[int], late_days: Column = None, future_days: Column = None, far: int = 1_000_000) -> DataFrame:
    """Adds data_quality_issue_type and mutates the columns that each label names."""
    days = lambda c, n: F.make_dt_interval(F.lit(n) if c is None else c)
    labelled = clean.withColumn("data_quality_issue_type", issue_label(bucket, widths))
    on = lambda label: F.col("data_quality_issue_type") == label
    late, future = days(late_days, 5), days(future_days, 60)
    return labelled.withColumns(
        {
            "customer_id": F.when(on("null_customer"), None).when(on("suspicious_default"), 0).when(on("orphan_customer"), F.col("customer_id") + far).otherwise(F.col("customer_id")).cast("long"),
            "merchant_id": F.when(on("null_merchant"), None).when(on("suspicious_default"), -1).when(on("orphan_merchant"), F.col("merchant_id") + far).otherwise(F.col("merchant_id")).cast("long"),
            "device_id": F.when(~on("null_device"), F.col("device_id")).cast("long"),
            "transaction_country": F.when(on("null_country"), None).when(on("suspicious_default"), "UNKNOWN").otherwise(F.col("transaction_country")),
            "amount": F.when(on("null_amount"), None).when(on("negative_amount"), -F.col("amount")).when(on("zero_amount"), 0.0).otherwise(F.col("amount")),
            "currency": F.when(on("invalid_currency"), "XXX").otherwise(F.col("currency")),
            "transaction_status": F.when(on("invalid_status"), "UNKNOWN_BAD").otherwise(F.col("transaction_status")),
            "ingestion_ts": F.when(on("late_event"), F.col("transaction_ts") + late).otherwise(F.col("ingestion_ts")),
            "transaction_ts": F.when(on("future_timestamp"), F.col("transaction_ts") + future).otherwise(F.col("transaction_ts")),
        }
    )


def with_duplicates(rows: DataFrame, chosen: Column, delay: Column) -> DataFrame:
    """rows and a later copy of the chosen ones, labelled duplicate."""
    copies = rows.where(chosen).withColumn("data_quality_issue_type", F.lit("duplicate")).withColumn("ingestion_ts", F.col("ingestion_ts") + delay)
    return rows.unionByName(copies)


def portable_bronze(clean: DataFrame) -> DataFrame:
    """Every label on 2 % of rows, copies of 2 %, by arithmetic on the id."""
    dirty = corrupt(clean, portable_bucket(), [200] * len(ISSUES))
    return with_duplicates(dirty, (F.col("transaction_id") * 104729 + 7) % 100 < 2, F.expr("INTERVAL 1 HOUR"))
