import pytest
from conftest import TINY
from pyspark.sql import functions as F
from tidemark.operators import corrupt, quality
from tidemark.sources import fixtures as fx

AS_OF = F.lit


@pytest.fixture(scope="module")
def judged(spark):
    bronze = corrupt.portable_bronze(fx.dirty_transactions(spark, TINY))
    # all keys known, so that only injected orphans are orphans
    known = lambda key: bronze.where("data_quality_issue_type = 'clean'").select(key)
    return quality.judged(bronze, known("customer_id"), known("merchant_id"), known("device_id"), F.lit("2024-02-15").cast("timestamp_ntz")).cache()


def test_every_row_has_one_fate(judged):
    s = quality.summary(judged).first()
    assert s["total_bronze_records"] == s["clean_records"] + s["quarantined_records"] == judged.count()
    assert s["duplicate_records"] == judged.where("dedup_rn > 1").count()


def test_injected_labels_reach_their_reason(judged):
    same = ["null_customer", "null_merchant", "null_device", "null_amount", "orphan_customer", "orphan_merchant", "invalid_currency", "invalid_status", "future_timestamp"]
    wanted = {**{x: x for x in same}, "negative_amount": "invalid_amount", "zero_amount": "invalid_amount", "suspicious_default": "suspicious_default_customer", "late_event": None, "null_country": None, "clean": None}
    rows = judged.where("dedup_rn = 1 AND data_quality_issue_type <> 'duplicate'").select("data_quality_issue_type", "quarantine_reason").distinct().collect()
    assert {(r[0], r[1]) for r in rows} == set(wanted.items())


def test_the_later_copy_survives(judged):
    assert judged.where("data_quality_issue_type = 'duplicate' AND dedup_rn > 1").count() == 0
    assert judged.where("is_duplicate_candidate").count() == 2 * judged.where("data_quality_issue_type = 'duplicate'").count()


def test_rare_flags_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 5, -1, 9, 1.0, "USD", "approved", None, None)], "transaction_id long, customer_id long, merchant_id long, device_id long, amount double, currency string, transaction_status string, transaction_ts timestamp_ntz, ingestion_ts timestamp_ntz").withColumn("transaction_country", F.lit(" us "))
    ids = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} long")
    now = F.lit("2024-02-15").cast("timestamp_ntz")
    r = quality.judged(rows, ids("customer_id", 5), ids("merchant_id", 1), ids("device_id", 1), now).first()
    assert r["is_suspicious_default_merchant"] and r["is_orphan_device"] and not r["is_orphan_merchant"]
    assert r["quarantine_reason"] == "suspicious_default_merchant" and r["transaction_country"] == "US" and r["is_future_timestamp"] is False
    empty = quality.judged(rows.limit(0), ids("customer_id"), ids("merchant_id"), ids("device_id"), now)
    d = quality.dashboard(empty).first()
    assert d["total_bronze_records"] == 0 and d["orphan_key_count"] == 0 and d["quarantine_rate"] is None


def test_timestamps_written_as_text(spark):
    rows = spark.createDataFrame([(1, "2024-01-05 10:00:00", "2024-01-09 10:00:00"), (2, "soon", None)], "transaction_id long, transaction_ts string, ingestion_ts string")
    got = quality.standardize(rows)
    assert dict(got.dtypes)["transaction_ts"] == dict(got.dtypes)["ingestion_ts"] == "timestamp"
    first, second = got.orderBy("transaction_id").collect()
    assert str(first["event_date"]) == "2024-01-05" and first["ingestion_ts"] > first["transaction_ts"]
    assert second["transaction_ts"] is None and second["event_date"] is None


def test_stored_dashboard_of_an_empty_quarantine(judged):
    good = judged.where("quarantine_reason is null")
    d = quality.dashboard_of(quality.summary(good), quality.quarantine(good)).first()
    assert d["orphan_key_count"] == 0 and d["total_bronze_records"] == good.count() and d["quarantined_records"] == 0
