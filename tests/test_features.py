from conftest import TINY
from pyspark.sql import functions as F
from tidemark.operators import features
from tidemark.sources import fixtures as fx

SCHEMA = "transaction_id long, customer_id long, transaction_ts timestamp, amount double, transaction_country string, merchant_id long, device_id long, transaction_status string"


def small(spark, rows):
    from datetime import datetime, timedelta, timezone

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(i, c, None if s is None else start + timedelta(seconds=s), a, "US", i, i, "DECLINED") for i, c, s, a in rows], SCHEMA)
    return df.withColumns({f: F.lit(True) for f in ("is_cross_border", "is_high_risk_merchant", "is_risky_device", "is_nighttime_transaction")})


def test_frames_see_only_the_past(spark):
    got = {r["transaction_id"]: r for r in features.behaviour(small(spark, [(1, 1, 0, 10.0), (2, 1, 0, 20.0), (3, 1, 3600, 30.0), (4, 1, 3601, 0.0), (5, 2, 10, 1.0), (6, 1, None, 1.0)])).collect()}
    assert set(got) == {1, 2, 3, 4, 5}  # no time, no features
    assert got[1]["txn_count_1h"] == got[2]["txn_count_1h"] == 0  # the same second is not past
    assert got[3]["txn_count_1h"] == 2 and got[4]["txn_count_1h"] == 1  # 3601 s ago is out
    assert got[3]["avg_amount_30d"] == 15.0 and got[3]["amount_vs_avg_ratio"] == 2.0
    assert got[5]["avg_amount_30d"] is None and got[5]["declined_txn_ratio_7d"] is None and got[5]["distinct_devices_30d"] == 0
    assert got[4]["declined_txn_ratio_7d"] == 1.0


def test_later_rows_change_nothing(spark):
    tx = fx.event_transactions(spark, TINY)
    cut = "transaction_ts < TIMESTAMP '2024-01-15'"
    whole = features.behaviour(tx).where(cut).select("transaction_id", *features.COUNTS, *features.SPEND, *features.RATIOS)
    early = features.behaviour(tx.where(cut)).select(whole.columns)
    assert whole.exceptAll(early).count() == 0 == early.exceptAll(whole).count()


def test_ranges(spark):
    f = features.behaviour(fx.event_transactions(spark, TINY))
    assert f.where("txn_count_1h > txn_count_24h OR txn_count_24h > txn_count_7d").count() == 0
    assert f.where(" OR ".join(f"{c} NOT BETWEEN 0 AND 1" for c in features.RATIOS)).count() == 0


def test_one_shuffle(spark):
    plan = features.behaviour(fx.event_transactions(spark, TINY))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_customers_dealt_by_month_have_the_same_features(spark):
    import random

    rng = random.Random(3)
    day = 86_400
    rows = [(i, 1 if rng.random() < 0.8 else rng.randrange(2, 5), rng.choice([rng.randrange(200 * day), 30 * day * rng.randrange(6) + rng.choice([-1, 0, 1])]), float(rng.randrange(1, 500))) for i in range(1, 400)]
    df = small(spark, [(i, c, max(s, 0), a) for i, c, s, a in rows] + [(900, 1, None, 1.0), (901, None, 5, 1.0), (902, None, 9, 1.0)])
    whole, dealt = features.behaviour(df), features.behaviour(df, by_month=True)
    assert whole.columns == dealt.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, dealt.collect()))
