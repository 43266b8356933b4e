"""The test tables as transactions and dimensions: portable arithmetic only, the same in any SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load

CATEGORIES = ["GROCERY", "TRAVEL", "GAMBLING", "CRYPTO", "ELECTRONICS"]
PAYMENTS = ["CARD_PRESENT", "CARD_NOT_PRESENT", "ONLINE_BANKING", "INTL_TRANSFER", "ATM"]
COUNTRIES = 25


def _nth(names: list[str], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))


def dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        (F.col("c_custkey") + 1).alias("customer_id"), F.col("n_name").alias("home_country"), F.col("c_mktsegment").alias("customer_segment"),
        F.when(F.col("c_acctbal") < 0, "HIGH").when(F.col("c_acctbal") < 5000, "MEDIUM").otherwise("LOW").alias("risk_tier"),
        (F.col("c_acctbal") > 8000).alias("is_high_net_worth"), F.lit("VERIFIED").alias("kyc_status"), F.lit("MOBILE").alias("preferred_channel"),
    )


def dim_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("merchant_name"), _nth(CATEGORIES, F.col("s_suppkey")).alias("merchant_category"), F.col("n_name").alias("merchant_country"),
        F.when(F.col("s_acctbal") < 0, "HIGH").when(F.col("s_acctbal") < 5000, "MEDIUM").otherwise("LOW").alias("merchant_risk_level"),
        F.when(F.col("s_suppkey") <= 50, "MEGA").otherwise("SMALL").alias("merchant_size"), (F.col("s_suppkey") % 3 == 0).alias("online_only_flag"),
    )


def dim_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("device_id"), _nth(["MOBILE", "DESKTOP", "TABLET"], F.col("p_partkey")).alias("device_type"), _nth(["IOS", "ANDROID", "WINDOWS", "LINUX"], F.col("p_partkey")).alias("os_type"),
        (F.col("p_size") % 10 == 0).alias("rooted_device_flag"), (F.col("p_size") % 25 == 0).alias("emulator_flag"),
    )


def star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as transactions, as they lie there: numbers only."""
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("merchant_id"), F.col("l_partkey").alias("device_id"), F.col("l_extendedprice").alias("amount"))


def star_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") + 1).alias("customer_id"), F.to_date("o_orderdate").alias("event_date"))


def star_named(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows of lines and orders with what follows from their keys: id, hour, country, payment. The other columns stay."""
    nation, at = load(spark, sf_dir, "nation"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % COUNTRIES
    made = {
        "transaction_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "transaction_hour": (F.col("l_orderkey") % 24).cast("int"),
        "transaction_country": F.col("n_name"), "payment_type": _nth(PAYMENTS, F.col("l_orderkey") + F.col("l_linenumber")),
    }
    return rows.join(nation, at == nation.n_nationkey).withColumns(made).drop("l_orderkey", "l_linenumber", *nation.columns)


def star_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as transactions."""
    rows = star_named(spark, sf_dir, star_lines(spark, sf_dir).join(star_orders(spark, sf_dir), "l_orderkey"))
    columns = ["transaction_id", "customer_id", "merchant_id", "device_id", "event_date", "transaction_hour", "transaction_country", "payment_type", "amount"]
    return rows.select(*columns, F.lit("none").alias("merchant_category"))


#: The same transactions joined to their dimensions, for DuckDB.
STAR_SQL = """
star AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_id, o_custkey + 1 AS customer_id, l_suppkey AS merchant_id, l_partkey AS device_id,
    CAST(o_orderdate AS DATE) AS event_date, CAST(l_orderkey % 24 AS INTEGER) AS transaction_hour, tn.n_name AS transaction_country,
    (['CARD_PRESENT','CARD_NOT_PRESENT','ONLINE_BANKING','INTL_TRANSFER','ATM'])[CAST((l_orderkey + l_linenumber) % 5 + 1 AS INTEGER)] AS payment_type,
    l_extendedprice AS amount, hn.n_name AS home_country, c_mktsegment AS customer_segment,
    CASE WHEN c_acctbal < 0 THEN 'HIGH' WHEN c_acctbal < 5000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
    s_name AS merchant_name, (['GROCERY','TRAVEL','GAMBLING','CRYPTO','ELECTRONICS'])[CAST(s_suppkey % 5 + 1 AS INTEGER)] AS merchant_category, mn.n_name AS merchant_country,
    CASE WHEN s_acctbal < 0 THEN 'HIGH' WHEN s_acctbal < 5000 THEN 'MEDIUM' ELSE 'LOW' END AS merchant_risk_level,
    (['MOBILE','DESKTOP','TABLET'])[CAST(p_partkey % 3 + 1 AS INTEGER)] AS device_type, p_size % 10 = 0 AS rooted_device_flag, p_size % 25 = 0 AS emulator_flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN nation tn ON (l_orderkey * 7 + l_linenumber) % 25 = tn.n_nationkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation hn ON c_nationkey = hn.n_nationkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation mn ON s_nationkey = mn.n_nationkey LEFT JOIN part ON l_partkey = p_partkey),
signals AS (
  SELECT *, coalesce(transaction_country <> home_country, false) AS is_cross_border,
    coalesce(merchant_risk_level = 'HIGH' OR merchant_category IN ('GAMBLING','CRYPTO'), false) AS is_high_risk_merchant,
    coalesce(rooted_device_flag OR emulator_flag, false) AS is_risky_device, payment_type IN ('CARD_NOT_PRESENT','ONLINE_BANKING') AS is_card_not_present,
    transaction_hour >= 0 AND transaction_hour < 6 AS is_nighttime_transaction FROM star),
fact AS (
  SELECT *, is_cross_border OR payment_type = 'INTL_TRANSFER' AS is_international_transaction,
    is_cross_border::INT + is_high_risk_merchant::INT + is_risky_device::INT + is_card_not_present::INT + (is_cross_border OR payment_type = 'INTL_TRANSFER')::INT + is_nighttime_transaction::INT AS risk_signal_count
  FROM signals),
marked AS (SELECT *, CAST(risk_signal_count >= 3 AS INTEGER) AS suspected_fraud_flag FROM fact)
"""


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions of a customer over time, with the flags that features need."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    device = F.col("event_id") * 13 % 7
    hour = F.hour("ts")
    return e.select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("customer_id"), F.col("ts").alias("transaction_ts"), F.to_date("ts").alias("event_date"), F.col("value").alias("amount"), hour.alias("transaction_hour"),
        ((hour >= 0) & (hour < 6)).alias("is_nighttime_transaction"), (F.col("event_id") * 31 % COUNTRIES).alias("transaction_country"), F.col("k").alias("merchant_id"), device.alias("device_id"),
        (F.col("event_id") * 31 % COUNTRIES != F.col("user_id") % COUNTRIES).alias("is_cross_border"), (F.col("k") % 10 == 0).alias("is_high_risk_merchant"), (device == 0).alias("is_risky_device"),
        F.when(F.col("event_type") == "error", "DECLINED").otherwise("APPROVED").alias("transaction_status"), F.when(F.col("k") % 10 == 0, "HIGH").when(F.col("k") % 3 == 0, "MEDIUM").otherwise("LOW").alias("merchant_risk_level"),
        (F.col("event_id") % 2 == 0).alias("card_present_flag"), (F.col("event_id") % 2 == 1).alias("is_card_not_present"), (device == 0).alias("rooted_device_flag"), (F.col("event_id") % 50 == 0).alias("emulator_flag"),
    ).withColumn("is_international_transaction", F.col("is_cross_border")).withColumn(
        "risk_signal_count", sum((F.col(c).cast("int") for c in ("is_high_risk_merchant", "is_risky_device", "is_card_not_present", "is_nighttime_transaction", "is_international_transaction")), F.col("is_cross_border").cast("int"))
    )


EVENTS_SQL = """
tx AS (
  SELECT event_id AS transaction_id, user_id AS customer_id, ts AS transaction_ts, CAST(ts AS DATE) AS event_date, value AS amount, CAST(hour(ts) AS INTEGER) AS transaction_hour, hour(ts) < 6 AS is_nighttime_transaction,
    event_id * 31 % 25 AS transaction_country, CAST(json_extract_string(props, '$.k') AS BIGINT) AS merchant_id, event_id * 13 % 7 AS device_id, event_id * 31 % 25 <> user_id % 25 AS is_cross_border,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 AS is_high_risk_merchant, event_id * 13 % 7 = 0 AS is_risky_device,
    CASE WHEN event_type = 'error' THEN 'DECLINED' ELSE 'APPROVED' END AS transaction_status, CAST(floor(epoch(ts)) AS BIGINT) AS ts_seconds
  FROM events)
"""


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clean bronze rows, before corruption. Strings are untidy on purpose."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select(
        F.col("event_id").alias("transaction_id"), (F.col("user_id") + 1).alias("customer_id"), F.col("k").alias("merchant_id"), F.col("k").alias("device_id"), F.col("ts").alias("transaction_ts"), F.to_date("ts").alias("event_date"),
        F.lit("MOBILE").alias("transaction_channel"), F.lit("CARD_PRESENT").alias("payment_type"), (F.col("event_id") % 2 == 0).alias("card_present_flag"), F.col("value").alias("amount"),
        F.concat(F.lit(" "), _nth(["usd", "eur", "gbp", "chf", "cad", "aud"], F.col("event_id")), F.lit(" ")).alias("currency"), F.concat(F.lit("c"), (F.col("event_id") * 31 % COUNTRIES).cast("string")).alias("transaction_country"),
        _nth(["approved", "Declined ", "PENDING"], F.col("event_id")).alias("transaction_status"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ingestion_ts"),
    )


#: Bronze with defects and duplicates; see operators.corrupt.
DIRTY_SQL = """
labelled AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    coalesce((['null_customer','null_merchant','null_device','null_amount','negative_amount','invalid_currency','future_timestamp','orphan_customer','orphan_merchant','late_event','zero_amount','invalid_status','suspicious_default','null_country'])
      [CAST((event_id * 7919 + 11) % 10000 // 200 + 1 AS INTEGER)], 'clean') AS issue FROM events),
mutated AS (
  SELECT event_id AS transaction_id,
    CASE issue WHEN 'null_customer' THEN NULL WHEN 'suspicious_default' THEN 0 WHEN 'orphan_customer' THEN user_id + 1 + 1000000 ELSE user_id + 1 END AS customer_id,
    CASE issue WHEN 'null_merchant' THEN NULL WHEN 'suspicious_default' THEN -1 WHEN 'orphan_merchant' THEN k + 1000000 ELSE k END AS merchant_id,
    CASE issue WHEN 'null_device' THEN NULL ELSE k END AS device_id,
    CASE issue WHEN 'future_timestamp' THEN ts + INTERVAL 60 DAY ELSE ts END AS transaction_ts,
    CASE issue WHEN 'null_amount' THEN NULL WHEN 'negative_amount' THEN -value WHEN 'zero_amount' THEN 0.0 ELSE value END AS amount,
    CASE issue WHEN 'invalid_currency' THEN 'XXX' ELSE ' ' || (['usd','eur','gbp','chf','cad','aud'])[CAST(event_id % 6 + 1 AS INTEGER)] || ' ' END AS currency,
    CASE issue WHEN 'null_country' THEN NULL WHEN 'suspicious_default' THEN 'UNKNOWN' ELSE 'c' || CAST(event_id * 31 % 25 AS VARCHAR) END AS transaction_country,
    CASE issue WHEN 'invalid_status' THEN 'UNKNOWN_BAD' ELSE (['approved','Declined ','PENDING'])[CAST(event_id % 3 + 1 AS INTEGER)] END AS transaction_status,
    CASE issue WHEN 'late_event' THEN ts + INTERVAL 5 DAY ELSE ts + INTERVAL 5 MINUTE END AS ingestion_ts, issue AS data_quality_issue_type FROM labelled),
bronze AS (
  SELECT * FROM mutated UNION ALL
  SELECT * REPLACE (ingestion_ts + INTERVAL 1 HOUR AS ingestion_ts, 'duplicate' AS data_quality_issue_type) FROM mutated WHERE (transaction_id * 104729 + 7) % 100 < 2),
std AS (
  SELECT * REPLACE (upper(trim(currency)) AS currency, upper(trim(transaction_status)) AS transaction_status, upper(trim(transaction_country)) AS transaction_country), CAST(transaction_ts AS DATE) AS event_date FROM bronze),
flagged AS (
  SELECT s.*, customer_id IS NULL AS is_null_customer, merchant_id IS NULL AS is_null_merchant, device_id IS NULL AS is_null_device, amount IS NULL AS is_null_amount,
    coalesce(customer_id = 0, false) AS is_suspicious_default_customer, coalesce(merchant_id = -1, false) AS is_suspicious_default_merchant,
    amount IS NOT NULL AND amount <= 0 AS is_invalid_amount, currency IS NOT NULL AND currency NOT IN ('USD','EUR','GBP','CHF','CAD','AUD') AS is_invalid_currency,
    transaction_status IS NOT NULL AND transaction_status NOT IN ('APPROVED','DECLINED','PENDING') AS is_invalid_status,
    transaction_ts IS NOT NULL AND transaction_ts > TIMESTAMP '2024-02-15' AS is_future_timestamp,
    ingestion_ts IS NOT NULL AND transaction_ts IS NOT NULL AND ingestion_ts > transaction_ts + INTERVAL 2 DAY AS is_late_arriving,
    customer_id IS NOT NULL AND customer_id <> 0 AND c_custkey IS NULL AS is_orphan_customer, merchant_id IS NOT NULL AND merchant_id <> -1 AND s_suppkey IS NULL AS is_orphan_merchant, device_id IS NOT NULL AND p_partkey IS NULL AS is_orphan_device
  FROM std s LEFT JOIN customer ON customer_id = c_custkey + 1 LEFT JOIN supplier ON merchant_id = s_suppkey LEFT JOIN part ON device_id = p_partkey),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY ingestion_ts DESC NULLS LAST, transaction_ts DESC NULLS LAST) AS dedup_rn, count(transaction_id) OVER (PARTITION BY transaction_id) > 1 AS is_duplicate_candidate FROM flagged),
reasoned AS (
  SELECT *, CASE WHEN dedup_rn > 1 THEN 'duplicate_transaction' WHEN is_null_customer THEN 'null_customer' WHEN is_null_merchant THEN 'null_merchant' WHEN is_null_device THEN 'null_device' WHEN is_null_amount THEN 'null_amount'
    WHEN is_suspicious_default_customer THEN 'suspicious_default_customer' WHEN is_suspicious_default_merchant THEN 'suspicious_default_merchant' WHEN is_orphan_customer THEN 'orphan_customer' WHEN is_orphan_merchant THEN 'orphan_merchant'
    WHEN is_orphan_device THEN 'orphan_device' WHEN is_invalid_amount THEN 'invalid_amount' WHEN is_invalid_currency THEN 'invalid_currency' WHEN is_invalid_status THEN 'invalid_status' WHEN is_future_timestamp THEN 'future_timestamp' END AS quarantine_reason FROM ranked),
clean AS (
  SELECT *, CAST(hour(transaction_ts) AS INTEGER) AS transaction_hour, hour(transaction_ts) < 6 AS is_nighttime_transaction,
    CASE WHEN amount < 10 THEN '<10' WHEN amount < 100 THEN '10-100' WHEN amount < 1000 THEN '100-1K' WHEN amount < 10000 THEN '1K-10K' ELSE '10K+' END AS amount_bucket FROM reasoned WHERE quarantine_reason IS NULL AND dedup_rn = 1)
"""
