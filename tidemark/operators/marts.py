"""Pre-aggregated marts over suspected transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import exact_round, safe_rate


def kpis() -> list[Column]:
    suspected = F.col("suspected_fraud_flag")
    return [
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(suspected).cast("long").alias("suspected_fraud_transactions"),
        exact_round(F.sum("amount"), 2).alias("total_amount"),
        exact_round(F.sum(F.when(suspected == 1, F.col("amount")).otherwise(0.0)), 2).alias("suspected_fraud_amount"),
    ]


def mart(fact: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The KPI block per key, with fraud_rate. Partial sums are made before the one shuffle."""
    rate = safe_rate(F.col("suspected_fraud_transactions"), F.col("total_transactions")).alias("fraud_rate")
    return fact.groupBy(*keys).agg(*kpis(), *more).select("*", rate)


def by_country(fact: DataFrame) -> DataFrame:
    return mart(fact, ["transaction_country"]).withColumn("fraud_amount_rate", safe_rate(F.col("suspected_fraud_amount"), F.col("total_amount")))


def by_category(fact: DataFrame) -> DataFrame:
    return mart(fact, ["merchant_category"])


# The columns of the marts.
MERCHANT = ["merchant_id", "merchant_name", "merchant_category", "merchant_country", "merchant_risk_level"]


def top_merchants(fact: DataFrame, least: int = 50) -> DataFrame:
    """Merchants of at least `least` transactions, riskiest first (ties by id)."""
    return mart(fact, MERCHANT).where(F.col("total_transactions") >= least).orderBy(F.desc("suspected_fraud_amount"), F.desc("fraud_rate"), "merchant_id")


def top_merchants_salted(fact: DataFrame, least: int = 50, salts: int = 16) -> DataFrame:
    """top_merchants in two levels, for merchants with very many rows and aggregates that can't be made partial."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum("suspected_fraud_flag").alias("s"), F.sum("amount").alias("a"), F.sum(F.when(F.col("suspected_fraud_flag") == 1, F.col("amount")).otherwise(0.0)).alias("x")]
    parts = fact.withColumn("_salt", F.pmod(F.xxhash64("transaction_id"), F.lit(salts))).groupBy(*MERCHANT, "_salt").agg(*sums)
    whole = parts.groupBy(*MERCHANT).agg(F.sum("n").alias("total_transactions"), F.sum("s").cast("long").alias("suspected_fraud_transactions"), exact_round(F.sum("a"), 2).alias("total_amount"), exact_round(F.sum("x"), 2).alias("suspected_fraud_amount"))
    return whole.where(F.col("total_transactions") >= least).withColumn("fraud_rate", safe_rate(F.col("suspected_fraud_transactions"), F.col("total_transactions")))


def by_hour(fact: DataFrame) -> DataFrame:
    return mart(fact, ["transaction_hour"]).orderBy("transaction_hour")


def corridor(fact: DataFrame) -> DataFrame:
    return mart(fact, ["home_country", "transaction_country"], F.sum(F.col("is_cross_border").cast("int")).cast("long").alias("cross_border_transactions"))


def device_profile(fact: DataFrame) -> DataFrame:
    return mart(fact, ["device_type", "rooted_device_flag", "emulator_flag"])


def daily(fact: DataFrame) -> DataFrame:
    return mart(fact.withColumnRenamed("event_date", "transaction_date"), ["transaction_date"]).orderBy("transaction_date")


# ---------------------------------------------------------------- all marts from one aggregate

#: The keys of each mart.
KEYS = {
    "by_country": ["transaction_country"], "by_category": ["merchant_category"], "top_merchants": MERCHANT, "by_hour": ["transaction_hour"],
    "corridor": ["home_country", "transaction_country"], "device_profile": ["device_type", "rooted_device_flag", "emulator_flag"], "daily": ["transaction_date"],
}
_EXACT = "decimal(28,10)"
_SUMS = ["n", "suspected", "amount", "suspected_amount", "abroad"]


def partials(fact: DataFrame, by: list[str] = ()) -> DataFrame:
    """mart, `by`, the keys of all marts (null but for the mart's own) and sums that can be added up, by one aggregate over grouping sets.

    The fact table is read once for all marts; each row meets the partial aggregate once a mart, and one shuffle follows. Money is summed
    in decimals, so that sums don't depend on the order in which parts are added.
    """
    rows = fact.withColumn("transaction_date", F.col("event_date"))
    columns = [*by, *dict.fromkeys(c for keys in KEYS.values() for c in keys)]
    money = lambda x: F.coalesce(F.sum(x.cast(_EXACT)), F.lit(0)).cast(_EXACT)
    suspected = F.col("suspected_fraud_flag") == 1
    sums = [F.count(F.lit(1)), F.sum(F.col("suspected_fraud_flag")).cast("long"), money(F.col("amount")), money(F.when(suspected, F.col("amount")).otherwise(0.0)), F.sum(F.col("is_cross_border").cast("int")).cast("long")]
    sets = [[F.col(c) for c in (*by, *keys)] for keys in KEYS.values()]
    grouped = rows.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id(*[F.col(c) for c in columns]).alias("_set"), *[s.alias(f"_{k}") for s, k in zip(sums, _SUMS)])
    number = lambda keys: sum(0 if c in keys or c in by else 1 << (len(columns) - 1 - i) for i, c in enumerate(columns))
    name = F.coalesce(*[F.when(F.col("_set") == number(keys), m) for m, keys in KEYS.items()])
    return grouped.select(name.alias("mart"), *columns, *[F.col(f"_{k}") for k in _SUMS])


def merged(parts: DataFrame) -> DataFrame:
    """Partial sums of several tables, days or deliveries added up by key."""
    columns = list(dict.fromkeys(c for keys in KEYS.values() for c in keys))
    add = lambda k: F.sum(f"_{k}").cast(parts.schema[f"_{k}"].dataType).alias(f"_{k}")
    return parts.groupBy("mart", *columns).agg(*map(add, _SUMS))


def mart_of(parts: DataFrame, mart: str, least: int = 50) -> DataFrame:
    """A mart from the sums of all: what its own aggregate gives."""
    c = F.col
    done = parts.where(c("mart") == mart).select(
        *KEYS[mart], c("_n").alias("total_transactions"), c("_suspected").alias("suspected_fraud_transactions"), exact_round(c("_amount"), 2).alias("total_amount"), exact_round(c("_suspected_amount"), 2).alias("suspected_fraud_amount"),
        *([c("_abroad").alias("cross_border_transactions")] if mart == "corridor" else []), safe_rate(c("_suspected"), c("_n")).alias("fraud_rate"),
    )
    if mart == "by_country":
        return done.withColumn("fraud_amount_rate", safe_rate(c("suspected_fraud_amount"), c("total_amount")))
    if mart == "top_merchants":
        return done.where(c("total_transactions") >= least).orderBy(F.desc("suspected_fraud_amount"), F.desc("fraud_rate"), "merchant_id")
    return done


# The columns of the detail table.
BI_COLUMNS = ["transaction_id", "event_date", "transaction_hour", "transaction_country", "home_country", *MERCHANT, "device_id", "device_type", "rooted_device_flag", "emulator_flag", "customer_segment", "amount", "amount_bucket", "is_cross_border", "is_high_risk_merchant", "is_risky_device", "is_card_not_present", "is_international_transaction", "is_nighttime_transaction", "risk_signal_count", "suspected_fraud_flag"]


def bi_projection(fact: DataFrame) -> DataFrame:
    return fact.select(*BI_COLUMNS).withColumnRenamed("event_date", "transaction_date")
