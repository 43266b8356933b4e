"""Dimensions and risk signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_int, null_as_false
from ..sources.tables import overwrite, scratch_path

# The risk signals.
SIGNALS = ["is_cross_border", "is_high_risk_merchant", "is_risky_device", "is_card_not_present", "is_international_transaction", "is_nighttime_transaction"]


def enrich(rows: DataFrame, customers: DataFrame, merchants: DataFrame, devices: DataFrame) -> DataFrame:
    """Left joins: no transaction disappears. There is no broadcast hint: Spark knows the sides' sizes and
    takes a shuffle where a dimension is too large to send. Such a shuffle carries all columns of rows: give it few, and make texts from keys after it."""
    return rows.drop("merchant_category").join(customers, "customer_id", "left").join(merchants, "merchant_id", "left").join(devices, "device_id", "left")


def enrich_lines(lines: DataFrame, orders: DataFrame, order_key: str, customers: DataFrame, merchants: DataFrame, devices: DataFrame) -> DataFrame:
    """enrich() for transactions that are lines of orders, a customer each: inner join to the orders, left joins to the dimensions.

    Customers are joined to the orders, which are fewer than the lines; the lines meet devices first, while they are narrow, and merchants last.
    Lines are shuffled twice at most instead of three times, and neither a customer's nor a merchant's texts by device.
    """
    known = lines.join(devices, "device_id", "left").join(orders.join(customers, "customer_id", "left"), order_key)
    return known.join(merchants, "merchant_id", "left")


def hot_keys_of(rows: DataFrame, keys: list[str], share: float = 0.001, error: float = 0.2) -> DataFrame:
    """_of, _key, n: the keys of each column with at least `share` of the rows, at most 1 / share a column. Keys are whole numbers or texts of one type.

    The rows are read twice, whatever the number of columns: a key is a candidate if its hash falls in a heavy bucket of a count sketch of fixed size, and only
    candidates are counted.
    """
    width = int(2 / (share * error))
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("_of"), F.col(f"`{k}`").alias("_key")) for k in keys])).alias("e")).select("e.*").where("_key is not null")
    each = each.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(width)))
    sketch = each.groupBy("_of", "_bucket").agg(F.count("*").alias("n"))  # `width` rows a column at most
    whole = Window.partitionBy("_of")
    heavy = sketch.withColumn("total", F.sum("n").over(whole)).where(F.col("n") >= share * F.col("total")).select("_of", "_bucket", "total")
    counted = each.join(F.broadcast(heavy), ["_of", "_bucket"]).groupBy("_of", "_key", "total").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= share * F.col("total")).select("_of", "_key", "n")


def hot_keys(rows: DataFrame, key: str, share: float = 0.001, error: float = 0.2) -> DataFrame:
    """Keys with at least `share` of the rows: at most 1 / share of them."""
    return hot_keys_of(rows, [key], share, error).select(F.col("_key").alias(key), "n")


def skewed_join(rows: DataFrame, dim: DataFrame, key: str, hot: DataFrame, per_task: int = 100_000) -> DataFrame:
    """rows left join dim where few keys have very many rows and dim may be too large to send.

    A hot key (hot has key and n) is dealt in n / per_task salts: its rows by a hash of theirs, its one dimension row to each salt.
    Other keys have one salt, and only hot dimension rows are copied. Null keys meet nothing and are spread too.
    """
    salted = hot.select(F.col(key), F.greatest(F.ceil(F.col("n") / per_task), F.lit(1)).cast("int").alias("_salts"))
    spread = lambda df: df.join(F.broadcast(salted), key, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col("_salts")).cast("int")
    left = spread(rows).withColumn("_salt", F.when(F.col(key).isNull(), F.lit(0)).otherwise(place)).drop("_salts")
    right = spread(dim).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def enrich_skewed(rows: DataFrame, customers: DataFrame, merchants: DataFrame, devices: DataFrame, share: float = 0.001, per_task: int = 100_000) -> DataFrame:
    """enrich() for dimensions of any size and keys of any frequency.

    What the rows' plan makes (joins, say) is made once: the rows are written, and so are the hot keys of all dimensions, which are few. Rows should have no
    texts yet: the joins shuffle all columns.
    """
    spark, path, dims = rows.sparkSession, scratch_path(rows.sparkSession, "skewed"), {"customer_id": customers, "merchant_id": merchants, "device_id": devices}
    overwrite(rows.drop("merchant_category"), f"{path}/rows")
    out = held = spark.read.parquet(f"{path}/rows")
    overwrite(hot_keys_of(held, list(dims), share), f"{path}/hot")
    hot = spark.read.parquet(f"{path}/hot")
    for key, dim in dims.items():
        out = skewed_join(out, dim, key, hot.where(F.col("_of") == key).select(F.col("_key").alias(key), "n"), per_task)
    return out


def with_signals(rows: DataFrame) -> DataFrame:
    c = F.col
    abroad = null_as_false(c("transaction_country") != c("home_country"))
    flagged = rows.withColumns(
        {
            "is_cross_border": abroad,
            "is_high_risk_merchant": null_as_false((c("merchant_risk_level") == "HIGH") | c("merchant_category").isin("GAMBLING", "CRYPTO")),
            "is_risky_device": null_as_false(c("rooted_device_flag") | c("emulator_flag")),
            "is_card_not_present": c("payment_type").isin("CARD_NOT_PRESENT", "ONLINE_BANKING"),
            "is_international_transaction": abroad | (c("payment_type") == "INTL_TRANSFER"),
        }
    )
    total = as_int(SIGNALS[0])
    for s in SIGNALS[1:]:
        total = total + as_int(s)
    return flagged.withColumn("risk_signal_count", total)


def with_suspected(rows: DataFrame, least: int = 3) -> DataFrame:
    """suspected_fraud_flag: the label where there is one, else by the number of signals."""
    flag = F.col("fraud_label").cast("int") if "fraud_label" in rows.columns else as_int(F.col("risk_signal_count") >= least)
    return rows.withColumn("suspected_fraud_flag", flag)
