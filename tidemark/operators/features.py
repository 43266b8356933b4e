"""Behaviour of a customer before each transaction: past-only range windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_int, epoch_seconds, exact_round, safe_ratio

HOUR, DAY, WEEK, MONTH = 3600, 86_400, 7 * 86_400, 30 * 86_400

# The columns of the feature table.
COUNTS = ["txn_count_1h", "txn_count_24h", "txn_count_7d"]
SPEND = ["avg_amount_7d", "avg_amount_30d", "max_amount_30d", "amount_vs_avg_ratio"]
DISTINCT = ["distinct_countries_7d", "distinct_merchants_30d", "distinct_devices_30d"]
RATIOS = ["cross_border_txn_ratio_30d", "high_risk_merchant_ratio_30d", "risky_device_ratio_30d", "nighttime_txn_ratio_30d", "declined_txn_ratio_7d"]

BASIC = ["transaction_id", "customer_id", "transaction_ts", "event_date", "amount", "transaction_hour", "is_nighttime_transaction", "is_cross_border", "is_international_transaction", "card_present_flag", "is_card_not_present", "merchant_risk_level", "rooted_device_flag", "emulator_flag", "risk_signal_count"]


#: The counted values of DISTINCT and their frames.
DISTINCT_OF = dict(zip(DISTINCT, (("transaction_country", WEEK), ("merchant_id", MONTH), ("device_id", MONTH))))
#: Flags that are summed over 30 days.
SUMS = {"_cross": "is_cross_border", "_risky_merchant": "is_high_risk_merchant", "_risky_device": "is_risky_device", "_night": "is_nighttime_transaction"}


def with_label(rows: DataFrame, labels: DataFrame, key: str = "transaction_id", label: str = "fraud_label") -> DataFrame:
    """Left join to partial labels; a missing one is 0."""
    return rows.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.lit(0)))


def behaviour(rows: DataFrame, by_month: bool = False, distinct: bool = True) -> DataFrame:
    """rows with a known time and all features.

    A frame of N seconds is [t - N, t - 1] in whole seconds: neither the row nor others in its second are seen. Rows
    without a time are left out (they would see each other and themselves). All raw windows stand in one select
    over one partitioning and order: one shuffle, one sort.

    by_month is for tables where one customer has a large share of the rows: no frame is longer than 30 days, so a
    customer's rows are dealt by spans of 30 days, each also to the next span, where it is only looked back upon. That
    shuffles twice the rows and gives the same result, and a customer is spread over as many tasks as it has spans.
    Without distinct, DISTINCT is left out, and rows need not have its columns.
    """
    timed = rows.where(F.col("transaction_ts").isNotNull()).withColumn("_s", epoch_seconds(F.col("transaction_ts")))
    span, keys = F.floor(F.col("_s") / MONTH), ["customer_id"]
    if by_month:
        timed, keys = timed.withColumn("_span", F.explode(F.array(span, span + 1))), ["customer_id", "_span"]
    w = Window.partitionBy(*keys).orderBy("_s")
    past = lambda seconds: w.rangeBetween(-seconds, -1)
    n = lambda s: F.count("transaction_id").over(past(s))
    sets = [F.size(F.collect_set(c).over(past(s))).cast("long").alias(name) for name, (c, s) in DISTINCT_OF.items()] if distinct else []
    raw = timed.select(
        "*",
        n(HOUR).alias("txn_count_1h"), n(DAY).alias("txn_count_24h"), n(WEEK).alias("txn_count_7d"), n(MONTH).alias("_n_30d"),
        F.avg("amount").over(past(WEEK)).alias("_avg_7d"), F.avg("amount").over(past(MONTH)).alias("_avg_30d"), F.max("amount").over(past(MONTH)).alias("_max_30d"),
        *sets,
        *[F.sum(as_int(flag)).over(past(MONTH)).alias(name) for name, flag in SUMS.items()],
        F.sum(F.when(F.col("transaction_status") == "DECLINED", 1).otherwise(0)).over(past(WEEK)).alias("_declined"),
    )
    raw = raw.where(F.col("_span") == span).drop("_span") if by_month else raw
    return _finished(raw).drop("_s")


def _finished(raw: DataFrame) -> DataFrame:
    """Rounded averages and ratios from the raw counts and sums of the frames, which go."""
    ratio = lambda a, b: exact_round(safe_ratio(F.col(a).cast("double"), F.col(b).cast("double")), 4)
    done = raw.withColumns(
        {
            "avg_amount_7d": exact_round(F.col("_avg_7d"), 2),
            "avg_amount_30d": exact_round(F.col("_avg_30d"), 2),
            "max_amount_30d": exact_round(F.col("_max_30d"), 2),
            "amount_vs_avg_ratio": ratio("amount", "_avg_30d"),
            "cross_border_txn_ratio_30d": ratio("_cross", "_n_30d"),
            "high_risk_merchant_ratio_30d": ratio("_risky_merchant", "_n_30d"),
            "risky_device_ratio_30d": ratio("_risky_device", "_n_30d"),
            "nighttime_txn_ratio_30d": ratio("_night", "_n_30d"),
            "declined_txn_ratio_7d": ratio("_declined", "txn_count_7d"),
        }
    )
    return done.drop("_n_30d", "_avg_7d", "_avg_30d", "_max_30d", *SUMS, "_declined")


def distinct_counts(rows: DataFrame, counts: dict[str, tuple[str, int]], key: str = "customer_id", time: str = "transaction_ts", span: int = MONTH) -> DataFrame:
    """rows with a known time and, for each name in counts, how many distinct values of a column the key had in the N seconds before.

    The same as the size of a set over the frame [t - N, t - 1], by a sweep: a value is in sight from a second after it
    occurs until N seconds after it last occurred. A row opens such an island if its value did not occur in the N seconds before, and closes one
    if it doesn't occur in those after; what counts is the islands opened before t less those closed before t - N, two running sums. That is
    n log n whatever the frames hold, and no set is kept. Rows are dealt once, by key and span of time (`span` seconds, four times the longest frame at least),
    so that a hot key is worked on in as many tasks as it has spans; those near a span's end go to the next one too, without their other columns,
    where they are only looked back upon. Null values are not counted; rows of a null key are one key's; rows without a time are left out.
    """
    timed = rows.where(F.col(time).isNotNull()).withColumn("_s", epoch_seconds(F.col(time)))
    names, reach = list(counts), max(frame for _, frame in counts.values())
    length = max(span, 4 * reach)
    at_span = F.floor(F.col("_s") / length)
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    ahead = F.when(F.col("_s") >= (at_span + 1) * length - reach, F.struct((at_span + 1).alias("span"), F.lit(None).cast(timed.select(row).schema[0].dataType).alias("row")))
    places = F.explode(F.array_compact(F.array(F.struct(at_span.alias("span"), row.alias("row")), ahead)))
    dealt = timed.select(F.col(f"`{key}`").alias("_k"), "_s", *[F.col(f"`{counts[n][0]}`").alias(f"_v{i}") for i, n in enumerate(names)], places.alias("_p")).select("*", F.col("_p.span").alias("_span"), F.col("_p.row").alias("_row")).drop("_p")
    dealt = dealt.repartition("_k", "_span")  # what all windows below are dealt by
    for i, n in enumerate(names):
        known, frame, same = F.col(f"_v{i}").isNotNull(), counts[n][1], Window.partitionBy("_k", "_span", f"_v{i}").orderBy("_s")
        before, after = F.lag("_s").over(same), F.lead("_s").over(same)
        opens = known & (before.isNull() | (F.col("_s") - before > frame))
        closes = known & (after.isNull() | (after - F.col("_s") > frame))
        dealt = dealt.select("*", opens.cast("int").alias(f"_o{i}"), closes.cast("int").alias(f"_c{i}")).drop(f"_v{i}")
    until = lambda n: Window.partitionBy("_k", "_span").orderBy("_s").rangeBetween(Window.unboundedPreceding, -n)
    in_sight = lambda i, n: F.coalesce(F.sum(f"_o{i}").over(until(1)), F.lit(0)) - F.coalesce(F.sum(f"_c{i}").over(until(counts[n][1] + 1)), F.lit(0))
    return dealt.select("_row", *[in_sight(i, n).alias(n) for i, n in enumerate(names)]).where("_row is not null").select("_row.*", *[f"`{n}`" for n in names])


def feature_table(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The 31 columns that models are trained on."""
    return behaviour(with_label(rows, labels)).select(*BASIC, *COUNTS, *SPEND, *DISTINCT, *RATIOS, "fraud_label")


# ---------------------------------------------------------------- checks of a feature table


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, min, max, mean, stddev; one pass."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), exact_round(F.avg(c), 4).alias("mean"), exact_round(F.stddev(c), 4).alias("stddev")) for c in columns]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: nulls and zeros; one pass."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.col(c) == 0).alias("zeros")) for c in columns]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def label_share(df: DataFrame, label: str) -> DataFrame:
    """label, n, share of all rows. The window is over the few rows of the grouping."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", exact_round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: all rows over twice the label's."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", exact_round(F.sum("n").over(Window.partitionBy()) / (2 * F.col("n")), 6))
