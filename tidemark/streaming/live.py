"""The batch operators that carry over to streams, with state bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.expressions import as_int, epoch_seconds
from ..operators import features
from ..operators.features import DAY, HOUR, MONTH, WEEK


def windowed_velocity(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Count and sum per customer and event-time window. A range frame can't run on a stream; tumbling or
    sliding windows approximate it. Works on batch tables too."""
    timed = stream.withWatermark("transaction_ts", late)
    bucket = F.window("transaction_ts", window, slide) if slide else F.window("transaction_ts", window)
    return timed.groupBy(bucket.alias("w"), "customer_id").agg(F.count("*").alias("txn_count"), F.sum("amount").alias("amount")).select("customer_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "txn_count", "amount")


def first_arrivals(stream: DataFrame, key: str = "transaction_id", late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark (the batch operator keeps the latest)."""
    return stream.withWatermark("ingestion_ts", late).dropDuplicatesWithinWatermark([key])


def past_features(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Velocity, spend and ratios of features.behaviour on a stream, exact: transaction_id, customer_id, transaction_ts, amount, features.

    Each transaction is joined to its customer's of the 30 days before (and itself, so that an inner join keeps it), and what
    it met is summed up. Both sides have a watermark: a row's state goes 30 days and `late` after it, and a
    transaction's features come once the watermark has passed it. Rows that come more than `late` behind are left out of both
    sides and counted by late_rows(). Rows without a time or a customer are left out. Transaction ids are unique.
    """
    at = F.date_trunc("second", F.col("transaction_ts").cast("timestamp"))
    known = stream.where(F.col("transaction_ts").isNotNull() & F.col("customer_id").isNotNull())
    now = known.select(at.alias("at"), "transaction_id", "customer_id", "transaction_ts", "amount").withWatermark("at", late)
    flags = [*features.SUMS.values(), "transaction_status"]
    past = known.select(at.alias("then"), F.col("customer_id").alias("who"), F.col("amount").alias("spent"), *[F.col(f).alias(f"was_{f}") for f in flags]).withWatermark("then", late)
    met = now.join(past, F.expr("customer_id = who and then <= at and then >= at - interval 30 days"))
    age = epoch_seconds(F.col("at")) - epoch_seconds(F.col("then"))
    within = lambda n, x: F.when(age.between(1, n), x)
    declined = F.when(F.col("was_transaction_status") == "DECLINED", 1).otherwise(0)
    raw = met.groupBy("at", "transaction_id", "customer_id", "transaction_ts", "amount").agg(
        *[F.count(within(n, F.lit(1))).alias(name) for name, n in zip(features.COUNTS, (HOUR, DAY, WEEK))], F.count(within(MONTH, F.lit(1))).alias("_n_30d"),
        F.avg(within(WEEK, F.col("spent"))).alias("_avg_7d"), F.avg(within(MONTH, F.col("spent"))).alias("_avg_30d"), F.max(within(MONTH, F.col("spent"))).alias("_max_30d"),
        *[F.sum(within(MONTH, as_int(f"was_{flag}"))).alias(name) for name, flag in features.SUMS.items()], F.sum(within(WEEK, declined)).alias("_declined"),
    )
    return features._finished(raw).drop("at")


def behaviour_by_batch(spark: SparkSession, table: str, late: int = DAY) -> callable:
    """For foreachBatch: what past_features gives, by windows over what a batch makes final, idempotent by batch id.

    A batch's rows are written once, to rows/batch=n, and those that the watermark has passed (`late` seconds before the newest row seen) get their features,
    in features/batch=n. Only batches with rows of the 30 days before these are read again, each customer's rows are sorted and never
    paired, and nothing is held between batches but a row a batch of their times (seen/batch=n). Rows not later than the watermark of the batches before are left
    out, as are those without a time or a customer. Folders whose rows are older than that are read no more.
    """
    names = [*features.COUNTS, *features.SPEND, *features.RATIOS]
    used = ["transaction_id", "customer_id", "transaction_ts", "amount", "transaction_status", *features.SUMS.values()]

    def merge(batch: DataFrame, batch_id: int) -> None:
        seconds = epoch_seconds(F.col("transaction_ts"))
        seen = spark.read.parquet(f"{table}/seen").where(F.col("batch") < batch_id) if batch_id > 0 else None
        before = seen.agg(F.max("newest")).first()[0] if seen else None
        passed = before - late if before is not None else None
        known = batch.select(*used).where("transaction_ts is not null and customer_id is not null")
        kept = known if passed is None else known.where(seconds > passed)
        kept.write.mode("overwrite").parquet(f"{table}/rows/batch={batch_id}")
        written = spark.read.schema(kept.schema).parquet(f"{table}/rows/batch={batch_id}")
        written.agg(F.max(seconds).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{table}/seen/batch={batch_id}")
        newest = max((t for t in (before, spark.read.parquet(f"{table}/seen/batch={batch_id}").first()[0]) if t is not None), default=None)
        now = written
        if passed is not None:
            back = seen.where(F.col("newest") >= passed - MONTH).select("batch").collect()  # of a month's batches, a number each
            if back:
                now = now.unionByName(spark.read.schema(kept.schema).parquet(*[f"{table}/rows/batch={r['batch']}" for r in back]))
            now = now.where(seconds > passed - MONTH)
        final = now.where(seconds <= newest - late) if newest is not None else now
        done = features.behaviour(final, distinct=False)
        done = done if passed is None else done.where(seconds > passed)
        done.select("transaction_id", "customer_id", "transaction_ts", "amount", *names).write.mode("overwrite").parquet(f"{table}/features/batch={batch_id}")

    return merge


def upsert_latest(spark: SparkSession, table: str, key: list[str], newest_first: list, publish) -> callable:
    """For foreachBatch: keeps the newest row of each key in versions of a table under `table`, idempotent by batch id.

    Batch n is merged with version n - 1 to version n and published (publish(path)) after it is written; a batch that
    is replayed writes the same version again, from the same predecessor. The newest is W1's: first of `newest_first`.
    """
    from ..operators.quality import latest

    def merge(batch: DataFrame, batch_id: int) -> None:
        now = latest(batch, key, newest_first)
        if batch_id > 0:
            old = spark.read.parquet(f"{table}/version={batch_id - 1}").select(*batch.columns)
            now = latest(old.unionByName(now), key, newest_first)
        path = f"{table}/version={batch_id}"
        now.write.mode("overwrite").parquet(path)
        publish(path)

    return merge


def deliver(writer: DataStreamWriter, checkpoint: str, seconds: int = 600) -> StreamingQuery:
    """Runs a stream over what is there, from where its checkpoint ended."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream did not end within {seconds} s")
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that a run's stateful operators have left out as later than the watermark; a self-join sees each on both sides."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
