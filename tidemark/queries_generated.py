"""The generator over the keys of given tables, its picks checked by the same hash in SQL; and learning over fixed inputs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .functions.expressions import exact_round
from .operators import generate, ml, retrieval, sketches
from .queries import _ACTION, _R, _fact, _scratch, query
from .sources import fixtures as fx
from .sources import hashes, tables

# ---------------------------------------------------------------- generation over given keys

_pick, _pmod, _u = hashes.pick, hashes.spark_pmod, hashes.uniform
g = generate


def _ids(spark, d, table: str, key: str, name: str):
    return tables.load(spark, d, table).select((F.col(key) + 1).alias(name))


def _sizes(spark, d) -> generate.Sizes:
    count = lambda t: tables.load(spark, d, t).count()
    return generate.Sizes(count("customer"), count("supplier"), count("part"), count("events"))


_PALETTES = {"age_band": g.AGES, "home_country": g.COUNTRIES, "customer_segment": g.SEGMENTS, "kyc_status": g.KYC, "risk_tier": g.TIERS, "annual_income_band": g.INCOMES, "preferred_channel": g.PREFERRED}


@query(
    f"SELECT *, annual_income_band IN ('250K+', '100-250K') AS is_high_net_worth FROM (SELECT customer_id, {', '.join(f'{_pick('customer_id', n, p)} AS {n}' for n, p in _PALETTES.items())}, "
    f"DATE '2010-01-01' + CAST({_pmod('customer_id', 'open', 5843)} AS INTEGER) AS account_open_date FROM (SELECT c_custkey + 1 AS customer_id FROM customer))"
)
def gen_customers(spark, d):
    """A customer dimension for the keys of a table."""
    return generate.dim_customer(spark, generate.Sizes(), _ids(spark, d, "customer", "c_custkey", "customer_id"))


@query(
    f"SELECT merchant_id, 'MERCHANT_' || merchant_id AS merchant_name, merchant_category, {_pick('merchant_id', 'merchant_country', g.COUNTRIES)} AS merchant_country, CASE WHEN merchant_category IN ('GAMBLING', 'CRYPTO') THEN 'HIGH' WHEN merchant_category IN ('GIFT_CARDS', 'ELECTRONICS') THEN 'MEDIUM' ELSE 'LOW' END AS merchant_risk_level, "
    "CASE WHEN merchant_id <= 50 THEN 'MEGA' WHEN merchant_id <= 5000 THEN 'LARGE' WHEN merchant_id <= 30000 THEN 'MEDIUM' ELSE 'SMALL' END AS merchant_size, merchant_category IN ('GAMBLING', 'CRYPTO', 'GIFT_CARDS', 'ELECTRONICS') AS online_only_flag "
    f"FROM (SELECT merchant_id, {_pick('merchant_id', 'category', g.CATEGORIES)} AS merchant_category FROM (SELECT p_partkey + 1 AS merchant_id FROM part))"
)
def gen_merchants(spark, d):
    return generate.dim_merchant(spark, generate.Sizes(), _ids(spark, d, "part", "p_partkey", "merchant_id"))


@query(
    f"SELECT device_id, {_pick('device_id', 'device_type', g.DEVICES)} AS device_type, {_pick('device_id', 'os_type', g.SYSTEMS)} AS os_type, {_pick('device_id', 'app_version', g.VERSIONS)} AS app_version, "
    f"{_u('device_id', 4001)} < 0.02 AS rooted_device_flag, {_u('device_id', 4002)} < 0.01 AS emulator_flag FROM (SELECT o_orderkey + 1 AS device_id FROM orders)"
)
def gen_devices(spark, d):
    return generate.dim_device(spark, generate.Sizes(), _ids(spark, d, "orders", "o_orderkey", "device_id"), keyed=True)


_PAID = " ".join(f"WHEN '{name}' THEN {_pick('i', 'payment', palette)}" for name, palette in g.PAYMENTS.items())
_KINDS = f"""n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM supplier) AS m, (SELECT count(*) FROM part) AS v),
drawn AS (SELECT event_id + 1 AS i, n.*, least(50, n.m) AS mega FROM events, n),
kinds AS (SELECT i AS transaction_id, i, {_pmod('i', 'customer', 'c')} + 1 AS customer_id, CASE WHEN {_u('i', 3001)} < 0.1 THEN {_pmod('i', 'mega', 'mega')} + 1 ELSE {_pmod('i', 'merchant', 'm')} + 1 END AS merchant_id, {_pmod('i', 'device', 'v')} + 1 AS device_id,
  {_pick('i', 'channel', g.CHANNELS)} AS transaction_channel, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * CAST(floor({_u('i', 3002)} * 731 * 86400) AS BIGINT) AS moment FROM drawn)"""


@query(f"WITH {_KINDS} SELECT transaction_id, customer_id, merchant_id, device_id, transaction_channel, CASE transaction_channel {_PAID} END AS payment_type, CAST(moment AS DATE) AS event_date, CAST(epoch(moment) AS BIGINT) AS seconds FROM kinds")
def gen_fact_keys(spark, d):
    """Facts for the keys of events: foreign keys in the given dimensions, a tenth of the rows on few merchants, payment by channel, times."""
    fact = generate.fact_transactions(spark, _sizes(spark, d), ids=_ids(spark, d, "events", "event_id", "transaction_id"), keyed=True)
    wide = [F.col(c).cast("long").alias(c) for c in ("customer_id", "merchant_id", "device_id")]
    return fact.select("transaction_id", *wide, "transaction_channel", "payment_type", "event_date", F.unix_timestamp("transaction_ts").alias("seconds"))


@query(
    f"WITH {_KINDS} SELECT transaction_id, {_R(f'CASE WHEN transaction_channel = {chr(39)}ATM{chr(39)} THEN 20 + 480 * {_u('i', 3003)} ELSE pow(10.0, 4 * {_u('i', 3004)}) END', 2)} AS amount, {_pick('i', 'currency', g.CURRENCIES)} AS currency, {_pick('i', 'transaction_country', g.COUNTRIES)} AS transaction_country, "
    + f"concat_ws('.', {', '.join(_pmod('i', f'ip{k}', 255) for k in range(4))}) AS ip_address, CASE WHEN {_u('i', 3005)} < 0.96 THEN 'APPROVED' WHEN {_u('i', 3005)} < 0.99 THEN 'DECLINED' ELSE 'REVERSED' END AS transaction_status, {_pick('merchant_id', 'category', g.CATEGORIES)} AS merchant_category FROM kinds"
)
def gen_fact_values(spark, d):
    """The same facts' amounts, currencies, countries, addresses, states and categories."""
    fact = generate.fact_transactions(spark, _sizes(spark, d), ids=_ids(spark, d, "events", "event_id", "transaction_id"), keyed=True)
    return fact.select("transaction_id", exact_round(F.col("amount"), 2).alias("amount"), "currency", "transaction_country", "ip_address", "transaction_status", "merchant_category")


@query("SELECT c_custkey + 1 AS customer_id, c_name FROM customer")
def id_range_of_customers(spark, d):
    """As many ids as a table has rows, met with its keys."""
    held = tables.load(spark, d, "customer").select((F.col("c_custkey") + 1).alias("customer_id"), "c_name")
    return tables.id_range(spark, held.count(), "customer_id").join(held, "customer_id")


_HANDLED = [{"action": "APPROVE", "hours": None, "level": 0}, {"action": "HOLD_FOR_REVIEW", "hours": 24, "level": 1}, {"action": "ESCALATE_TO_TIER2", "hours": 8, "level": 2}, {"action": "FILE_SAR", "hours": 4, "level": 3}]


@query(
    f"WITH {fx.STAR_SQL}, acted AS (SELECT {_ACTION} AS action FROM fact), handled AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) for v in r.values()) + ')' for r in _HANDLED)}) t(action, hours, level)) "
    "SELECT action, CAST(hours AS VARCHAR) AS hours, level, (SELECT count(*) FROM acted a WHERE a.action = h.action) AS transactions FROM handled h"
)
def literal_actions(spark, d):
    """A few literal rows beside what the fact table has of each."""
    handled = tables.literal_rows(spark, _HANDLED, "action string, hours int, level int")
    counts = _fact(spark, d).groupBy(retrieval.recommended_action().alias("action")).agg(F.count("*").alias("transactions"))
    return handled.join(counts, "action", "left").select("action", F.col("hours").cast("string").alias("hours"), "level", F.coalesce("transactions", F.lit(0)).alias("transactions"))


# ---------------------------------------------------------------- learning over fixed inputs

_ML_ROWS = "rows_ AS (SELECT o_orderkey AS transaction_id, o_orderpriority AS merchant_risk_level, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS amount, CAST(o_orderkey % 3 = 0 AS DOUBLE) AS is_cross_border FROM orders)"


def _ml_rows(spark, d):
    o = tables.load(spark, d, "orders")
    amount = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return o.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_orderpriority").alias("merchant_risk_level"), amount.alias("amount"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("is_cross_border"))


@query(
    f"WITH {_ML_ROWS}, ranked AS (SELECT merchant_risk_level, row_number() OVER (ORDER BY count(*) DESC, merchant_risk_level) - 1 AS place, count(*) OVER () AS n FROM rows_ GROUP BY 1) "
    "SELECT transaction_id, CAST(place AS DOUBLE) AS merchant_risk_level_idx, CAST(is_cross_border AS DOUBLE) AS flag, array_to_string(list_transform(range(n + 1), lambda i: CASE WHEN i = place THEN 1 ELSE 0 END), '') AS encoded, amount IS NULL AS imputed, n + 3 AS slots FROM rows_ JOIN ranked USING (merchant_risk_level)"
)
def ml_stages(spark, d):
    """Indexer, encoder, imputer and assembler as fitted in the pipeline: places by frequency, one slot a category and one for unknown ones."""
    from pyspark.ml import Pipeline

    rows = _ml_rows(spark, d)
    made = Pipeline(stages=ml.stages(rows.columns)).fit(rows).transform(rows).withColumn("v", vector_to_array("features"))
    # the vector: amount, the flag, then the encoded slots
    encoded = F.array_join(F.transform(F.slice("v", 3, F.size("v") - 2), lambda x: x.cast("int").cast("string")), "")
    return made.select("transaction_id", "merchant_risk_level_idx", F.element_at("v", 2).alias("flag"), encoded.alias("encoded"), F.col("amount").isNull().alias("imputed"), F.size("v").cast("long").alias("slots"))


@query(
    f"WITH {_ML_ROWS} SELECT count(*) FILTER (WHERE amount IS NULL) AS missing, count(amount) AS known, true AS near_median FROM rows_"
)
def ml_imputed(spark, d):
    """What stands in for missing amounts is within a thousandth of the ranks of the median."""
    from pyspark.ml import Pipeline

    rows = _ml_rows(spark, d)
    made = Pipeline(stages=ml.stages(rows.columns)[:1]).fit(rows).transform(rows)
    stands = made.where("amount is null").agg(F.min("amount_imp").alias("a"), F.max("amount_imp").alias("b"))
    counted = made.join(stands).agg(F.count_if(F.col("amount").isNull()).alias("missing"), F.count("amount").alias("known"), F.count_if(F.col("amount") < F.col("a")).alias("_below"), F.count_if(F.col("amount") <= F.col("a")).alias("_upto"), F.bool_and(F.col("a") == F.col("b")).alias("_same"))
    half, slack = F.col("known") / 2, F.col("known") * 0.001 + 1
    return counted.select("missing", "known", (F.col("_same") & (F.col("_below") <= half + slack) & (F.col("_upto") >= half - slack)).alias("near_median"))


_LABEL = "CAST(o_totalprice + (o_orderkey * 7919 % 1000) * 300 > 250000 AS DOUBLE)"


def _linear_rows(spark, d):
    o = tables.load(spark, d, "orders")
    label = (F.col("o_totalprice") + F.col("o_orderkey") * 7919 % 1000 * 300 > 250_000).cast("double")
    return ml.weighted(o.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_totalprice").alias("amount"), (F.col("o_orderkey") % 2 == 0).cast("int").alias("is_cross_border"), label.alias("fraud_label")))


@query(f"WITH r AS (SELECT {_LABEL} AS y FROM orders) SELECT count(*) AS n, 0.5 AS weighted_label, 0.5 AS weighted_score, true AS steep, true AS flat FROM r")
def ml_linear_fit(spark, d):
    """At the optimum the weighted mean of the scores is that of the labels; the amount decides and the flag, which means nothing, hardly."""
    rows = _linear_rows(spark, d)
    model = ml.fit(rows, ml.logistic_regression())
    scored = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    coefficients = [float(x) for x in model.stages[-1].coefficients]
    mean = lambda c: exact_round(F.sum(F.col(c) * F.col("class_weight")) / F.sum("class_weight"), 4)
    low, high = F.avg(F.when(F.col("amount") < 50_000, F.col("p"))), F.avg(F.when(F.col("amount") > 250_000, F.col("p")))
    return scored.agg(F.count("*").alias("n"), mean("fraud_label").alias("weighted_label"), mean("p").alias("weighted_score"), (low < high - 0.3).alias("steep")).withColumn("flat", F.lit(abs(coefficients[1]) < 0.2))


_SPLIT = "(transaction_id * 7919 + 42) % 100 >= 80"


@query(f"WITH {fx.EVENTS_SQL} SELECT transaction_id, customer_id, amount, CAST(amount > 150 AS DOUBLE) AS fraud_label, true AS in_range, true AS agrees, true AS forest_right FROM tx WHERE {_SPLIT}")
def ml_scores_checked(spark, d):
    """Both models' scores of the test rows: from 0 to 1, each verdict that of its score, and the forest right where the label is a threshold of one input."""
    tx = fx.event_transactions(spark, d).withColumn("fraud_label", (F.col("amount") > 150).cast("int"))
    rows = ml.prepare(tx)
    train, test = ml.split(rows, bucket=(F.col("transaction_id") * 7919 + 42) % 100)
    scored = ml.scores(test, *ml.fit_all(ml.weighted(train), [ml.random_forest(30, 4), ml.logistic_regression()]))
    c = F.col
    return scored.select(
        "transaction_id", "customer_id", "amount", "fraud_label", (c("rf_fraud_score").between(0, 1) & c("lr_fraud_score").between(0, 1)).alias("in_range"),
        ((c("rf_prediction") == (c("rf_fraud_score") > 0.5).cast("double")) & (c("lr_prediction") == (c("lr_fraud_score") > 0.5).cast("double"))).alias("agrees"),
        ((c("rf_prediction") == c("fraud_label")) | c("amount").between(75, 400)).alias("forest_right"),
    )


@query("SELECT count(*) AS n, true AS parted, true AS share_near, true AS same_in_any_layout FROM orders")
def hash_split_shares(spark, d):
    """The split by the hash of the key: each row on one side, near four fifths in training, and the same rows however the table lies."""
    rows = tables.load(spark, d, "orders").select("o_orderkey")
    sides = [df.withColumn("t", F.lit(name)) for df, name in zip(ml.split(rows, key="o_orderkey"), ("train", "test"))]
    again = [df.withColumn("u", F.lit(name)) for df, name in zip(ml.split(rows.repartition(3, F.col("o_orderkey") % 5), key="o_orderkey"), ("train", "test"))]
    met = sides[0].unionByName(sides[1]).join(again[0].unionByName(again[1]), "o_orderkey", "full")
    share = F.count_if(F.col("t") == "train") / F.count("*")
    return met.agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct("o_orderkey")).alias("parted"), (F.abs(share - 0.8) < 0.05).alias("share_near"), F.bool_and(F.col("t").eqNullSafe(F.col("u"))).alias("same_in_any_layout"))


@query(f"WITH r AS (SELECT {_LABEL} AS y FROM orders) SELECT 2 AS features, 'amount_imp' AS first, true AS sums_to_one, true AS ordered FROM r LIMIT 1")
def ml_importance_checked(spark, d):
    """A forest's importances sum to 1, under the vector's names, with the input that decides in front."""
    rows = _linear_rows(spark, d)
    model = ml.fit(rows, ml.random_forest(20, 4))
    found = ml.importance(spark, model, model.transform(rows.limit(1)))
    return found.agg(F.count("*").cast("int").alias("features"), F.max_by("feature", "importance").alias("first"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"), (F.max("importance") > 0.9).alias("ordered"))


# ---------------------------------------------------------------- quantiles by sketches

_DAYS = "SELECT CAST(ts AS DATE) AS day, value FROM events"


@query("SELECT event_type, count(*) AS n, true AS within FROM events GROUP BY 1")
def sketched_quantiles(spark, d):
    """Quartiles from sketches stored per day and merged, held against exact ranks: within the sketch's error."""
    path = _scratch(spark)
    rows = tables.load(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", F.col("value"))
    sketches.write_daily(rows, path, "day", ["event_type"], "value")
    found = sketches.merged_quantiles(spark.read.parquet(path), ["event_type"], [0.25, 0.5, 0.75])
    met = rows.join(found, "event_type").select("event_type", "value", F.posexplode("quantiles").alias("at", "q"), "fractions")
    ranks = met.groupBy("event_type", "at", F.element_at("fractions", F.col("at") + 1).alias("fraction")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < F.col("q")).alias("_below"), F.count_if(F.col("value") <= F.col("q")).alias("_upto"))
    ok = (F.col("_below") / F.col("n") <= F.col("fraction") + sketches.ERROR) & (F.col("_upto") / F.col("n") >= F.col("fraction") - sketches.ERROR)
    return ranks.groupBy("event_type").agg(F.max("n").alias("n"), F.bool_and(ok).alias("within"))


@query(f"WITH v AS ({_DAYS}) SELECT count(*) AS n, count(DISTINCT day) AS days, min(value) AS low, max(value) AS high FROM v")
def sketched_profile(spark, d):
    """What the stored sketches tell without the rows: their number, days and extremes."""
    path = _scratch(spark)
    rows = tables.load(spark, d, "events").select(F.to_date("ts").alias("day"), F.lit("all").alias("kind"), "value")
    sketches.write_daily(rows, path, "day", ["kind"], "value")
    held = spark.read.parquet(path)
    return sketches.merged(held, ["kind"]).select(sketches.size("sketch").alias("n"), F.lit(held.select("day").distinct().count()).cast("long").alias("days"), sketches.quantile("sketch", 0.0).alias("low"), sketches.quantile("sketch", 1.0).alias("high"))
