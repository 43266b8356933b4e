"""Lookups, similarity search and prompts for investigating a transaction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFUSAL = "Insufficient evidence to investigate."


def parse_id(value) -> int | None:
    """The id as an int; None for None, empty and non-numeric values."""
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def lookup(table: DataFrame, key: str, value, columns: list[str] = None) -> DataFrame:
    """At most one row; the filter reaches the scan, so a clustered table reads one row group."""
    found = table.where(F.col(key) == F.lit(value)) if value is not None else table.where(F.lit(False))
    return found.select(*(columns or table.columns)).limit(1)


def entities(rows: DataFrame, customers: DataFrame, merchants: DataFrame, devices: DataFrame) -> DataFrame:
    """rows with a struct per entity, null where it is unknown: the batch form of the lookups."""
    for name, dim, key in (("customer", customers, "customer_id"), ("merchant", merchants, "merchant_id"), ("device", devices, "device_id")):
        rows = rows.join(dim.select(key, F.struct("*").alias(name)), key, "left")
    return rows


def query_text(columns: list[str], high_amount: float = 10_000) -> Column:
    """Ordered key=value tokens that describe a transaction to a policy index."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in columns else F.lit("None")
    flag = lambda *names: F.coalesce(F.greatest(*[F.coalesce(F.col(n), F.lit(False)) for n in names if n in columns], F.lit(False), F.lit(False)), F.lit(False))
    token = lambda cond, t: F.when(cond, F.lit(t))
    return F.concat_ws(
        " ",
        F.concat(F.lit("merchant_category="), text("merchant_category")), F.concat(F.lit("country="), text("transaction_country")), F.concat(F.lit("cross_border="), F.initcap(text("is_cross_border"))),
        F.when(F.coalesce(F.col("amount"), F.lit(0)) >= high_amount, "amount_band=high").otherwise("amount_band=normal"),
        token(flag("is_high_risk_merchant"), "high_risk_merchant=true"), token(flag("is_risky_device", "emulator_flag", "rooted_device_flag"), "risky_device=true"), token(flag("is_card_not_present"), "card_not_present=true"), token(flag("is_nighttime_transaction"), "nighttime=true"),
    )


def cosine(a: Column, query: list[float]) -> Column:
    """Cosine with a given vector, whose norm is found once and not per row."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, F.array(*map(F.lit, query))) / (F.sqrt(dot(a, a)) * F.lit(math.sqrt(sum(float(x) * float(x) for x in query))))


def top_k(index: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine, exact: one scan, k rows kept per task. Ties by key."""
    return index.select("*", F.round(cosine(F.col(vector), query), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def text_top_k(chunks: DataFrame, query: str, k: int = 5, text: str = "chunk_text", key: str = "chunk_id") -> DataFrame:
    """The k chunks nearest to a text by TF-IDF cosine, with Spark ML's hashing and IDF."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=4096), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_v")]
    model = Pipeline(stages=stages).fit(chunks)
    asked = model.transform(chunks.sparkSession.createDataFrame([(query,)], f"{text} string")).select(vector_to_array("_v").alias("q")).first()["q"]
    held = model.transform(chunks).withColumn("_a", vector_to_array("_v"))
    near = sum((F.get("_a", F.lit(i)) * v for i, v in enumerate(asked) if v), F.lit(0.0))
    return held.select(*chunks.columns, F.round(near, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def representatives(rows: DataFrame) -> DataFrame:
    """The smallest id of a risky, a clean and a cross-border transaction."""
    signals, abroad = F.col("risk_signal_count"), F.col("is_cross_border")
    first = lambda cond, name: F.min(F.when(cond, F.col("transaction_id"))).alias(name)
    return rows.agg(first(signals >= 3, "risky"), first((signals == 0) & ~abroad, "clean"), first(abroad, "cross_border"))


def recommended_action() -> Column:
    """The escalation policy's rules: cross-border over 10,000 is reported, else by the number of signals."""
    signals = F.col("risk_signal_count")
    return F.when(F.col("is_cross_border") & (F.col("amount") > 10_000), "FILE_SAR").when(signals >= 3, "ESCALATE_TO_TIER2").when(signals >= 1, "HOLD_FOR_REVIEW").otherwise("APPROVE")


INSTRUCTIONS = (
    "You assist a bank's fraud investigators. Use only what stands under EVIDENCE and don't infer values that aren't there. "
    f'If nothing stands there, or the transaction was not found, answer exactly: "{REFUSAL}" '
    "Support every claim by a field or by a policy chunk, cited as [doc:<document_name> §<section>]. "
    "Answer under the headings Summary, Evidence, Policy references, Risk explanation, Recommended analyst action (one of APPROVE, HOLD_FOR_REVIEW, ESCALATE_TO_TIER2, FILE_SAR)."
)


def prompt(evidence: Column) -> Column:
    """Instructions and the evidence as JSON, built in the JVM for any number of rows."""
    return F.concat(F.lit(INSTRUCTIONS + "\n\nEVIDENCE:\n"), F.coalesce(F.to_json(evidence), F.lit("(transaction not found)")), F.lit("\n"))


def recent(audit: DataFrame, n: int = 10) -> DataFrame:
    """The newest audit rows with the length of the answer (ISO text sorts as time; ties by id)."""
    return audit.select("transaction_id", "generated_at", F.length("answer").alias("answer_length")).orderBy(F.desc("generated_at"), "transaction_id").limit(n)
