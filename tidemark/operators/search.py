"""Text search over an inverted index of terms, and investigations of any number of transactions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import overwrite, scratch_path
from .investigate import AUDIT
from .retrieval import REFUSAL, prompt, query_text, recommended_action

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, length (of the chunk, in terms): one row per term of a chunk."""
    parted = chunks.select(F.col(f"`{key}`").alias("key"), terms(F.col(f"`{text}`")).alias("terms"))
    each = parted.select("key", F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term"))
    return each.groupBy("term", "key", "length").agg(F.count("*").alias("tf"))


def weighted_postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, w: what one occurrence of the term in a query adds to the chunk's score."""
    index = postings(chunks, key, text)
    sizes = chunks.select(F.coalesce(F.size(terms(F.col(f"`{text}`"))), F.lit(0)).alias("n")).agg(F.count("*").alias("_chunks"), F.avg("n").alias("_mean"))
    spread = index.groupBy("term").agg(F.count("*").alias("df")).join(sizes)  # one row beside each
    idf = F.log((F.col("_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return index.join(spread, "term").select("term", "key", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("_mean")))).alias("w"))


def bm25_top_k(chunks: DataFrame, queries: DataFrame, k: int = 5, key: str = "chunk_id", text: str = "chunk_text", query: str = "query_text") -> DataFrame:
    """query_text, rank, key, score: the k best chunks of each distinct query text by BM25; ties by key.

    A term of a query counts as often as it stands there. The index is written first, so that Spark knows its size: a small one is sent to the
    queries, which are dealt by text once and scored and ranked where they lie; a large one is joined by term. Null texts
    have no terms, chunks without a shared term no score, and a query that meets none gives no rows.
    """
    spark, path = chunks.sparkSession, scratch_path(chunks.sparkSession, "index")
    overwrite(weighted_postings(chunks, key, text), path)
    asked = queries.select(F.col(f"`{query}`").alias("query_text")).where("query_text is not null").distinct()
    wanted = asked.select("query_text", F.explode(terms(F.col("query_text"))).alias("term")).groupBy("query_text", "term").agg(F.count("*").alias("qtf"))
    scored = wanted.join(spark.read.parquet(path), "term").groupBy("query_text", "key").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score"))
    best = Window.partitionBy("query_text").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_text", "rank", "key", "score")


def with_context(rows: DataFrame, chunks: DataFrame, k: int = 5, key: str = "chunk_id", text: str = "chunk_text", asked: DataFrame | None = None) -> DataFrame:
    """rows (with query_text) and policy: their text's k best chunks in order, empty where nothing matches.

    However many rows share a text, it is asked once. asked may name a table that has all of the rows' texts and is cheaper to read. The answers
    are written first, so that Spark knows their size: where they are few, the rows and their texts are not shuffled.
    """
    path = scratch_path(rows.sparkSession, "answers")
    found = bm25_top_k(chunks, rows if asked is None else asked, k, key, text)
    named = found.join(chunks.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key")
    overwrite(named.groupBy("query_text").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "score", "text"))).alias("policy")), path)  # k rows each
    lists = rows.sparkSession.read.parquet(path)
    return rows.join(lists, "query_text", "left").withColumn("policy", F.coalesce("policy", F.array().cast(lists.schema["policy"].dataType)))


def investigate_all(asked: DataFrame, facts: DataFrame, chunks: DataFrame, k: int = 5, key: str = "chunk_id", text: str = "chunk_text", evidence: list[str] = ("transaction_id", "amount", "risk_signal_count")) -> DataFrame:
    """transaction_id (as asked), found, policy_keys, prompt, answer for every id asked, malformed and unknown ones included.

    asked has transaction_id as text; facts are enriched transactions with signals. Ids that are no numbers or not there get the exact
    refusal, without evidence. The answer is the escalation policy's action. Repeated ids are answered as often as asked.
    """
    wanted = asked.select(F.col("transaction_id").alias("asked"), F.expr("try_cast(transaction_id as bigint)").alias("transaction_id"))
    known = facts.select("transaction_id", F.struct(*evidence).alias("evidence"), query_text(facts.columns).alias("query_text"), recommended_action().alias("action"))
    met = with_context(wanted.join(known, "transaction_id", "left"), chunks, k, key, text, known)
    found = F.col("evidence").isNotNull()
    shown = F.when(found, F.struct(F.col("evidence").alias("transaction"), F.transform("policy", lambda p: F.struct(p["key"].alias("chunk"), p["text"].alias("text"))).alias("policy_chunks")))
    cited = F.array_join(F.transform("policy", lambda p: F.concat(F.lit("[doc:"), p["key"].cast("string"), F.lit("]"))), "; ")
    answer = F.when(found, F.concat(F.lit("risk signals: "), F.coalesce(F.col("evidence.risk_signal_count").cast("string"), F.lit("unknown")), F.lit("; policy: "), cited, F.lit("; action: "), "action")).otherwise(REFUSAL)
    return met.select(F.col("asked").alias("transaction_id"), found.alias("found"), F.array_join(F.transform("policy", lambda p: p["key"].cast("string")), ",").alias("policy_keys"), prompt(shown).alias("prompt"), answer.alias("answer"))


def audit_rows(answered: DataFrame, at: Column, endpoint: str = "policy_rules", index: str = "bm25") -> DataFrame:
    """The answers under the audit's schema, for one append. Latency isn't known per row of a plan: null."""
    values = {"transaction_id": "transaction_id", "generated_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "model_endpoint": F.lit(endpoint), "vs_index": F.lit(index), "prompt": F.when(F.col("found"), F.col("prompt")).otherwise(""), "answer": "answer", "evidence_json": F.to_json(F.struct("policy_keys"))}
    col = lambda v: F.col(v) if isinstance(v, str) else v
    return answered.select(*[(col(values[f.name]) if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in AUDIT])
