"""One investigation: retrieve, ask, audit. The answering model is a callable; the default applies the policy's rules."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.tables import append_or_log
from .policies import CHUNKS
from .retrieval import INSTRUCTIONS, REFUSAL, lookup, parse_id, query_text, recommended_action, text_top_k

AUDIT = StructType([StructField(n, LongType() if n == "latency_ms" else StringType()) for n in ("transaction_id", "generated_at", "latency_ms", "model_endpoint", "vs_index", "prompt", "answer", "evidence_json")])


def rule_answer(evidence: dict) -> str:
    tx = evidence["transaction"]
    cited = "; ".join(f"[doc:{c['document_name']} §{c['section']}]" for c in evidence["policy_chunks"])
    return f"## Summary\nTransaction {tx['transaction_id']} shows {tx['risk_signal_count']} risk signals.\n\n## Policy references\n{cited}\n\n## Recommended analyst action\n{tx['_action']}"


def investigate(
    transaction_id,
    transactions: DataFrame,
    customers: DataFrame,
    merchants: DataFrame,
    devices: DataFrame,
    chunks: DataFrame | None = None,
    audit_path: str | None = None,
    generate: Callable[[dict], str] = rule_answer,
    k: int = 5,
) -> dict:
    """Answer and evidence for one transaction. An unknown or malformed id gets the exact refusal, without
    asking the model, and is audited too. Each lookup brings one row to the driver."""
    began, spark = time.time(), transactions.sparkSession
    one = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    rows = one(lookup(transactions, "transaction_id", parse_id(transaction_id)).withColumns({"_action": recommended_action(), "_query": query_text(transactions.columns)}))
    evidence, asked, answer = {}, "", REFUSAL
    if rows:
        tx = rows[0]
        entity = lambda dim, key: next(iter(one(lookup(dim, key, tx[key]))), {})
        held = chunks if chunks is not None else spark.createDataFrame(CHUNKS)
        policy = one(text_top_k(held, tx.pop("_query"), k))
        evidence = {"transaction": tx, "customer_features": entity(customers, "customer_id"), "merchant_risk": entity(merchants, "merchant_id"), "device_risk": entity(devices, "device_id"), "ip_risk": {}, "policy_chunks": policy}
        asked = f"{INSTRUCTIONS}\n\nEVIDENCE:\n{json.dumps(evidence, indent=2, default=str)}\n"
        answer = generate(evidence)
    out = {"transaction_id": str(transaction_id), "generated_at": datetime.now(timezone.utc).isoformat(), "latency_ms": int((time.time() - began) * 1000), "model_endpoint": getattr(generate, "__name__", "model"), "vs_index": "policy_chunks", "prompt": asked, "answer": answer, "evidence_json": json.dumps(evidence, default=str)}
    if audit_path:
        append_or_log(spark.createDataFrame([tuple(out[f.name] for f in AUDIT)], AUDIT), audit_path, AUDIT)
    return out | {"found": bool(rows), "evidence": evidence}


def answers(rows: DataFrame) -> DataFrame:
    """The rule answers of any number of transactions in one pass."""
    action = recommended_action()
    return rows.select("transaction_id", "risk_signal_count", action.alias("action"), F.concat(F.lit("risk signals: "), F.col("risk_signal_count").cast("string"), F.lit("; "), action).alias("answer"))
