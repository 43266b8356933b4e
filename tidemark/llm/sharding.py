"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot, start_byte.

    Documents stand in order of their id (nulls first); a document belongs to the shard in whose
    equal share of all bytes its first byte falls, so a shard's bytes differ from the target by less
    than one document at either end. slot counts the rows of a shard from 0. Null text has no bytes
    and so size 1; rows with equal ids stand in order of checksum and size, and rows equal in all three
    are alike, so any order of them gives the same result; an empty table gives no rows; other columns
    are ignored whatever their names. A very long text is measured and never cut: its shard is longer by it.
    """
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(f"`{text_col}`").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    placed = prefix_sums(sized, order, {"start_byte": F.col("size"), "_rank": F.lit(1).cast("long")})
    total = placed.agg(F.max(F.col("start_byte") + F.col("size"))).scalar()
    share = F.floor(F.col("start_byte").cast("decimal(38,0)") * shards / total)
    cut = placed.withColumn("shard", F.least(share, F.lit(shards - 1)).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("_rank").alias("_first"))
    # as many rows as shards
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"), "start_byte")
