"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, prefix_sums, with_row_id

_SOURCE = ["_unnamed", "_source"]


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """_unnamed, _source, source_size and target of each source in `sized` (_unnamed, _source, size).

    Sources in code-point order (null last) get the weights in turn and share the sum of all sizes;
    a target stops at `cap` times its source's size and the excess goes to the others by weight. The end
    of that resharing is target = min(level * weight, cap * size) for one level: with sources in order
    of cap/weight, the level is set by the first source that the remaining sum doesn't lift above its cap.
    Windows here are over one row per source.
    """
    sources = sized.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(*_SOURCE)) - 1
    weighed = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")).withColumn("_cap", F.col("source_size") * cap)
    ratio = F.col("_cap") / F.col("_weight")
    earlier = Window.orderBy(ratio, *_SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    over, every = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)), Window.partitionBy()
    level = (over("source_size", every) - over("_cap", earlier)) / (over("_weight", every) - over("_weight", earlier))
    filled = weighed.withColumns({"_level": level, "_ratio": ratio})
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", *_SOURCE, "_level"))).over(every)
    target = F.least(F.coalesce(first["_level"] * F.col("_weight"), F.col("_cap").cast("double")), F.col("_cap").cast("double"))
    return filled.select(*_SOURCE, "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix-1", keep: list[str] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target, copies, taken, and `keep`.

    Every document of a source is expected target/source_size times. Documents of a source stand in
    order of size, so that each stretch of like sizes is sampled evenly; running sums of the expected
    copies start at one offset per source (drawn from a hash of `seed` and the source), and a document
    is emitted once per whole number that the sum passes: the floor or the ceiling of its expectation.
    Null text has size 0; null source is a source of its own, weighed last; a source without words has
    target 0 and takes nothing. Rows with equal size, id and text are alike. An empty table gives no rows; other
    columns are ignored whatever their names; words are counted over whole texts, however long.
    """
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).isNull().alias("_unnamed"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        F.xxhash64(F.col(text_col)).alias("_text"),
        *keep,
    )
    order = [F.col(c) for c in (*_SOURCE, "size", "doc_id", "_text", *keep)]
    ranked = prefix_sums(sized, order, {"_rank": F.lit(1).cast("long")}, _SOURCE)
    # sums by source come from the rows already sized, not from the texts again
    targets = source_targets(ranked.select(*_SOURCE, "size"), weights, cap)
    both = ranked.join(targets, _SOURCE)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.col("_unnamed").cast("string"), F.lit("/"), F.col("_source")).cast("binary")), 1, 4), 16, 10).cast("double") / 65536
    passed = lambda n: F.floor(n * rate + offset)
    copies = F.least(passed(F.col("_rank") + 1) - passed(F.col("_rank")), F.lit(cap)).cast("long")
    return both.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as plan_mix takes it; the columns stay as they are."""
    rows = with_row_id(docs)
    slim = rows.select("_row", *(F.col(f"_doc.{c}") for c in (id_col, text_col, source_col)))
    taken = plan_mix(slim, keep=["_row"], id_col=id_col, text_col=text_col, source_col=source_col, **how).where("copies > 0").select("_row", "copies")
    return rows.join(taken, "_row").select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("_doc.*")
