"""An inverted file over vectors: cells of k-means, scanned where a query's nearest can be.

Vectors are compared by cosine: all are brought to length 1, where the squared distance is 2 - 2 cosine. A cell's radius is
the largest distance of a member to its centre, so a query at distance D from a centre has no neighbour nearer than D - radius in
that cell. That bound makes the search exact: cells after the nearest few are read only if the k-th found so far is farther.
The scores of a piece of a cell and a block of queries are one product of matrices.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.tables import overwrite, scratch_path

PIECE = 50_000  # rows of a cell that one join key brings together at most
BLOCK = 20_000  # queries that meet a piece in one task at about most
SCORES = 4_000_000  # scores that a task holds at a time
_SLACK = 2e-6  # scores are rounded to six places


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector as doubles of length 1; null for a null or zero vector."""
    wide = vector.cast("array<double>")
    length = F.sqrt(dot(wide, wide))
    return F.when(length > 0, F.zip_with(wide, F.array_repeat(length, F.size(wide)), lambda x, by: x / by))  # in a lambda of one, the length would be found for each element


def build_index(vectors: DataFrame, path: str, cells: int, key: str = "vec_id", vector: str = "embedding", sample: int = 100_000, seed: int = 7) -> None:
    """Writes the index: `path`/centres (cell, centre, n, radius) and `path`/members (cell, piece, key, unit vector, residual).

    Centres are learnt on at most about `sample` rows, picked by a hash of the key; every row is indexed. Rows with no or a zero vector
    are left out: they have no cosine. A cell with very many members is dealt in pieces.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").alias("key"), unit(F.col(f"`{vector}`")).alias("unit")).where("unit is not null")
    overwrite(rows, f"{path}/units")  # read several times below
    rows = spark.read.parquet(f"{path}/units")
    share = min(1.0, sample / max(rows.count(), 1))
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)) if share < 1 else F.lit(True))
    model = KMeans(k=cells, seed=seed, maxIter=20, featuresCol="_v", predictionCol="cell").fit(some.select(array_to_vector("unit").alias("_v")).repartition(8))
    found = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]  # `cells` rows
    centres = spark.createDataFrame(found, "cell int, centre array<double>")
    gap = F.sqrt(F.greatest(dot(F.col("unit"), F.col("unit")) - 2 * dot(F.col("unit"), F.col("centre")) + dot(F.col("centre"), F.col("centre")), F.lit(0.0)))
    placed = model.transform(rows.withColumn("_v", array_to_vector("unit"))).drop("_v").join(centres, "cell").select("cell", "key", "unit", gap.alias("residual"))
    overwrite(placed, f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("residual").alias("radius"))
    overwrite(centres.join(sizes, "cell").withColumn("pieces", F.ceil(F.col("n") / PIECE)).coalesce(1), f"{path}/centres")
    sized = placed.join(spark.read.parquet(f"{path}/centres").select("cell", "pieces"), "cell")
    members = sized.select("cell", F.pmod(F.xxhash64("key"), F.col("pieces")).alias("piece"), "key", "unit", "residual")
    overwrite(members.repartitionByRange("cell", "piece", "key").sortWithinPartitions("cell", "piece"), f"{path}/members")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(vectors.combine_chunks().flatten()).reshape(len(vectors), -1)


def _best(k: int, asked: pa.Table, held: pa.Table) -> pa.Table:
    """query, key, score: the k best of these members for each of these queries, by the rounded score, ties by key."""
    found = []
    if len(asked) and len(held):
        held = held.take(pc.sort_indices(held, sort_keys=[("key", "ascending")], null_placement="at_start"))
        ours, theirs = _matrix(asked["asked"]), _matrix(held["unit"])
        step = max(1, SCORES // len(theirs))
        for a in range(0, len(ours), step):
            scores = ours[a : a + step] @ theirs.T
            least = np.partition(scores, -k, axis=1)[:, -k] - _SLACK if k < len(theirs) else np.full(len(scores), -np.inf)
            at, member = np.nonzero(scores >= least[:, None])
            order = np.lexsort((member, -np.round(scores[at, member], 6), at))
            at, member = at[order], member[order]
            turn = np.arange(len(at)) - np.searchsorted(at, at)
            at, member = at[turn < k], member[turn < k]
            found.append(pa.table({"query": asked["query"].take(pa.array(at + a)), "key": held["key"].take(pa.array(member)), "score": scores[at, member]}))
    return pa.concat_tables(found) if found else pa.table({"query": asked["query"].slice(0, 0), "key": held["key"].slice(0, 0), "score": pa.array([], pa.float64())})


def _scan(members: DataFrame, probes: DataFrame, blocks: int, k: int) -> DataFrame:
    """query, key, score: of each piece of a probed cell, the k best members for each query.

    Queries are dealt in blocks, so that a task holds a piece and a block, multiplied as matrices.
    """
    dealt = probes.select("query", "asked", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"))
    copied = members.select("cell", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "key", "unit")
    place = ["cell", "piece", "block"]
    schema = StructType([StructField("query", probes.schema["query"].dataType), StructField("key", members.schema["key"].dataType), StructField("score", DoubleType())])
    met = dealt.groupBy(*place).cogroup(copied.groupBy(*place)).applyInArrow(partial(_best, k), schema)
    return met.withColumn("score", F.round("score", 6))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int = 4, exact: bool = True, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, rank, key, score: the k nearest of every query (its key and vector), all queries at once; ties by key.

    The `probes` nearest cells are scanned. With `exact`, so are all others whose bound is below the k-th distance found (or where
    fewer than k were found): the result is that of a scan of everything. Each query meets the cells' centres, not the members.
    Queries without a vector give no rows.
    """
    centres, members = spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/members")
    asked = queries.select(F.col(f"`{key}`").alias("query"), unit(F.col(f"`{vector}`")).alias("asked")).where("asked is not null")
    cells = asked.withColumn("cell", F.explode(F.array(*[F.lit(r["cell"]) for r in centres.select("cell").collect()])))  # a row per cell
    gap = F.sqrt(F.greatest(1 - 2 * dot(F.col("asked"), F.col("centre")) + dot(F.col("centre"), F.col("centre")), F.lit(0.0)))
    near = cells.join(centres, "cell").select("query", "asked", "cell", "pieces", "radius", gap.alias("gap"))
    near = near.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy("gap", "cell")))
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    first = _ranked(_scan(members, near.where(F.col("turn") <= probes), blocks, k), k).select("query", "rank", "key", "score")
    if not exact:
        return first
    overwrite(first, held := scratch_path(spark, "near"))  # read twice
    first = spark.read.parquet(held)
    # the k-th distance, from the score; what was rounded away counts as nearer
    kth = first.groupBy("query").agg(F.when(F.count("*") == k, F.sqrt(F.greatest(2 - 2 * (F.min("score") - _SLACK), F.lit(0.0)))).alias("kth"))
    rest = near.where(F.col("turn") > probes).join(kth, "query", "left").where(F.col("gap") - F.col("radius") <= F.coalesce("kth", F.lit(4.0)))
    more = _scan(members, rest, blocks, k)
    return _ranked(first.select("query", "key", "score").unionByName(more), k).select("query", "rank", "key", "score")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: queries, and the share of the true neighbours that were found."""
    hit = true.select("query", "key").join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    return hit.agg(F.count_distinct("query").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
