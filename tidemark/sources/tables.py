"""Table sources and sinks. Callers pass paths or catalog names; nothing is global."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def id_range(spark: SparkSession, n: int, column: str, parts: int | None = None) -> DataFrame:
    """Ids 1 to n."""
    return spark.range(1, n + 1, 1, parts).withColumnRenamed("id", column)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir or, on one machine only, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Schemas of tables by application and path, so that a table that is read again needs no job to find them.
_schemas: dict[tuple[str, str], StructType] = {}


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of a folder. Its schema is found once an application; call forget_schemas() after one has changed in place."""
    path = f"{base}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        found = spark.read.parquet(path)
        _schemas[key] = found.schema
        return found
    return spark.read.schema(_schemas[key]).parquet(path)


def forget_schemas() -> None:
    _schemas.clear()


def load_or_empty(spark: SparkSession, table: str, ddl: str) -> DataFrame:
    """A catalog table, or an empty one of that schema where there is none."""
    return spark.table(table) if spark.catalog.tableExists(table) else spark.createDataFrame([], ddl)


def load_path_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A Parquet table, or an empty one of that schema where the path doesn't exist."""
    try:
        found = spark.read.schema(ddl).parquet(path)
        found.schema  # a missing path shows when the plan is analysed
        return found
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def literal_rows(spark: SparkSession, rows: list[dict], schema: StructType | str) -> DataFrame:
    """Rows from the driver under a declared schema (inference would sort the columns)."""
    return spark.createDataFrame(rows, schema)


def overwrite(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Replaces table and schema; partitions become folders that filters can skip. Rows are gathered by partition value before
    they are written; a small value is one task's, a large one is split by its size, and small ones share tasks."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def overwrite_clustered(df: DataFrame, path: str, by: list[str], parts: int | None = None) -> None:
    """Range-partitioned and sorted files: min/max statistics then skip files and row groups on `by`."""
    columns = [F.col(c) for c in by]
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    ranged.sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, source: str, target: str, by: list[str], parts: int) -> None:
    """Rewrites a table clustered, under another path (a table being read can't be overwritten)."""
    overwrite_clustered(spark.read.parquet(source), target, by, parts)


def side_session(spark: SparkSession) -> SparkSession:
    """Another session on the same cluster with the same settings, for writes that are observed.

    Observations stay with their session for good, and a session that has any can't be serialised: learners that
    send theirs to tasks (logistic regression does) would fail ever after.
    """
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            other.conf.set(key, value)
    return other


def append(df: DataFrame, path: str, schema: StructType) -> None:
    """Appends under a fixed schema; columns are cast and ordered by it."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(path)


def append_or_log(df: DataFrame, path: str, schema: StructType, log: Callable[[str], None] = print) -> bool:
    """append(), but a failure is logged and doesn't stop the caller."""
    try:
        append(df, path, schema)
    except Exception as e:  # noqa: BLE001
        log(f"append to {path} failed: {e}")
        return False
    return True


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those of equal key and add the others; the rest of target stays.

    Changes must have the target's columns and one row per key. Write the result to a new path.
    """
    return target.join(changes, key, "left_anti").unionByName(changes.select(*target.columns))


def violations(df: DataFrame, key: str, not_null: list[str]) -> DataFrame:
    """constraint, rows: counts of nulls in columns declared NOT NULL and of repeated keys."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"not_null_{c}") for c in not_null])
    listed = nulls.select(F.explode(F.array(*[F.struct(F.lit(f"not_null_{c}").alias("constraint"), F.col(f"not_null_{c}").alias("rows")) for c in not_null])).alias("v")).select("v.*")
    repeated = df.groupBy(key).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows"))
    return listed.unionByName(repeated.select(F.lit(f"primary_key_{key}").alias("constraint"), "rows"))


def create_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    spark.catalog.setCurrentDatabase(name)


def preview(df: DataFrame, n: int = 20, order: list[Column] = ()) -> str:
    """Schema and the first n rows as text."""
    df = df.orderBy(*order) if order else df
    return df.schema.treeString() + "\n".join(map(str, df.limit(n).collect()))
