"""What the corpus operators share: shared scratch tables, prefix sums, row ids, word spans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir or, on one machine only, one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return f"{base.rstrip('/')}/tidemark-{app}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_shared(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results that were not saved are gone."""
    _delete(spark, shared_dir(spark))


def only_result(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, written; the tables that were written on the way to them are deleted."""
    before = len(_written)
    found = make()
    way = _written[before:]
    held = materialise(found, label)
    for path in way:
        _delete(spark, path)
    _written[before:] = []
    return held


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_id(docs: DataFrame) -> DataFrame:
    """_row, a unique id per row, and _doc, the row: written once, so that the id stays what it is. Repeated
    rows and ids stay apart, and no column of docs can clash with ours."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), "rows")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Adds, for each name in sums, the sum of its column over all rows that come earlier in `order`
    (within equal `by` columns, which `order` must start with).

    The rows are range-partitioned and written; only one total per partition (and `by` value)
    meets in one place, each partition then sums its own rows.
    """
    spark, by = df.sparkSession, list(by)
    dealt = df.withColumns({f"_v_{k}": v for k, v in sums.items()}).repartitionByRange(partitions(spark), *order)
    held = materialise(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    totals = held.groupBy("_part", *by).agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *by, *(F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
    whole = local.join(before, ["_part", *by])
    return whole.withColumns({k: F.col(f"_b_{k}") + F.col(f"_l_{k}") for k in sums}).select(*df.columns, *sums)


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of an Arrow binary column without nulls, one text directly after the other."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    wide = "large" in str(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes outside `gap`, and the first word of each text (one more at the end)."""
    inside = ~gap[data]
    edge = np.empty(len(data), bool)
    if len(data):
        edge[0] = True
        edge[1:] = ~inside[:-1]
    first = offsets[:-1]
    edge[first[first < len(data)]] = True
    starts = np.flatnonzero(inside & edge)
    # a word ends where the next byte is a gap or another text begins
    last = np.empty(len(data), bool)
    if len(data):
        last[-1] = True
        last[:-1] = edge[1:] | ~inside[1:]
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_tables = np.random.default_rng(20240607).integers(0, 2**64, (64, 256), np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit tabulation hash of each word: a sum of random numbers chosen by byte and place.

    Some 30 bytes of memory are needed per byte of text, so a block of words is hashed at a time.
    """
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + block, "right")) - 1)
        some = lengths[lo:hi]
        into = total[lo:hi] - total[lo]
        place = np.arange(int(some.sum()), dtype=np.int64) - np.repeat(into, some)
        value = _tables[place & 63, data[place + np.repeat(starts[lo:hi], some)]]
        if some.max() > 64:
            value = value * (2 * (place >> 6) + 1).astype(np.uint64)
        out[lo:hi] = np.add.reduceat(value, into)
        lo = hi
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch_lengths: np.ndarray, limit: int):
    """Slices of a batch of about `limit` bytes each, one text at least."""
    at, total = 0, 0
    for i, n in enumerate(batch_lengths):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += int(n)
    if at < len(batch_lengths):
        yield at, len(batch_lengths)
