"""Files laid out along several columns at once, and how many of them a filter has to read."""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, StructField

from .tables import overwrite

RANK_BITS = 8


def as_number(field: StructField) -> Column:
    """A double in the order of the column: numbers as they are, times as seconds, texts by their first six bytes."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, BooleanType):
        return c.cast("int").cast("double")
    return c.cast("double") if isinstance(kind, NumericType) else c.cast("timestamp").cast("double")


def quantile_ranks(df: DataFrame, columns: list[str], bits: int = RANK_BITS, error: float = 0.001) -> tuple[DataFrame, dict[str, Column]]:
    """df with each column as a number, and per column its rank among 2 ** bits quantiles, spread over all of them.

    One pass over df finds the cuts (at most 2 ** bits a column reach the driver); a row's rank is a binary search. A column with few
    distinct values has fewer cuts and still uses the highest bits. Nulls have rank 0, with the smallest.
    """
    fields = [f for f in df.schema if f.name in columns]
    names = {f.name: f"_z{i}" for i, f in enumerate(fields)}
    held = df.withColumns({names[f.name]: as_number(f) for f in fields})
    inputs, outputs = list(names.values()), [f"{n}q" for n in names.values()]
    cutter = QuantileDiscretizer(inputCols=inputs, outputCols=outputs, numBuckets=2**bits, relativeError=error, handleInvalid="keep").fit(held.select(*inputs))
    ranked = cutter.transform(held).drop(*inputs)
    ranks = {}
    for (column, _), out, splits in zip(names.items(), outputs, cutter.getSplitsArray()):
        n = max(len(splits) - 1, 1)
        ranks[column] = F.when(F.col(out) >= n, 0).otherwise(F.floor(F.coalesce(F.col(out), F.lit(0)) * F.lit(2**bits / n))).cast("long")
    return ranked, {c: ranks[c] for c in columns}


def morton(ranks: list[Column], bits: int = RANK_BITS) -> Column:
    """The ranks' bits in turns, highest first: rows near in every column are near in the code."""
    code = F.lit(0).cast("long")
    for b in range(bits):
        for i, r in enumerate(ranks):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(r, b).bitwiseAND(1), b * len(ranks) + len(ranks) - 1 - i))
    return code


def cell_files(rows: dict[int, int], depth: int, parts: int) -> list[tuple[int, int, int]]:
    """(first prefix, end, files): cells of the code, halved until each is one file's share of the rows, in order.

    rows has the number of rows per prefix of `depth` bits. A half gets its share of the files, rounded; one that gets none goes
    with its neighbour. A single prefix that is worth several files is left as one cell of that many.
    """
    before = list(accumulate((rows.get(p, 0) for p in range(2**depth)), initial=0))

    def halve(lo: int, hi: int, files: int) -> list[tuple[int, int, int]]:
        if files == 1 or hi - lo == 1:
            return [(lo, hi, files)]
        mid = (lo + hi) // 2
        left = round(files * (before[mid] - before[lo]) / max(before[hi] - before[lo], 1))
        first = halve(lo, mid, left) if left else []
        other = halve(mid, hi, files - left) if left < files else []
        if not first:
            other[0] = (lo, *other[0][1:])
        elif not other:
            first[-1] = (first[-1][0], hi, first[-1][2])
        return first + other

    return halve(0, 2**depth, parts)


def overwrite_zordered(df: DataFrame, path: str, by: list[str], parts: int | None = None, bits: int = RANK_BITS) -> None:
    """Files by the Morton code of the columns' ranks: min and max skip files on each of `by`, not on the first alone.

    With `parts`, files are whole cells of the code, each near its share of the rows (cuts that are sampled fall inside cells, and a
    file on both sides of one covers much of either column). What is too much for a file within the smallest cell, and all rows
    where `parts` is not given, is range-partitioned by the code, the columns themselves, then a hash, so that no value is too large.
    """
    ranked, ranks = quantile_ranks(df, by, bits)
    coded = ranked.withColumn("_code", morton([ranks[c] for c in by], bits)).select("_code", *[F.col(f"`{c}`") for c in df.columns])
    order = [F.col("_code"), *[F.col(f"`{c}`") for c in by]]
    spread = [*order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    if not parts:
        overwrite(coded.repartitionByRange(*spread).sortWithinPartitions(*order).drop("_code"), path)
        return
    depth = min(bits * len(by), parts.bit_length() + 3)
    prefix = F.shiftright("_code", bits * len(by) - depth)
    counted = {r["p"]: r["n"] for r in coded.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}  # 16 prefixes a file at most
    cells = cell_files(counted, depth, parts)
    cell_of = ", ".join(str(i) for i, (lo, end, _) in enumerate(cells) for _ in range(lo, end))
    placed = coded.withColumn("_cell", F.element_at(F.expr(f"array({cell_of})"), (prefix + 1).cast("int")))
    large = [i for i, (_, _, files) in enumerate(cells) if files > 1]
    overwrite(placed.where(~F.col("_cell").isin(large)).repartitionById(len(cells), F.col("_cell")).sortWithinPartitions(*order).drop("_code", "_cell"), path)
    if large:
        rest = placed.where(F.col("_cell").isin(large)).repartitionByRange(sum(cells[i][2] for i in large), *spread)
        rest.sortWithinPartitions(*order).drop("_code", "_cell").write.mode("append").parquet(path)


def compact_zordered(spark: SparkSession, source: str, target: str, by: list[str], parts: int) -> None:
    """Rewrites a table along `by`, under another path."""
    overwrite_zordered(spark.read.parquet(source), target, by, parts)


def file_ranges(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """file, rows, and min and max of each column: what a filter can be judged by. One row per file."""
    bounds = [f(f"`{c}`").alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), *bounds)


def touched(ranges: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """asked (lo, hi, ...) with the files that a filter lo <= column <= hi reads, and of how many."""
    met = ranges.select("file", F.col(f"min_{column}").alias("_lo"), F.col(f"max_{column}").alias("_hi"))
    files = met.agg(F.collect_list(F.struct("file", "_lo", "_hi")).alias("_files"))  # one row per file
    hit = F.filter("_files", lambda f: (f["_hi"] >= F.col("lo")) & (f["_lo"] <= F.col("hi")))
    return asked.join(files).select(*asked.columns, F.transform(hit, lambda f: f["file"]).alias("files"), F.size("_files").alias("of_files"))


def even_ranges(df: DataFrame, column: str, n: int) -> DataFrame:
    """range, lo, hi: the column's values cut in n ranges of equal width, for asking."""
    c = F.col(f"`{column}`")
    width = F.col("b.hi") - F.col("b.lo")
    bounds = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("b"))
    cut = lambda i: F.col("b.lo") + F.floor(width * i / n)
    ranged = bounds.select("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("range"))
    return ranged.select("range", cut(F.col("range")).alias("lo"), F.when(F.col("range") == n - 1, F.col("b.hi")).otherwise(cut(F.col("range") + 1) - 1).alias("hi"))


def bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, sort: list[str]) -> None:
    """A catalog table whose rows are dealt in buckets of the key and sorted in them: joins and windows by the key need no shuffle."""
    df.repartition(buckets, F.col(key)).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *sort).option("path", path).saveAsTable(table)
