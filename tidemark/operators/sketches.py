"""Quantiles from sketches that are kept per day and merged: no day's rows are read twice.

The sketches are Spark's KLL sketches of doubles; their rank error does not depend on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, and the share of all ranks by which a quantile of it may be off (some 99 times of 100; merged ones alike).
K, ERROR = 400, 0.01


def write_daily(rows: DataFrame, path: str, day: str, keys: list[str], value: str) -> None:
    """Adds the sketches of these rows' days: day, keys, sketch. A day that comes again replaces what stood for it."""
    made = rows.groupBy(day, *keys).agg(F.expr(f"kll_sketch_agg_double(cast(`{value}` as double), {K})").alias("sketch"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merged(daily: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the sketch of all days: a few kB a day and key are read."""
    return daily.groupBy(*keys).agg(F.expr(f"kll_merge_agg_double(sketch, {K})").alias("sketch"))


def quantile(sketch: str, fraction: float) -> Column:
    return F.expr(f"kll_sketch_get_quantile_double({sketch}, cast({fraction} as double))")


def size(sketch: str) -> Column:
    return F.expr(f"kll_sketch_get_n_double({sketch})")


def merged_quantiles(daily: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """keys, fractions and their quantiles over all days."""
    return merged(daily, keys).select(*keys, F.array(*map(F.lit, fractions)).alias("fractions"), F.array(*[quantile("sketch", f) for f in fractions]).alias("quantiles"))
