"""Reusable column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_pick(key: Column, salt: str, palette: list[str]) -> Column:
    """A deterministic pick from the palette by a hash of key and salt; repeat an entry to weigh it."""
    place = F.pmod(F.hash(key, F.lit(salt)), F.lit(len(palette))) + 1
    return F.element_at(F.array(*map(F.lit, palette)), place.cast("int"))


def hashed_key(key: Column, salt: str, n: int) -> Column:
    """A deterministic foreign key from 1 to n."""
    return F.pmod(F.hash(key, F.lit(salt)), F.lit(n)) + F.lit(1)


def keyed_uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1 by a hash of key and seed, wherever the row lies."""
    n = 1_000_003
    return (F.pmod(F.hash(key, F.lit(f"u{seed}")), F.lit(n)) + 0.5) / n


def exact_round(x: Column, places: int) -> Column:
    """Rounds half up through decimals, so that the last bit of a double doesn't decide a tie."""
    return F.round(x.cast("decimal(28,10)"), places).cast("double")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0 or either is null."""
    return F.try_divide(num, den)


def safe_rate(num: Column, den: Column, places: int = 6) -> Column:
    return exact_round(safe_ratio(num.cast("double"), den.cast("double")), places)


def as_int(flag: Column | str) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).cast("int")


def null_as_false(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def band(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first step whose bound is above value; `last` if none is, and for null."""
    chain = None
    for bound, label in steps:
        chain = F.when(value < bound, label) if chain is None else chain.when(value < bound, label)
    return chain.otherwise(last)


def amount_bucket(amount: Column) -> Column:
    return band(amount, [(10, "<10"), (100, "10-100"), (1000, "100-1K"), (10000, "1K-10K")], "10K+")


def column_or(columns: list[str], name: str, default) -> Column:
    """The column if the table has it, else the default: decided from the schema, without a scan."""
    return F.col(name) if name in columns else F.lit(default)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def is_night(hour: Column) -> Column:
    return (hour >= 0) & (hour < 6)
