"""Distinct counts from states that merge, and keys dealt by the residue of a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch, as a power of two; one standard error is 0.83 / sqrt(2**LG).
LG = 12


def residue(x: Column | str, n: int) -> Column:
    """A residue below n by the first 60 bits of MD5: a disjoint cover of the keys, alike in every engine."""
    x = F.col(x) if isinstance(x, str) else x
    return F.conv(F.substring(F.md5(F.lower(x.cast("string"))), 1, 15), 16, 10).cast("bigint") % n


def unit(x: Column | str) -> Column:
    """A deterministic number in [0, 1) of a key, by the first 52 bits of MD5."""
    x = F.col(x) if isinstance(x, str) else x
    return F.conv(F.substring(F.md5(x.cast("string")), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def daily_states(df: DataFrame, keys: list[str], day: Column, item: str, lg: int = LG) -> DataFrame:
    """keys, day, state, n_rows: one sketch of the items per key and day, to be kept and merged over any days."""
    return df.groupBy(*keys, day.alias("day")).agg(F.hll_sketch_agg(F.col(item).cast("bigint"), lg).alias("state"), F.count("*").alias("n_rows"))


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, estimate, n_rows, state from the states of any days."""
    by = states.groupBy(*keys).agg(F.hll_union_agg("state").alias("state"), F.sum("n_rows").alias("n_rows"))
    return by.select(*keys, F.hll_sketch_estimate("state").alias("estimate"), "n_rows", "state")


def standard_error(lg: int = LG) -> float:
    return 0.83 / 2 ** (lg / 2)
