"""Total order, duplicates, selections and partitions of ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.plans.shared import cut, partitions

ORDER = ["timestamp_unix", "trade_id"]


def running(*keys: str, order: list[str] = ORDER) -> W:
    """From the first row of the key to the current one, in total order."""
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def keyed(*keys: str, order: list[str] = ORDER) -> W:
    return W.partitionBy(*keys).orderBy(*order)


def occurrence(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """Number (from 0) of each row among those with equal keys."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def keep_one(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def regressions(df: DataFrame, key: str, seen: list[str], ts: str = "timestamp_unix") -> DataFrame:
    """Rows whose time is before their predecessor's in the order they were seen."""
    before = F.lag(ts).over(W.partitionBy(key).orderBy(*seen))
    return df.withColumn("_before", before).where(F.col("_before") > F.col(ts)).drop("_before")


def global_rank(df: DataFrame, order: list[str], bucket: Column, name: str = "rank") -> DataFrame:
    """Rank from 0 in a total order without a single-partition window.

    `bucket` must not decrease along the order (a date of a time order); ranks are counted inside buckets
    and shifted by the counts of the buckets before, of which there are few.
    """
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy("_b").agg(F.count("*").alias("_c"))
    shift = sizes.withColumn("_s", F.coalesce(F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inner = F.row_number().over(W.partitionBy("_b").orderBy(*order)) - 1
    return df.withColumn(name, inner).join(shift, "_b").withColumn(name, F.col(name) + F.col("_s")).drop("_b", "_s")


def split_rank(df: DataFrame, keys: list[str], order: list[Column | str], bucket: Column, name: str = "rank") -> DataFrame:
    """Rank from 0 inside each key, in two levels: a key that holds most rows is as many tasks as it has buckets.

    `bucket` must not decrease along the order inside a key: the leading bits of a hash, a range of ids.
    """
    df = df.withColumn("_b", bucket)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    shift = sizes.select(*keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    inner = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return df.withColumn(name, inner).join(shift, [*keys, "_b"]).withColumn(name, F.col(name) + F.col("_s")).drop("_b", "_s")


def range_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Rank from 0 in a total order of any columns, without a bucket that fits the data.

    Rows are dealt by ranges of the order, which Spark samples, so hot days or values are cut like all else, and
    written: ranks are counted inside ranges and shifted by those before. Rows that are equal in `order` are ranked
    in any order, and should be few.
    """
    dealt = cut(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    shift = dealt.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    return dealt.withColumn(name, F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1).join(F.broadcast(shift), "_p").withColumn(name, F.col(name) + F.col("_s")).drop("_p", "_s")


def spread_sample(df: DataFrame, order: list[str], bucket: Column, most: int) -> DataFrame:
    """At most `most` rows, evenly spread along the order: those at floor(i * n / most)."""
    n = df.count()
    if n <= most:
        return df
    ranked = global_rank(df, order, bucket, "_r")
    # r is floor(i * n / most) for some i exactly if i = ceil(r * most / n) gives it back
    i = F.ceil(F.col("_r") * most / F.lit(n))
    return ranked.where((F.floor(i * n / most) == F.col("_r")) & (i < most)).drop("_r")


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(max(1, n))


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def integer_windows(df: DataFrame, start: str, end: str, parts: int) -> DataFrame:
    """Each [start, end) cut into `parts` at start + length * i div parts."""
    length = F.col(end) - F.col(start)
    df = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def edge(i: Column) -> Column:
        return F.col(start) + F.floor(length * i / parts)

    return df.withColumn("part_start", edge(F.col("part"))).withColumn("part_end", edge(F.col("part") + 1))


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted but not found; a fail-closed join needs this to be empty."""
    return wanted.select(key).distinct().join(found.select(key), key, "left_anti")


def require_none(violations: DataFrame, what: str) -> None:
    """Raises if there is a row; reads one row at most."""
    row = violations.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises where a key of the left side has no partner."""
    require_none(missing(left, right, key), f"no match for {key}")
    return left.join(right, key)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys matched, only left, only right, repeated left, repeated right."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    j = a.join(b, key, "full_outer")
    return j.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"),
        F.count_if(F.col("a") > 1).alias("repeated_left"), F.count_if(F.col("b") > 1).alias("repeated_right"),
    )


def time_partition(df: DataFrame, component: str, ts: str, fraction: float) -> DataFrame:
    """component, anchor, side ('fit' or 'selection'): whole components in the order of their last time."""
    by = df.groupBy(component).agg(F.max(ts).alias("anchor"))
    n = by.count()
    k = min(n - 1, max(1, int(n * fraction))) if n > 1 else n
    placed = range_rank(by, ["anchor", component])
    return placed.withColumn("side", F.when(F.col("rank") < k, "fit").otherwise("selection")).drop("rank")
