"""As-of, interval and prior-event joins with strict visibility, written as windows or equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.plans.shared import cut


def strict_asof_sums(left: DataFrame, events: DataFrame, key: str, ts: str, event_ts: str, sums: dict[str, Column], order: str) -> DataFrame:
    """left with running sums over the events of its key that are strictly before it.

    Both sides are united; at equal times a left row sorts before an event, so the event stays invisible.
    One shuffle by the key, no range join.
    """
    names = left.columns
    a = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_kind"), F.col(order).alias("_o"), F.struct(*names).alias("_row"), *(F.lit(None).cast("double").alias(f"_v_{n}") for n in sums))
    b = events.select(F.col(key).alias("_k"), F.col(event_ts).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(left.schema[order].dataType).alias("_o"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *(v.cast("double").alias(f"_v_{n}") for n, v in sums.items()))
    w = W.partitionBy("_k").orderBy("_t", "_kind", "_o").rowsBetween(W.unboundedPreceding, W.currentRow)
    u = a.unionByName(b)
    u = u.select("_kind", "_row", *(F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0.0)).alias(n) for n in sums))
    return u.where("_kind = 0").select("_row.*", *sums)


def additive_asof(deltas: DataFrame, key: str, available: str, values: list[str]) -> DataFrame:
    """Running totals of deltas per key by availability, each valid in [valid_from, valid_to)."""
    w = W.partitionBy(key).orderBy(available)
    d = deltas.groupBy(key, available).agg(*(F.sum(v).alias(v) for v in values))
    return d.select(key, F.col(available).alias("valid_from"), F.lead(available).over(w).alias("valid_to"), *(F.sum(v).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(v) for v in values))


def forward_asof(df: DataFrame, key: str, ts: str, value: Column, order: str, leads: dict[str, tuple[int, int]]) -> DataFrame:
    """df with, for each name: (horizon, tolerance), the first non-null value at [ts + horizon, ts + horizon + tolerance].

    Of the values of a time, the first by `order` counts. Times of a key and their questions meet in one running
    window, backwards and inside buckets of time: its work does not grow with the rows that a tolerance holds, and no
    key is one task's work.
    """
    most = max(tolerance for _, tolerance in leads.values())
    width = max(4 * most, 86_400)
    points = df.dropna(subset=[key, ts]).groupBy(F.col(key).alias("_k"), F.col(ts).cast("bigint").alias("_t")).agg(F.min_by(value, F.when(value.isNotNull(), F.col(order))).alias("_v"))
    points = cut(points, "points")
    bucket = F.floor(F.col("_at") / width)
    none, hit = F.lit(None).cast("int"), F.struct(F.col("_t").alias("at"), F.col("_v").alias("v"))
    # a question looks into its own bucket and the start of the next, whose values are listed in both
    values = points.where("_v is not null").select("_k", "_t", F.col("_t").alias("_at"), none.alias("_i"), hit.alias("_hit"))
    values = values.withColumn("_b", F.explode(F.when(F.col("_at") - bucket * width <= most, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))))
    asked = points.select("_k", "_t", F.posexplode(F.array(*(F.col("_t") + h for h, _ in leads.values()))).alias("_i", "_at"), F.lit(None).cast(values.schema["_hit"].dataType).alias("_hit"))
    asked = asked.withColumn("_b", bucket).select(*values.columns)
    w = W.partitionBy("_k", "_b").orderBy(F.desc("_at"), F.asc_nulls_first("_i")).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = values.unionByName(asked).withColumn("_next", F.last("_hit", ignorenulls=True).over(w)).where("_i is not null")
    found = met.groupBy("_k", "_t").agg(*(F.max(F.when((F.col("_i") == i) & (F.col("_next.at") <= F.col("_at") + tolerance), F.col("_next.v"))).alias(name) for i, (name, (_, tolerance)) in enumerate(leads.items())))
    return df.join(found, (F.col(key) == F.col("_k")) & (F.col(ts) == F.col("_t")), "left").drop("_k", "_t")


def interval_lookup(left: DataFrame, right: DataFrame, key: str, ts: str, start: str, end: str, bucket: int) -> DataFrame:
    """left with the columns of the interval [start, end) of its key that holds its time, or nulls.

    Intervals are listed under the time buckets they touch, so that the join is an equi-join on key and
    bucket with a residual check instead of all intervals of a key against all its rows.
    """
    spans = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket)))).withColumnRenamed(key, "_k")
    a = left.withColumn("_lb", F.floor(F.col(ts) / bucket))
    on = (F.col(key) == F.col("_k")) & (F.col("_lb") == F.col("_b")) & (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))
    return a.join(spans, on, "left").drop("_k", "_b", "_lb")


def overlaps(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended."""
    w = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    return intervals.withColumn("_last", F.max(end).over(w)).where(F.col("_last") > F.col(start)).drop("_last")


def split_by_epochs(windows: DataFrame, epochs: DataFrame, key: str) -> DataFrame:
    """Hull per key and epoch of the windows' parts in it; epochs(epoch, e_start, e_end) is a fixed short list."""
    x = windows.join(F.broadcast(epochs), (F.col("start_ts") < F.col("e_end")) & (F.col("end_ts") > F.col("e_start")))
    return x.groupBy(key, "epoch").agg(F.min(F.greatest("start_ts", "e_start")).alias("start_ts"), F.max(F.least("end_ts", "e_end")).alias("end_ts"))


def last_of_other(df: DataFrame, key: str, other: str, value: str, order: list[str]) -> DataFrame:
    """Adds donor: the value of the latest earlier row of the key whose `other` differs.

    Inside a run of equal `other`, that is the row before the run: found with two running windows.
    """
    w = W.partitionBy(key).orderBy(*order)
    changed = F.lag(other).over(w) != F.col(other)
    before = F.when(changed, F.struct(F.lag(value).over(w).alias("v")))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_d", before)
    return df.withColumn("donor", F.last("_d", ignorenulls=True).over(upto)["v"]).drop("_d")
