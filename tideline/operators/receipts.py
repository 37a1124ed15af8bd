"""Receipts of collected ranges and proofs of transactions: coverage, spans, merging by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import canonical
from tideline.plans.shared import cut


def _joined(df: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """Half-open ranges of a key that overlap or touch, as one; counts are aggregated."""
    before = F.max("end_ts").over(W.partitionBy(*keys).orderBy("start_ts", "end_ts").rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col("start_ts") > before, 1).otherwise(0))
    numbered = marked.withColumn("_k", F.sum("_new").over(W.partitionBy(*keys).orderBy("start_ts", "end_ts").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(*keys, "_k").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), *(v.alias(k) for k, v in counts.items())).drop("_k")


def islands(df: DataFrame, keys: list[str], width: int, count: str = "n") -> DataFrame:
    """keys, start_ts, end_ts, n: ranges of df(keys, start_ts, end_ts) joined where they overlap or touch.

    Ranges are half-open; empty ones and ones with a null end or key count for nothing. They are joined inside buckets of
    `width` first, by their start, so a key that holds most ranges is not one task's work; the second step joins the
    few islands of all buckets of a key.
    """
    usable = df.where("start_ts < end_ts").dropna(subset=keys).select(*keys, "start_ts", "end_ts").groupBy(*keys, "start_ts", "end_ts").agg(F.count("*").alias(count))
    inner = _joined(usable.withColumn("_b", F.floor(F.col("start_ts") / width)), [*keys, "_b"], {count: F.sum(count)})
    return _joined(inner.drop("_b"), keys, {count: F.sum(count)})


def range_audit(receipts: DataFrame, spans: DataFrame, scope: str, width: int) -> DataFrame:
    """scope, kind, start_ts, end_ts, n: how receipts(scope, start_ts, end_ts) cover each scope's span.

    Kinds: `covered` (an island of adjoining ranges; n receipts), `missing` (of the span, in no range), `overlap` (in more
    than one different range; n at most), `repeated` (a range that has n receipts), `outside` (a range that leaves the
    span or has none). Ranges and spans are half-open; a scope has one span.
    """
    ranges = cut(receipts.where("start_ts < end_ts").groupBy(scope, "start_ts", "end_ts").agg(F.count("*").alias("n")), "ranges")
    repeated = ranges.where("n > 1").select(scope, F.lit("repeated").alias("kind"), "start_ts", "end_ts", "n")
    span = spans.select(scope, F.col("start_ts").alias("_a"), F.col("end_ts").alias("_z"))
    outside = ranges.join(span, scope, "left").where("_a is null or start_ts < _a or end_ts > _z").select(scope, F.lit("outside").alias("kind"), "start_ts", "end_ts", "n")
    covered = cut(islands(receipts, [scope], width), "islands")
    # holes: before the first island, between neighbours, behind the last one
    inside = covered.join(span, scope).where("end_ts > _a and start_ts < _z")
    order = W.partitionBy(scope).orderBy("start_ts")
    holes = inside.select(scope, F.coalesce(F.lag("end_ts").over(order), F.col("_a")).alias("start_ts"), F.col("start_ts").alias("end_ts"))
    last = span.join(inside.groupBy(scope).agg(F.max("end_ts").alias("_m")), scope, "left").select(scope, F.coalesce("_m", "_a").alias("start_ts"), F.col("_z").alias("end_ts"))
    missing = holes.unionByName(last).where("start_ts < end_ts").select(scope, F.lit("missing").alias("kind"), "start_ts", "end_ts", F.lit(0).cast("bigint").alias("n"))
    # depth changes at the ends of ranges; a stretch of depth 2 and more is an overlap
    edges = ranges.select(scope, F.explode(F.array(F.struct(F.col("start_ts").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_ts").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(scope, F.col("e.at").alias("start_ts")).agg(F.sum("e.d").alias("d"))
    by = W.partitionBy(scope).orderBy("start_ts")
    depth = steps.withColumn("depth", F.sum("d").over(by)).withColumn("end_ts", F.lead("start_ts").over(by)).where("depth > 1")
    overlap = _joined(depth.select(scope, "start_ts", "end_ts", "depth"), [scope], {"n": F.max("depth")}).select(scope, F.lit("overlap").alias("kind"), "start_ts", "end_ts", F.col("n").cast("bigint").alias("n"))
    return covered.select(scope, F.lit("covered").alias("kind"), "start_ts", "end_ts", "n").unionByName(missing).unionByName(overlap).unionByName(repeated).unionByName(outside)


def merge_proofs(proofs: DataFrame, key: str, order: str, scalars: list[str], logs: str = "logs") -> DataFrame:
    """One row per key (lower case): scalars, logs, n_proofs and conflicts.

    Proofs of a key must agree in all scalars, null included; `conflicts` names those in which they differ, and their
    value is null then. Logs are united by content (their canonical digest): each once, in the order in which proofs (by
    `order`) and their places first show it. A key's different logs are those of one transaction, which are few; copies in
    further proofs are combined before they meet.
    """
    df = cut(proofs.select(F.lower(key).alias(key), order, *scalars, logs), "proofs")  # read twice
    text = {c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in scalars}
    by = df.groupBy(key).agg(F.count("*").alias("n_proofs"), *(F.min(F.struct(text[c].alias("t"), F.col(c).alias("v"))).alias(f"_a_{c}") for c in scalars), *(F.max(text[c]).alias(f"_z_{c}") for c in scalars))
    differs = {c: F.col(f"_a_{c}.t") != F.col(f"_z_{c}") for c in scalars}
    one = by.select(key, "n_proofs", *(F.when(~differs[c], F.col(f"_a_{c}.v")).alias(c) for c in scalars), F.filter(F.array(*(F.when(differs[c], F.lit(c)) for c in scalars)), lambda x: x.isNotNull()).alias("conflicts"))
    item = proofs.schema[logs].dataType.elementType
    each = df.select(key, order, F.posexplode(logs).alias("_p", "log")).where("log is not null").withColumn("_h", canonical.digest(F.col("log"), item))
    first = each.groupBy(key, "_h").agg(F.min(F.struct(F.col(order).alias("o"), "_p", "_h")).alias("at"), F.any_value("log").alias("log"))
    united = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "log"))), lambda x: x["log"]).alias(logs))
    return one.join(united, key, "left").withColumn(logs, F.coalesce(logs, F.array().cast(proofs.schema[logs].dataType)))


def replay_targets(audits: DataFrame, horizon: int, width: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """spans(condition_id, start_ts, end_ts, n) and references(ref, condition_id, timestamp_unix) of what was replayed.

    audits(kind, id, condition_id, timestamp_unix, expires_unix, ref, order_id): an `order` covers its time up to and
    with its expiry, a `decision` the horizon after it (repeated decisions once), a `miss` its second; a `fill` covers
    nothing and refers to its order's condition. A fill without an order is an error. Windows of a condition are joined
    to spans, references are different ones.
    """
    orders = audits.where("kind = 'order'")
    decisions = audits.where("kind = 'decision'").groupBy("id").agg(F.min_by(F.struct("condition_id", "timestamp_unix", "ref"), F.struct("timestamp_unix", "ref")).alias("d")).select("d.*")
    misses = audits.where("kind = 'miss'")
    at, name = F.col("timestamp_unix"), F.lower("condition_id").alias("condition_id")
    windows = (
        orders.select(name, at.alias("start_ts"), (F.col("expires_unix") + 1).alias("end_ts"))
        .unionByName(decisions.select(name, at.alias("start_ts"), (at + horizon).alias("end_ts")))
        .unionByName(misses.select(name, at.alias("start_ts"), (at + 1).alias("end_ts")))
    )
    of = orders.groupBy("id").agg(F.any_value("condition_id").alias("c")).withColumnRenamed("id", "order_id")
    fills = audits.where("kind = 'fill'").join(of, "order_id", "left")
    checked = fills.select("ref", F.when(F.col("c").isNull(), F.raise_error(F.concat(F.lit("fill without an order: "), F.coalesce("ref", F.lit("?"))))).otherwise(F.lower("c")).alias("condition_id"), "timestamp_unix")
    refs = orders.unionByName(misses).select("ref", name, "timestamp_unix").unionByName(decisions.select("ref", name, "timestamp_unix")).unionByName(checked)
    return islands(windows, ["condition_id"], width), refs.distinct()
