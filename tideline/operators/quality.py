"""Profiles and plans that must hold: row predicates of a ledger, segments of a split plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a ledger row must say, and the least notional that is collected.
REQUIRED = ("schema_version", "record_type", "source", "trade_id", "condition_id", "token_id", "wallet", "side", "price", "size", "notional_usd", "timestamp", "timestamp_unix", "transaction_hash")
LEAST_NOTIONAL = 25
BUCKETS = (1, 5, 10, 20, 25)


def ledger_predicates(start: int, end: int) -> dict[str, Column]:
    """Faults of a ledger row by name; every one is true or false, also for nulls.

    Prices, sizes and notionals are decimal texts; start and end bound the window (half-open).
    """

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    def number(c: str) -> Column:
        return F.col(c).cast("string").try_cast("decimal(28,10)")

    price, size, notional = number("price"), number("size"), number("notional_usd")
    ts = F.col("timestamp_unix").cast("string").try_cast("bigint")
    valid = price.isNotNull() & (price > 0) & (price < 1)
    below = (notional > 0) & (notional < LEAST_NOTIONAL)
    plain, complement = size * price, size * (1 - price)
    out = {
        "invalid_trade_id": ~text("trade_id").rlike("^[a-f0-9]{64}$"), "invalid_condition_id": ~text("condition_id").rlike("^0x[a-f0-9]{64}$"), "invalid_wallet": ~text("wallet").rlike("^0x[a-f0-9]{40}$"),
        "invalid_transaction_hash": ~text("transaction_hash").rlike("^0x[a-f0-9]{64}$"), "invalid_token_id": ~text("token_id").rlike("^[0-9]+$"), "invalid_side": ~text("side").isin("BUY", "SELL"),
        "invalid_schema_version": text("schema_version") != "1.0.0", "invalid_record_type": text("record_type") != "public_trade", "invalid_price": ~valid, "invalid_size": ~(size > 0), "invalid_notional": ~(notional > 0),
        "notional_below_filter": below, "below_with_large_size": below & (size >= LEAST_NOTIONAL), "below_with_large_complement": below & (complement >= LEAST_NOTIONAL), "below_with_either_large": below & (F.greatest(plain, complement) >= LEAST_NOTIONAL),
        "inconsistent_notional": plain != notional, "invalid_timestamp": ts.isNull(), "timestamp_outside_window": ~((ts >= start) & (ts < end)) & ts.isNotNull(),
        "timestamp_text_mismatch": ts.isNotNull() & ~F.col("timestamp").eqNullSafe(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "outcome_null": F.col("outcome").isNull(), "outcome_index_null": F.col("outcome_index").isNull(),
    }
    out |= {f"missing_{c}": text(c) == "" for c in REQUIRED}
    # what cannot be told because a number is missing is a fault where a valid one is asked for, and none elsewhere
    asked = ("invalid_price", "invalid_size", "invalid_notional")
    return {k: F.coalesce(v, F.lit(k in asked)) for k, v in out.items()}


def ledger_profile(rows: DataFrame, start: int, end: int, file: str, order: str) -> DataFrame:
    """One row: rows, distinct ids, repeats, steps back in time inside files, faults by name, extremes, rows below the filter by notional.

    Faults are counted in one pass; ids by their own aggregation, and each file's times in its order.
    """
    ts = F.col("timestamp_unix").cast("string").try_cast("bigint")
    notional = F.col("notional_usd").cast("string").try_cast("decimal(28,10)")
    price = F.col("price").cast("string").try_cast("decimal(28,10)")
    below = (notional > 0) & (notional < LEAST_NOTIONAL)
    bucket = {f"below_lt_{hi}": below & (notional >= lo) & (notional < hi) for lo, hi in zip((0, *BUCKETS), BUCKETS)}
    previous = F.lag(ts).over(W.partitionBy(file).orderBy(order))
    checked = rows.select(file, order, *(F.col(c) for c in dict.fromkeys((*REQUIRED, "outcome", "outcome_index"))), ts.alias("_ts")).withColumn("_back", F.coalesce(previous > F.col("_ts"), F.lit(False)))
    faults = checked.agg(
        F.count("*").alias("n_rows"), F.count_if("_back").alias("file_order_violations"), *(F.count_if(v).alias(k) for k, v in ledger_predicates(start, end).items()), *(F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in bucket.items()),
        F.min(F.when((price > 0) & (price < 1), price)).cast("double").alias("minimum_price"), F.max(price).cast("double").alias("maximum_price"), F.min("_ts").alias("minimum_timestamp"), F.max("_ts").alias("maximum_timestamp"),
    )
    ids = rows.groupBy(F.coalesce(F.col("trade_id").cast("string"), F.lit("")).alias("i")).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_ids"))
    return faults.join(ids)  # one row each


def plan_violations(plan: DataFrame, *keys: str, embargo: int) -> DataFrame:
    """keys, segment, problem of split plans(keys, segment, start_ts, end_ts): repeated segments, no length, an embargo that is not exact.

    Segments follow each other by start, and `embargo` lies between the end of one (exclusive) and the start of the next.
    """
    by = W.partitionBy(*keys).orderBy("start_ts", "end_ts", "segment")
    last = F.lag("end_ts").over(by)
    repeated = F.count("*").over(W.partitionBy(*keys, "segment")) > 1
    checks = {"repeated": repeated, "no length": F.coalesce(F.col("start_ts") >= F.col("end_ts"), F.lit(True)), "embargo": F.coalesce(last + embargo != F.col("start_ts"), F.lit(False))}
    found = plan.select(*keys, "segment", F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())), lambda x: x.isNotNull()).alias("p"))
    return found.select(*keys, "segment", F.explode("p").alias("problem")).distinct()


def locate(df: DataFrame, plan: DataFrame, ts: str, *keys: str) -> DataFrame:
    """df with the segment that holds its time (half-open), or null; a plan has few segments a key."""
    segments = plan.groupBy(*keys).agg(F.collect_list(F.struct("start_ts", "end_ts", "segment")).alias("_plan"))
    j = df.join(segments, list(keys), "left")
    hit = F.filter("_plan", lambda s: (s["start_ts"] <= F.col(ts)) & (F.col(ts) < s["end_ts"]))
    return j.withColumn("segment", F.get(hit, F.lit(0))["segment"]).drop("_plan")
