"""Ledger-shaped views of the given tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
START = 1_704_067_200  # 2024-01-01T00:00:00Z


def trades_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from the events table: a stream of small actors and few markets."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("bigint") % 100
    e = e.where(cents > 0).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    price = cents / F.lit(100.0)
    return e.select(
        F.col("event_id").alias("trade_id"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp_unix"),
        F.col("user_id").alias("wallet_id"),
        (F.col("k") % 20).alias("market_id"),
        (F.col("k") % 20 % 6).alias("component_id"),
        price.alias("price"),
        F.col("value").alias("size"),
        (F.col("value") * price).alias("notional_usd"),
        (F.col("event_id") % 2).alias("outcome_index"),
        F.when(F.col("event_type").isin("purchase", "click"), "BUY").otherwise("SELL").alias("side"),
    )


TRADES_EV = """trades AS (
  SELECT event_id AS trade_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp_unix, user_id AS wallet_id,
    k % 20 AS market_id, k % 20 % 6 AS component_id, cents / 100.0::DOUBLE AS price, value AS size,
    value * (cents / 100.0::DOUBLE) AS notional_usd, event_id % 2 AS outcome_index,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'BUY' ELSE 'SELL' END AS side
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) % 100 AS cents FROM events)
  WHERE cents > 0)"""


def trades_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from line items and orders: many markets, day-granular times with many ties."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    od = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    price = (1 + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 99) / F.lit(100.0)
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("timestamp_unix"),
        F.col("o_custkey").alias("wallet_id"),
        F.col("l_partkey").alias("market_id"),
        (F.col("l_partkey") % 97).alias("component_id"),
        price.alias("price"),
        F.col("l_quantity").alias("size"),
        (F.col("l_quantity") * price).alias("notional_usd"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 2).alias("outcome_index"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
    )


TRADES_LI = """trades AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trade_id, CAST(epoch(l_shipdate) AS BIGINT) AS timestamp_unix,
    o_custkey AS wallet_id, l_partkey AS market_id, l_partkey % 97 AS component_id,
    (1 + (l_orderkey * 7 + l_linenumber) % 99) / 100.0::DOUBLE AS price, l_quantity AS size,
    l_quantity * ((1 + (l_orderkey * 7 + l_linenumber) % 99) / 100.0::DOUBLE) AS notional_usd,
    (l_orderkey + l_linenumber) % 2 AS outcome_index, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def resolutions(trades: DataFrame) -> DataFrame:
    """One row per market: resolution_ts and payout0."""
    return trades.groupBy("market_id").agg((F.max("timestamp_unix") - DAY * (F.col("market_id") % 5)).alias("resolution_ts"), (F.col("market_id") % 2).alias("payout0"))


RESOLUTIONS = f"resolutions AS (SELECT market_id, max(timestamp_unix) - {DAY} * (market_id % 5) AS resolution_ts, market_id % 2 AS payout0 FROM trades GROUP BY market_id)"

#: id, first and end day (exclusive) of the four time splits; a day of embargo lies between them.
SPLITS = [("train", 0, 15), ("validation", 16, 21), ("calibration", 22, 25), ("test", 26, 30)]


def splits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, START + a * DAY, START + b * DAY) for i, a, b in SPLITS], "split string, start_ts bigint, end_ts bigint")


SPLITS_SQL = "splits(split, start_ts, end_ts) AS (VALUES " + ", ".join(f"('{i}', {START + a * DAY}, {START + b * DAY})" for i, a, b in SPLITS) + ")"


def schedules(trades: DataFrame) -> DataFrame:
    """Fee schedules: three intervals of ten days per market."""
    n = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    s = trades.select("market_id").distinct().withColumn("k", n)
    return s.select(
        F.concat_ws("-", "market_id", "k").alias("schedule_id"), "market_id", (F.lit(START) + F.col("k") * 10 * DAY).alias("from_ts"), (F.lit(START) + (F.col("k") + 1) * 10 * DAY).alias("to_ts"),
        (F.lit(0.02) + F.lit(0.01) * (F.col("market_id") % 5)).cast("decimal(8,6)").alias("rate"), (F.col("market_id") % 3).cast("int").alias("exponent"),
    )


SCHEDULES = f"""schedules AS (SELECT concat_ws('-', market_id, k) AS schedule_id, market_id, {START} + k * {10 * DAY} AS from_ts, {START} + (k + 1) * {10 * DAY} AS to_ts,
  CAST(0.02 + 0.01 * (market_id % 5) AS DECIMAL(8,6)) AS rate, market_id % 3 AS exponent FROM (SELECT DISTINCT market_id FROM trades), (VALUES (0), (1), (2)) AS o(k))"""
