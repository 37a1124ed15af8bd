"""Queries of digests, positional joins, economic metrics, upserts, proofs and coverage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import asof, distinct, evaluate, order
from tideline.plans.queries_ledger import EV, LI, ORIENTED, oriented
from tideline.plans.catalog import query
from tideline.plans.shared import cut
from tideline.plans.views import DAY, SCHEDULES, START, schedules, trades_ev, trades_li


@query(f"{EV} SELECT trade_id, sha256(concat_ws('|', 'v1', trade_id, wallet_id, market_id, side)) AS digest, substr(sha256('17|' || trade_id), 1, 8) AS short FROM trades")
def c16_c37_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    return t.select("trade_id", S.stable_id(F.lit("v1"), "trade_id", "wallet_id", "market_id", "side").alias("digest"), F.substring(S.stable_id(F.lit(17), "trade_id"), 1, 8).alias("short"))


@query(f"""{EV}, s AS (SELECT *, (timestamp_unix - {START}) // {DAY} AS shard, row_number() OVER (PARTITION BY (timestamp_unix - {START}) // {DAY} ORDER BY timestamp_unix, trade_id) - 1 AS stream_row FROM trades),
d AS (SELECT shard, stream_row, trade_id FROM s) SELECT d.shard, d.stream_row, s.trade_id = d.trade_id AS verified, s.wallet_id, count(*) OVER (PARTITION BY s.wallet_id) AS decisions_of_wallet FROM d JOIN s USING (shard, stream_row)""")
def e08_e19_e22_positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursor rows (one for every trade) that point into day shards by row number, joined and verified by trade id."""
    t = trades_ev(spark, sf_dir).withColumn("shard", F.floor((F.col("timestamp_unix") - START) / DAY))
    s = t.withColumn("stream_row", (F.row_number().over(W.partitionBy("shard").orderBy(*order.ORDER)) - 1).cast("bigint"))
    d = s.select("shard", "stream_row", F.col("trade_id").alias("evidence"))
    j = d.join(s, ["shard", "stream_row"])
    return j.select("shard", "stream_row", (F.col("trade_id") == F.col("evidence")).alias("verified"), "wallet_id", F.count("*").over(W.partitionBy("wallet_id")).alias("decisions_of_wallet"))


_ECON = "e AS (SELECT component_id, price, ln(greatest(1 - 0.05 + 0.05 / price * outcome_index, 1e-8)) AS target, (wallet_id % 21 - 10) / 200.0 AS predicted, 1 + wallet_id % 3 AS w FROM trades)"


@query(f"{EV}, {_ECON}, g AS (SELECT component_id, sum(w * target) / sum(w) AS m FROM e GROUP BY 1), k AS (SELECT m, row_number() OVER (ORDER BY m, component_id) AS k, count(*) OVER () AS n FROM g) "
    "SELECT count(*) AS n, round(sum(CASE WHEN predicted > 0 THEN w ELSE 0 END) / sum(w)::DOUBLE, 6) AS keep_rate, round(sum(w * abs(predicted - target)) / sum(w), 6) AS mae, round(sum(CASE WHEN price >= 0.5 THEN w * target END) / sum(CASE WHEN price >= 0.5 THEN w END), 6) AS high_price, "
    "round(sum(CASE WHEN price < 0.5 THEN w * target END) / sum(CASE WHEN price < 0.5 THEN w END), 6) AS low_price, (SELECT round(avg(m), 6) FROM k WHERE k <= ceil(n * 0.2)) AS tail FROM e")
def f09_economic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    e = t.select("component_id", "price", S.log_utility(F.lit(0.05), 1 / F.col("price"), "outcome_index").alias("target"), ((F.col("wallet_id") % 21 - 10) / F.lit(200.0)).alias("predicted"), (1 + F.col("wallet_id") % 3).alias("w"))
    w, y, high = F.col("w"), F.col("target"), F.col("price") >= 0.5
    tail = evaluate.group_tail(e, "component_id", y, w, 0.2).select(F.round("tail", 6).alias("tail"))
    m = e.agg(
        F.count("*").alias("n"), F.round(F.sum(F.when(F.col("predicted") > 0, w).otherwise(0)) / F.sum(w), 6).alias("keep_rate"), F.round(evaluate.weighted_mean(F.abs(F.col("predicted") - y), w), 6).alias("mae"),
        F.round(F.sum(F.when(high, w * y)) / F.sum(F.when(high, w)), 6).alias("high_price"), F.round(F.sum(F.when(~high, w * y)) / F.sum(F.when(~high, w)), 6).alias("low_price"),
    )
    return m.join(tail)  # one row each


@query(f"""{EV}, {ORIENTED}, u AS (SELECT market_id, timestamp_unix, arg_min(p0, trade_id) AS p FROM o GROUP BY ALL), t AS (SELECT o.market_id, (SELECT arg_min(u.p, u.timestamp_unix) FROM u WHERE u.market_id = o.market_id AND u.timestamp_unix BETWEEN o.timestamp_unix + 3600 AND o.timestamp_unix + 7200) - o.p0 AS y, (o.trade_id % 7 - 3) / 10.0 AS f FROM o)
SELECT market_id, count(y) AS n, round(avg(abs(f - y)) FILTER (WHERE y IS NOT NULL), 6) AS mae, round(avg(abs(y)), 6) AS zero_mae FROM t GROUP BY 1""")
def f13_masked_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cut(oriented(trades_ev(spark, sf_dir)).select("trade_id", "market_id", "timestamp_unix", "p0"), "prices")
    t = asof.forward_asof(t, "market_id", "timestamp_unix", F.col("p0"), "trade_id", {"later": (3600, 3600)})
    t = t.withColumn("y", F.col("later") - F.col("p0")).withColumn("f", (F.col("trade_id") % 7 - 3) / F.lit(10.0))
    return t.groupBy("market_id").agg(F.count("y").alias("n"), F.round(F.avg(F.abs(F.col("f") - F.col("y"))), 6).alias("mae"), F.round(F.avg(F.abs("y")), 6).alias("zero_mae"))


@query(f"{LI}, p AS (SELECT wallet_id, wallet_id % 4 AS r, wallet_id % 8 AS r2 FROM trades) SELECT r, r2, count(*) AS n, count(DISTINCT wallet_id) AS wallets, r2 % 4 = r AS nested FROM p GROUP BY ALL")
def g06_g07_residue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue r modulo n falls apart into r and r + n modulo 2 n: a disjoint cover."""
    p = trades_li(spark, sf_dir).select("wallet_id", (F.col("wallet_id") % 4).alias("r"), (F.col("wallet_id") % 8).alias("r2"))
    return p.groupBy("r", "r2").agg(F.count("*").alias("n"), F.countDistinct("wallet_id").alias("wallets")).withColumn("nested", F.col("r2") % 4 == F.col("r"))


@query(f"{LI} SELECT trade_id, row_number() OVER (ORDER BY timestamp_unix, trade_id) - 1 AS rank FROM trades")
def i01_i02_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every trade in the total order: ranks inside ranges of it, shifted by the ranges before."""
    return order.range_rank(trades_li(spark, sf_dir).select("trade_id", "timestamp_unix"), order.ORDER).select("trade_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"{EV}, {SCHEDULES}, n AS (SELECT market_id, timestamp_unix, from_ts FROM trades LEFT JOIN (SELECT * FROM schedules WHERE market_id % 7 <> 3) s USING (market_id) WHERE s.from_ts IS NULL OR (timestamp_unix >= from_ts AND timestamp_unix < to_ts)) SELECT market_id, count(*) AS trades, count(from_ts) AS covered, count(*) = count(from_ts) AS complete FROM n GROUP BY 1")
def m08_fee_book_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    book = schedules(t).where("market_id % 7 <> 3")
    j = asof.interval_lookup(t, book, "market_id", "timestamp_unix", "from_ts", "to_ts", 10 * DAY)
    by = j.groupBy("market_id").agg(F.count("*").alias("trades"), F.count("from_ts").alias("covered"))
    return by.withColumn("complete", F.col("trades") == F.col("covered"))


@query(f"{EV} SELECT DISTINCT sha256(concat_ws('|', 'zero', market_id)) AS schedule_id, market_id, {START} AS effective_from, {START + 5 * DAY} AS effective_to, 0::DOUBLE AS rate FROM trades WHERE timestamp_unix < {START + 5 * DAY}")
def m09_zero_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trades_ev(spark, sf_dir).where(F.col("timestamp_unix") < START + 5 * DAY).select("market_id").distinct()
    return m.select(S.stable_id(F.lit("zero"), "market_id").alias("schedule_id"), "market_id", F.lit(START).alias("effective_from"), F.lit(START + 5 * DAY).alias("effective_to"), F.lit(0.0).alias("rate"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS versions, count(DISTINCT l_partkey) > 1 AS conflict, max(l_partkey) AS part FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def b10_b15_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated proofs of a key: equal ones merge, others are conflicts."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    by = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("versions"), (F.countDistinct("l_partkey") > 1).alias("conflict"), F.max("l_partkey").alias("part"))
    return by.where("versions > 1")


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(last, 0) AS last_order FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def b09_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a key after both halves of a ledger, by merging partial aggregates as an upsert would."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_custkey", "c_custkey")
    halves = [o.where(f"o_orderkey % 2 = {k}").groupBy("c_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last")) for k in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("c_custkey").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return c.join(merged, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("last", F.lit(0)).alias("last_order"))


@query(f"{EV} SELECT market_id, count(DISTINCT outcome_index) = 2 AS two_outcomes, count(*) - count(DISTINCT trade_id) AS repeats, min(timestamp_unix) AS first_ts FROM trades WHERE timestamp_unix < {START + 16 * DAY} GROUP BY 1")
def a22_tape_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir).where(F.col("timestamp_unix") < START + 16 * DAY)
    return t.groupBy("market_id").agg((F.countDistinct("outcome_index") == 2).alias("two_outcomes"), (F.count("*") - F.countDistinct("trade_id")).alias("repeats"), F.min("timestamp_unix").alias("first_ts"))


@query(f"{EV} SELECT market_id, ref, kind FROM (SELECT market_id, trade_id AS ref, 'decision' AS kind FROM trades UNION SELECT market_id, trade_id, 'order' FROM trades WHERE side = 'BUY' UNION SELECT market_id, trade_id, 'fill' FROM trades WHERE side = 'BUY' AND price < 0.5)")
def l09_replay_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three projections of one pass over the trades."""
    i = F.col("trade_id")
    ordered = F.col("side") == "BUY"
    kinds = F.filter(F.array(F.lit("decision"), F.when(ordered, F.lit("order")), F.when(ordered & (F.col("price") < 0.5), F.lit("fill"))), lambda k: k.isNotNull())
    return trades_ev(spark, sf_dir).select("market_id", i.alias("ref"), F.explode(kinds).alias("kind")).distinct()


@query(f"{EV} SELECT market_id, round(sum(notional_usd), 4) AS volume, count(*) FILTER (WHERE side = 'BUY') > 0 AND count(*) FILTER (WHERE side = 'SELL') > 0 AS two_sided, max(timestamp_unix) >= {START + 29 * DAY} AS active FROM trades GROUP BY 1 HAVING max(timestamp_unix) >= {START + 29 * DAY} AND count(DISTINCT outcome_index) = 2")
def d06_tradable(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir).groupBy("market_id").agg(
        F.round(F.sum("notional_usd"), 4).alias("volume"), ((F.count_if(F.col("side") == "BUY") > 0) & (F.count_if(F.col("side") == "SELL") > 0)).alias("two_sided"), (F.max("timestamp_unix") >= START + 29 * DAY).alias("active"), F.countDistinct("outcome_index").alias("k"),
    )
    return t.where("active and k = 2").drop("k")


@query()
def f35_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature that minimises the log loss of scaled logits: Newton steps of two aggregates each, the second
    one for the best of the halved steps."""
    z, y = F.col("z"), F.col("y")
    t = trades_ev(spark, sf_dir).select(S.logit("price", 1e-3).alias("z"), F.col("outcome_index").alias("y"))
    b = 1.0
    for _ in range(20):
        p = 1 / (1 + F.exp(-z * b))
        g, h = t.agg(F.sum((p - y) * z), F.sum(p * (1 - p) * z * z)).first()
        steps = [g / max(h, 1e-12) / 2**k for k in range(12)]
        # log(1 + exp(x)) without overflow
        losses = t.agg(*(F.sum(F.greatest(z * c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z * c))) - y * z * c) for c in (b, *(b - s for s in steps)))).first()
        best = int(np.argmin(losses))
        if best == 0 or abs(steps[best - 1]) < 1e-9:
            break
        b -= steps[best - 1]
    return spark.createDataFrame([(float(b),)], "inverse_temperature double")


@query(f"{EV} SELECT DISTINCT wallet_id, CAST('0x' || substr(md5(CAST(wallet_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS unit FROM trades")
def c35_hash_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic number in [0, 1) of each id; a hash that other engines have, the same contract."""
    return trades_ev(spark, sf_dir).select("wallet_id").distinct().withColumn("unit", distinct.unit("wallet_id"))
