"""Queries of aggregations, evaluation and fees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import evaluate, fees, order
from tideline.plans.catalog import query
from tideline.plans.views import DAY, SCHEDULES, START, TRADES_EV, TRADES_LI, schedules, trades_ev, trades_li
from tideline.sources import shards

EV, LI = f"WITH {TRADES_EV} ", f"WITH {TRADES_LI} "

_PRED = """pred AS (SELECT doc_id, quality, toxic, doc_id * 37 % 101 / 100.0::DOUBLE AS p, doc_id % 13 AS grp, 1 + doc_id % 3 AS w FROM labels)"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic", (i * 37 % 101 / F.lit(100.0)).alias("p"), (i % 13).alias("grp"), (1 + i % 3).alias("w"))


@query(f"""WITH {_PRED}, c AS (SELECT *, least(greatest(p, 1e-9), 1 - 1e-9) AS q, CASE WHEN p < 1 THEN floor(p * 20) END AS b FROM pred), e AS (SELECT b, abs(sum(p) - sum(quality)) AS gap FROM c WHERE b IS NOT NULL GROUP BY b)
SELECT count(*) AS n, round(avg(-(quality * ln(q) + (1 - quality) * ln(1 - q))), 6) AS log_loss, round(avg((p - quality) * (p - quality)), 6) AS brier, round(avg(CASE WHEN (p >= 0.5) = (quality = 1) THEN 1 ELSE 0 END), 6) AS accuracy, round((SELECT sum(gap) FROM e) / count(*), 6) AS ece FROM c""")
def f11_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.binary_metrics(_predictions(spark, sf_dir), "p", "quality")
    return m.select("n", *(F.round(c, 6).alias(c) for c in ("log_loss", "brier", "accuracy", "ece")))


@query(f"WITH {_PRED} SELECT round(sum(w * -(toxic * ln(least(greatest(p, 1e-8), 1 - 1e-8)) + (1 - toxic) * ln(1 - least(greatest(p, 1e-8), 1 - 1e-8)))) / sum(w), 6) AS log_loss, round(sum(w * (p - toxic) * (p - toxic)) / sum(w), 6) AS brier FROM pred")
def f12_weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, p = F.col("w"), F.col("p")
    return _predictions(spark, sf_dir).agg(F.round(evaluate.weighted_mean(S.log_loss("p", "toxic", 1e-8), w), 6).alias("log_loss"), F.round(evaluate.weighted_mean((p - F.col("toxic")) ** 2, w), 6).alias("brier"))


@query(f"WITH {_PRED}, g AS (SELECT grp, sum(w * (p - toxic)) / sum(w) AS m FROM pred GROUP BY grp), k AS (SELECT m, row_number() OVER (ORDER BY m, grp) AS k, count(*) OVER () AS n FROM g) SELECT round(avg(m), 6) AS tail, count(*) AS groups FROM k WHERE k <= ceil(n * 0.25)")
def f10_group_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = evaluate.group_tail(_predictions(spark, sf_dir), "grp", F.col("p") - F.col("toxic"), F.col("w"), 0.25)
    return t.select(F.round("tail", 6).alias("tail"), "groups")


@query(f"{LI}, c AS (SELECT component_id, count(*) AS c FROM trades GROUP BY 1) SELECT component_id, round(sum(c) OVER () / sum(sqrt(c)) OVER () / sqrt(c), 6) AS weight FROM c")
def f15_f42_balancing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.inverse_root_weights(trades_li(spark, sf_dir), "component_id").select("component_id", F.round("weight", 6).alias("weight"))


@query(f"{EV}, c AS (SELECT side AS part, market_id, count(*) AS c FROM trades GROUP BY ALL) SELECT part, market_id, round(sum(c) OVER p / count(*) OVER p / c, 9) AS weight FROM c WINDOW p AS (PARTITION BY part)")
def f16_equal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir).withColumnRenamed("side", "part")
    return evaluate.equal_weights(t, "part", "market_id").select("part", "market_id", F.round("weight", 9).alias("weight"))


_WEEKLY = f"""pnl AS (SELECT trade_id, timestamp_unix, CAST(floor((timestamp_unix - 345600) / 604800.0) AS BIGINT) * 604800 + 345600 AS week, round((outcome_index - price) * size, 4) AS pnl FROM trades)"""


def _pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    return t.select("trade_id", "timestamp_unix", S.week_id("timestamp_unix").alias("week"), F.round((F.col("outcome_index") - F.col("price")) * F.col("size"), 4).alias("pnl"))


@query(f"{EV}, {_WEEKLY}, w AS (SELECT week, sum(pnl) AS pnl, count(*) AS weight FROM pnl GROUP BY week), r AS (SELECT *, CASE WHEN max(greatest(-pnl, 0)) OVER () > 0 THEN 1 + 2 * greatest(-pnl, 0) / max(greatest(-pnl, 0)) OVER () ELSE 1 END AS raw FROM w) SELECT week, round(raw * sum(weight) OVER () / sum(raw * weight) OVER (), 6) AS multiplier FROM r")
def f17_downside_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _pnl(spark, sf_dir).groupBy("week").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("weight"))
    return evaluate.downside_multipliers(w, 3.0).select("week", F.round("multiplier", 6).alias("multiplier"))


@query(f"{EV}, {_WEEKLY}, d AS (SELECT week, timestamp_unix // {DAY} AS day, sum(pnl) AS pnl FROM pnl GROUP BY ALL), e AS (SELECT week, day, 1000 + sum(pnl) OVER (ORDER BY day) AS equity FROM d), l AS (SELECT week, arg_max(equity, day) AS e FROM e GROUP BY week) SELECT week, round(e - coalesce(lag(e) OVER (ORDER BY week), 1000), 3) AS pnl FROM l")
def f18_weekly_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pnl(spark, sf_dir).groupBy("week", F.floor(F.col("timestamp_unix") / DAY).alias("day")).agg(F.sum("pnl").alias("pnl"))
    d = d.withColumn("equity", 1000 + F.sum("pnl").over(W.orderBy("day")))  # one row per day
    return evaluate.weekly_pnl(d, 1000.0).select("week", F.round("pnl", 3).alias("pnl"))


@query(f"{EV}, e AS (SELECT wallet_id, trade_id, timestamp_unix, 100000 + sum(round((outcome_index - price) * size, 4)) OVER (PARTITION BY wallet_id ORDER BY timestamp_unix, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM trades), p AS (SELECT *, max(equity) OVER (PARTITION BY wallet_id ORDER BY timestamp_unix, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM e) SELECT wallet_id, round(max(peak), 3) AS peak, round(max((peak - equity) / peak), 8) AS max_drawdown FROM p GROUP BY 1")
def f19_h18_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("wallet_id").orderBy("timestamp_unix", "trade_id").rowsBetween(W.unboundedPreceding, 0)
    t = trades_ev(spark, sf_dir).withColumn("equity", 100000 + F.sum(F.round((F.col("outcome_index") - F.col("price")) * F.col("size"), 4)).over(w))
    d = evaluate.drawdown(t, "wallet_id", ["timestamp_unix", "trade_id"], "equity")
    return d.select("wallet_id", F.round("peak", 3).alias("peak"), F.round("max_drawdown", 8).alias("max_drawdown"))


@query(f"{EV}, {_WEEKLY} SELECT week, round(sum(pnl) FILTER (WHERE pnl > 0), 3) AS gains, round(-sum(pnl) FILTER (WHERE pnl < 0), 3) AS losses, round(sum(pnl) FILTER (WHERE pnl > 0) / nullif(-sum(pnl) FILTER (WHERE pnl < 0), 0), 6) AS profit_factor FROM pnl GROUP BY week")
def f20_profit_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    gains, losses = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return _pnl(spark, sf_dir).groupBy("week").agg(F.round(gains, 3).alias("gains"), F.round(losses, 3).alias("losses"), F.round(gains / F.nullif(losses, F.lit(0.0)), 6).alias("profit_factor"))


@query(f"{LI} SELECT component_id, CAST(sum(CAST(round((outcome_index - price) * size * 100) AS BIGINT)) AS BIGINT) AS profit_cents, count(DISTINCT wallet_id) AS wallets, count(*) FILTER (WHERE side = 'BUY') AS buys FROM trades GROUP BY 1")
def f21_component_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_li(spark, sf_dir)
    cents = F.round((F.col("outcome_index") - F.col("price")) * F.col("size") * 100).cast("bigint")
    return t.groupBy("component_id").agg(F.sum(cents).alias("profit_cents"), F.countDistinct("wallet_id").alias("wallets"), F.count_if(F.col("side") == "BUY").alias("buys"))


_BINS = [b for _, b in S.PRICE_BINS] + [S.LAST_BIN]


@query(f"{EV}, b AS (SELECT *, CASE WHEN price < 0.5 THEN 'below_0_50' WHEN price < 0.7 THEN '0_50_to_0_70' WHEN price < 0.8 THEN '0_70_to_0_80' WHEN price < 0.9 THEN '0_80_to_0_90' WHEN price < 0.95 THEN '0_90_to_0_95' WHEN price < 0.98 THEN '0_95_to_0_98' ELSE 'at_least_0_98' END AS bin FROM trades WHERE price < 0.95), "
    "names(bin) AS (VALUES " + ", ".join(f"('{b}')" for b in _BINS) + ") SELECT bin, count(trade_id) AS fills, count(DISTINCT wallet_id) AS wallets, round(coalesce(sum(notional_usd), 0), 4) AS notional FROM names LEFT JOIN b USING (bin) GROUP BY bin")
def f06_f07_price_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir).where("price < 0.95").withColumn("bin", S.price_bin("price"))
    by = t.groupBy("bin").agg(F.count("*").alias("fills"), F.countDistinct("wallet_id").alias("wallets"), F.round(F.sum("notional_usd"), 4).alias("notional"))
    names = spark.createDataFrame([(b,) for b in _BINS], "bin string")
    return names.join(by, "bin", "left").select("bin", F.coalesce("fills", F.lit(0)).alias("fills"), F.coalesce("wallets", F.lit(0)).alias("wallets"), F.coalesce("notional", F.lit(0.0)).alias("notional"))


@query(f"{EV}, s AS (SELECT 'maker' AS role, wallet_id, notional_usd AS n, price, side FROM trades UNION ALL SELECT 'taker', (wallet_id + market_id) % 150, notional_usd, price, side FROM trades) SELECT wallet_id, count(*) FILTER (WHERE role = 'maker') AS maker_fills, count(*) FILTER (WHERE role = 'taker') AS taker_fills, round(sum(n) FILTER (WHERE side = 'BUY'), 4) AS buy_notional, round(avg(price), 6) AS average_price, round(stddev_pop(price), 6) AS price_std FROM s GROUP BY 1")
def f02_j01_actor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    a = t.select(F.lit("maker").alias("role"), "wallet_id", F.col("notional_usd").alias("n"), "price", "side")
    b = t.select(F.lit("taker").alias("role"), ((F.col("wallet_id") + F.col("market_id")) % 150).alias("wallet_id"), F.col("notional_usd").alias("n"), "price", "side")
    return a.unionByName(b).groupBy("wallet_id").agg(
        F.count_if(F.col("role") == "maker").alias("maker_fills"), F.count_if(F.col("role") == "taker").alias("taker_fills"), F.round(F.sum(F.when(F.col("side") == "BUY", F.col("n"))), 4).alias("buy_notional"),
        F.round(F.avg("price"), 6).alias("average_price"), F.round(F.stddev_pop("price"), 6).alias("price_std"),
    )


@query(f"{EV}, d AS (SELECT wallet_id, timestamp_unix // {DAY} AS day, count(*) AS n, avg(price) AS m, stddev_pop(price) AS s FROM trades GROUP BY ALL) SELECT wallet_id, CAST(sum(n) AS BIGINT) AS n, round(sum(n * m) / sum(n), 9) AS mean, round(sqrt(greatest(sum((s * s + m * m) * n) / sum(n) - pow(sum(n * m) / sum(n), 2), 0)), 5) AS std FROM d GROUP BY 1")
def f04_moment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trades_ev(spark, sf_dir).groupBy("wallet_id", F.floor(F.col("timestamp_unix") / DAY).alias("day")).agg(F.count("*").alias("n"), F.avg("price").alias("m"), F.stddev_pop("price").alias("s"))
    n, m, s = F.col("n"), F.col("m"), F.col("s")
    d = d.groupBy("wallet_id").agg(F.sum("n").alias("n"), F.sum(n * m).alias("a"), F.sum((s * s + m * m) * n).alias("b"))
    return d.select("wallet_id", "n", F.round(F.col("a") / F.col("n"), 9).alias("mean"), F.round(S.weighted_std("a", "b", "n"), 5).alias("std"))


@query(f"{EV}, e AS (SELECT 'price' AS feature, price AS x FROM trades UNION ALL SELECT 'size', size FROM trades), m AS (SELECT feature, min(x) AS low, max(x) AS high, count(*) AS n FROM e GROUP BY 1), h AS (SELECT feature, low, high, n, CAST(floor((x - low) / (high - low) * 4095) AS BIGINT) AS b, count(*) AS c FROM e JOIN m USING (feature) GROUP BY ALL), c AS (SELECT *, sum(c) OVER (PARTITION BY feature ORDER BY b) AS cum FROM h) SELECT feature, low, high, "
    + ", ".join(f"round(min(CASE WHEN cum >= ceil({q} * n) THEN low + (b + 0.5) / 4096 * (high - low) END), 6) AS q_{i}" for i, q in enumerate((0.25, 0.5, 0.75))) + " FROM c GROUP BY ALL")
def f14_histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = evaluate.histogram_quantiles(trades_ev(spark, sf_dir), ["price", "size"], (0.25, 0.5, 0.75))
    return h.select("feature", "low", "high", *(F.round(f"q_{i}", 6).alias(f"q_{i}") for i in range(3)))


@query(f"{EV}, g AS (SELECT *, row_number() OVER (ORDER BY abs(price - 0.5) DESC, trade_id) AS k, count(*) OVER () AS n FROM trades) " + " UNION ALL ".join(
    f"SELECT {f}::DOUBLE AS fraction, count(*) AS n, round(sum(outcome_index - price), 4) AS pnl FROM g WHERE k <= ceil(n * {f})" for f in (0.01, 0.05, 0.2)))
def f27_top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    n, gain, fractions = t.count(), F.col("outcome_index") - F.col("price"), (0.01, 0.05, 0.2)
    t = t.withColumn("far", -F.abs(F.col("price") - 0.5))
    ranked = order.global_rank(t, ["far", "trade_id"], F.floor(F.col("far") * 100))
    taken = {f: F.col("rank") < int(-(-n * f // 1)) for f in fractions}
    rows = F.array(*(F.struct(F.lit(f).alias("fraction"), F.count_if(c).alias("n"), F.round(F.sum(F.when(c, gain)), 4).alias("pnl")) for f, c in taken.items()))
    return ranked.agg(rows.alias("r")).select(F.inline("r"))


@query(f"{EV} SELECT side, count(*) AS n, count(DISTINCT market_id) AS markets, max(timestamp_unix) - min(timestamp_unix) AS span FROM trades GROUP BY side")
def f29_f30_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_ev(spark, sf_dir).groupBy("side").agg(F.count("*").alias("n"), F.countDistinct("market_id").alias("markets"), (F.max("timestamp_unix") - F.min("timestamp_unix")).alias("span"))


@query("SELECT 'orders_without_customer' AS violation, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'repeated_lines', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'negative_prices', count(*) FROM lineitem WHERE l_extendedprice < 0")
def f31_f36_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "customer"))
    checks = {
        "orders_without_customer": o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti"),
        "lines_without_order": li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_anti"),
        "repeated_lines": li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "negative_prices": li.where("l_extendedprice < 0"),
    }
    out = None
    for name, rows in checks.items():
        row = rows.agg(F.lit(name).alias("violation"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT o_orderpriority, sha256(string_agg(day || ':' || n || chr(10), '' ORDER BY day)) AS digest FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS day, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def b08_ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("day")).agg(F.count("*").alias("n"))
    return shards.streamed_digest(o, F.concat("day", F.lit(":"), F.col("n").cast("string"), F.lit("\n")), "day", "o_orderpriority")


_FEE = "CASE exponent WHEN 0 THEN s * rate WHEN 1 THEN s * rate * p * (1 - p) ELSE s * rate * p * (1 - p) * p * (1 - p) END"


@query(f"{EV}, {SCHEDULES}, t AS (SELECT trade_id, side, rate, exponent, CAST(price AS DECIMAL(10,6)) AS p, CAST(size AS DECIMAL(18,6)) AS s FROM trades JOIN schedules USING (market_id) WHERE timestamp_unix >= from_ts AND timestamp_unix < to_ts), f AS (SELECT *, CAST({_FEE.replace('s * rate', 'CAST(s AS DOUBLE) * CAST(rate AS DOUBLE)').replace('p * (1 - p)', 'CAST(p AS DOUBLE) * (1 - CAST(p AS DOUBLE))')} AS DOUBLE) AS raw FROM t) "
    "SELECT trade_id, round(raw, 8) AS raw, floor(raw + 1e-12) AS whole FROM f")
def m01_unrounded_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    j = t.join(schedules(t), "market_id").where("timestamp_unix >= from_ts and timestamp_unix < to_ts")
    raw = fees.unrounded_fee(F.lit(fees.CURVE), F.col("size").cast(fees.SHARES), F.col("price").cast(fees.PRICE), F.col("rate"), F.col("exponent")).cast("double")
    return j.select("trade_id", F.round(raw, 8).alias("raw"), F.floor(raw + 1e-12).cast("double").alias("whole"))


#: Whole numbers: shares s, price p and rate r in millionths, exponent e; the fee before rounding, f, in 1e-18.
_UNITS = f"""{EV}, {SCHEDULES}, u AS (SELECT trade_id, side, market_id % 2 = 0 AS v1, CAST(round(size * 100) AS HUGEINT) * 10000 AS s, CAST(round(price * 100) AS HUGEINT) * 10000 AS p, CAST(round(CAST(rate AS DOUBLE) * 1000000) AS HUGEINT) AS r, exponent AS e
  FROM trades JOIN schedules USING (market_id) WHERE timestamp_unix >= from_ts AND timestamp_unix < to_ts), q AS (SELECT *, p * (1000000 - p) AS pq FROM u), q2 AS (SELECT *, CASE e WHEN 1 THEN pq ELSE (pq * pq * 2 + 1000000000000) // 2000000000000 END AS c FROM q),
f AS (SELECT *, CASE e WHEN 0 THEN s * r * 1000000 ELSE (s * r * c * 2 + 1000000) // 2000000 END AS f FROM q2)"""
_APPLIED = f"""{_UNITS}, o AS (SELECT *, (2 * ((f + 500000) // 1000000) * 1000000 + p) // (2 * p) AS x FROM f), w AS (SELECT *, v1 AND side = 'BUY' AS own, least(s, x // 10000000 * 10) AS shares, CASE WHEN v1 THEN f // 10000000000000 ELSE (f * 2 + 10000000000000) // 20000000000000 END AS c5 FROM o)
SELECT trade_id, CASE WHEN f = 0 THEN 'NONE' WHEN own THEN 'OUTCOME' WHEN c5 > 0 THEN 'COLLATERAL' ELSE 'NONE' END AS asset, CAST(CAST(CASE WHEN f = 0 THEN 0 WHEN own THEN shares ELSE c5 * 10 END AS DOUBLE) / 1e6 AS DECIMAL(24,6)) AS amount,
  CAST(CAST(CASE WHEN f = 0 THEN 0 WHEN own THEN shares * p ELSE c5 * 10000000 END AS DOUBLE) / 1e12 AS DECIMAL(28,12)) AS value_usd, CAST(CAST(CASE WHEN f = 0 OR own THEN 0 ELSE c5 END AS DOUBLE) / 1e5 AS DECIMAL(20,5)) AS collateral_usd,
  CAST(CAST(CASE WHEN f <> 0 AND own THEN shares ELSE 0 END AS DOUBLE) / 1e6 AS DECIMAL(18,6)) AS outcome_shares FROM w"""


@query(_APPLIED)
def m02_applied_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    j = t.join(schedules(t), "market_id").where("timestamp_unix >= from_ts and timestamp_unix < to_ts")
    protocol = F.when(F.col("market_id") % 2 == 0, "v1").otherwise("v2")
    fee = fees.apply_fee(protocol, F.lit(fees.CURVE), F.col("side"), F.lit(False), F.lit(True), F.col("size"), F.col("price"), F.col("rate"), F.col("exponent"))
    return j.select("trade_id", fee.alias("fee")).select("trade_id", "fee.*")


@query()
def m04_l07_action_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry prices, payouts and log utilities of both calls and of skipping, for every trade."""
    t = trades_ev(spark, sf_dir)
    j = t.join(schedules(t), "market_id").where("timestamp_unix >= from_ts and timestamp_unix < to_ts").withColumn("p0", S.probability0())
    entry = [F.round(S.clamp(p + 0.01, 0.01, 1.0), 6) for p in (F.col("p0"), 1 - F.col("p0"))]
    pay = [fees.payout_per_cost(e, F.lit(500), F.col("rate"), F.col("exponent")) for e in entry]
    j = j.select("trade_id", "outcome_index", *(e.alias(f"entry{i}") for i, e in enumerate(entry)), *(p.alias(f"payout{i}") for i, p in enumerate(pay)))
    win = [F.col("outcome_index"), 1 - F.col("outcome_index")]
    return j.select("trade_id", "entry0", "entry1", "payout0", "payout1", *(S.log_utility(F.lit(0.05), f"payout{i}", win[i]).alias(f"value{i}") for i in (0, 1)), F.lit(0.0).alias("value_skip"))


@query(f"{EV} SELECT DISTINCT market_id, 'curve' AS formula, 1 AS exponent, CAST((2 + market_id % 5) / 100.0 AS DOUBLE) AS rate FROM trades")
def m05_m06_schedule_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    rate = ((2 + F.col("market_id") % 5) / F.lit(100)).cast(fees.RATE)
    s, p = F.lit(1000).cast(fees.SHARES) + F.col("size").cast(fees.SHARES), F.col("price").cast(fees.PRICE)
    fee = F.round(fees.unrounded_fee(F.lit(fees.CURVE), s, p, rate, F.lit(1)), fees.PLACES)
    receipts = t.select("market_id", s.cast(fees.SHARES).alias("shares"), p.alias("price"), fee.alias("fee"))
    found = fees.infer_schedule(receipts, [(fees.CURVE, 0), (fees.CURVE, 1), (fees.CURVE, 2), (fees.MIN_CURVE, 0)], [f"0.0{k}" for k in range(1, 8)])
    return found.select("market_id", "formula", "exponent", F.col("rate").cast("double").alias("rate"))


@query()
def f22_f24_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir)
    delta = S.log_loss("p", "toxic") - S.log_loss(F.lit(0.5), "toxic")
    return evaluate.group_bootstrap(p, "grp", delta, F.lit(1))


@query()
def f33_f34_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir).withColumn("z", S.logit("p", 1e-3)).withColumn("p2", F.col("p") * F.col("p"))
    a, b = evaluate.platt(p, "z", "quality")
    beta = evaluate.ridge(p, ["p", "p2"], "quality", "w", 1.0)
    rows = [("platt_slope", a), ("platt_intercept", b), *((f"ridge_{i}", float(v)) for i, v in enumerate(beta))]
    return spark.createDataFrame(rows, "name string, value double")


@query(f"{EV}, d AS (SELECT wallet_id, sum(size) AS requested, sum(size * (trade_id % 3) / 2.0) AS filled, sum(size * (trade_id % 3) / 2.0 * price) AS cost, sum(size * (trade_id % 3) / 2.0 * (outcome_index - price)) AS pnl FROM trades GROUP BY 1) SELECT wallet_id, round(filled / requested, 6) AS fill_fraction, round(cost, 7) AS cost, round(pnl, 7) AS pnl, round(filled / requested * ln(greatest(1 + 0.05 * pnl / cost, 1e-8)), 6) AS value FROM d WHERE cost > 0")
def f05_execution_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir).withColumn("f", F.col("size") * (F.col("trade_id") % 3) / 2)
    d = t.groupBy("wallet_id").agg(F.sum("size").alias("requested"), F.sum("f").alias("filled"), F.sum(F.col("f") * F.col("price")).alias("cost"), F.sum(F.col("f") * (F.col("outcome_index") - F.col("price"))).alias("pnl")).where("cost > 0")
    fraction = F.col("filled") / F.col("requested")
    return d.select("wallet_id", F.round(fraction, 6).alias("fill_fraction"), F.round("cost", 7).alias("cost"), F.round("pnl", 7).alias("pnl"), F.round(fraction * F.ln(F.greatest(1 + 0.05 * F.col("pnl") / F.col("cost"), F.lit(1e-8))), 6).alias("value"))
