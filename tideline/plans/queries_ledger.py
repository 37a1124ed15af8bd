"""Queries of order, joins, running state, graphs, splits and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import asof, components, cursor, features, order, running
from tideline.plans.catalog import query
from tideline.plans.shared import cut
from tideline.plans.views import DAY, RESOLUTIONS, SCHEDULES, SPLITS_SQL, START, TRADES_EV, TRADES_LI, resolutions, schedules, splits, trades_ev, trades_li

EV, LI = f"WITH {TRADES_EV} ", f"WITH {TRADES_LI} "
ORIENTED = "o AS (SELECT *, CASE WHEN outcome_index = 0 THEN price ELSE 1 - price END AS p0, CASE WHEN (side = 'BUY') = (outcome_index = 0) THEN 1 ELSE -1 END AS direction FROM trades)"
UPTO = "ORDER BY timestamp_unix, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def oriented(t: DataFrame) -> DataFrame:
    return t.withColumn("p0", S.probability0()).withColumn("direction", S.direction())


def rounded(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *(F.round(v, digits).alias(v) for v in values))


# --- running state ------------------------------------------------------------------------------


def _moments_sql(key: str, prefix: str) -> str:
    return f""", s AS (SELECT *, count(*) OVER w AS c, sum(notional_usd) OVER w AS n, sum(size) OVER w AS sz, sum(direction * notional_usd) OVER w AS sg,
  sum(CASE WHEN side = 'BUY' THEN notional_usd ELSE 0 END) OVER w AS buy, sum(CASE WHEN outcome_index = 0 THEN notional_usd ELSE 0 END) OVER w AS o0, sum(p0 * notional_usd) OVER w AS pn, sum(p0 * p0 * notional_usd) OVER w AS ppn,
  sum(notional_usd * notional_usd) OVER w AS nn, min(p0) OVER w AS lo, max(p0) OVER w AS hi, timestamp_unix - first(timestamp_unix) OVER w AS age,
  coalesce(timestamp_unix - lag(timestamp_unix) OVER (PARTITION BY {key} ORDER BY timestamp_unix, trade_id), 0) AS gap FROM o WINDOW w AS (PARTITION BY {key} {UPTO}))
SELECT trade_id, c AS {prefix}_count, round(n, 4) AS {prefix}_notional, round(sz, 4) AS {prefix}_size, round(sg / n, 9) + 0.0 AS {prefix}_flow, round((2 * buy - n) / n, 9) + 0.0 AS {prefix}_side, round((2 * o0 - n) / n, 9) + 0.0 AS {prefix}_outcome,
  round(pn / n, 9) AS {prefix}_mean, round(sqrt(greatest(ppn / n - (pn / n) * (pn / n), 0)), 5) AS {prefix}_std, round(lo, 6) AS {prefix}_min, round(hi, 6) AS {prefix}_max, gap AS {prefix}_gap, age AS {prefix}_age,
  round(nn / (n * n), 9) AS {prefix}_hhi, round(ln(1 + n * 86400 / greatest(age, 1)), 8) AS {prefix}_velocity FROM s"""


def _moments(t: DataFrame, key: str, prefix: str, split: bool = False) -> DataFrame:
    day = F.floor(F.col("timestamp_unix") / DAY)
    r = running.split_moments(oriented(t), key, prefix, day) if split else running.running_moments(oriented(t), key, prefix)
    r = r.withColumn(f"{prefix}_velocity", F.log1p(f"{prefix}_velocity"))  # its noise is relative
    digits = {"notional": 4, "size": 4, "velocity": 8, "std": 5, "min": 6, "max": 6}
    whole = {"count", "gap", "age"}
    cols = [c for c in r.columns if c.startswith(f"{prefix}_")]
    return r.select("trade_id", *(F.col(c) if c[len(prefix) + 1 :] in whole else F.round(c, digits.get(c[len(prefix) + 1 :], 9)).alias(c) for c in cols))


@query(f"{EV}, {ORIENTED}{_moments_sql('market_id', 'm')} WHERE c & (c - 1) = 0")
def m0_market_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running market state at the power-of-two trades of each market."""
    r = _moments(trades_ev(spark, sf_dir), "market_id", "m")
    return r.where(F.col("m_count").bitwiseAND(F.col("m_count") - 1) == 0)


@query(f"{EV}, {ORIENTED}{_moments_sql('wallet_id', 'w')}")
def h01_wallet_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(trades_ev(spark, sf_dir), "wallet_id", "w")


@query(f"{LI}, {ORIENTED}{_moments_sql('market_id', 'm')}")
def h01_market_running_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(trades_li(spark, sf_dir), "market_id", "m")


@query(f"{EV}, {ORIENTED}{_moments_sql('market_id', 'm')}")
def h01_hot_market_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running market state where a market may be too large for a task: two levels by day."""
    return _moments(trades_ev(spark, sf_dir), "market_id", "m", split=True)


@query(f"{EV}, {ORIENTED}, s AS (SELECT trade_id, count(*) OVER w AS n, sum(notional_usd) OVER w AS notional, sum(p0 * notional_usd) OVER w AS pn, sum(direction * notional_usd) OVER w AS sg FROM o WINDOW w AS ({UPTO})) "
    "SELECT trade_id, n, round(notional, 4) AS notional, round(pn / notional, 6) AS mean_p, round(sg / notional, 6) + 0.0 AS flow FROM s")
def h02_universe_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = oriented(trades_ev(spark, sf_dir)), F.col("notional_usd")
    sums = {"n": F.lit(1), "notional": n, "pn": F.col("p0") * n, "sg": F.col("direction") * n}
    r = running.global_prefix(t, F.floor(F.col("timestamp_unix") / DAY), sums)
    return r.select("trade_id", F.col("n").cast("bigint").alias("n"), F.round("notional", 4).alias("notional"), F.round(F.col("pn") / F.col("notional"), 6).alias("mean_p"), F.round(F.col("sg") / F.col("notional"), 6).alias("flow"))


@query(f"""{EV}, s AS (SELECT trade_id, wallet_id, timestamp_unix, timestamp_unix - lag(timestamp_unix) OVER w AS gap, lag(market_id) OVER w AS prev, market_id FROM trades WINDOW w AS (PARTITION BY wallet_id ORDER BY timestamp_unix, trade_id)),
q AS (SELECT *, row_number() OVER v AS k, sum(gap) OVER v AS gaps, sum(CASE WHEN prev <> market_id THEN 1 ELSE 0 END) OVER v AS sw FROM s WINDOW v AS (PARTITION BY wallet_id {UPTO}))
SELECT trade_id, coalesce(gap, 0) AS gap, coalesce(prev = market_id, false) AS same_market, round(CASE WHEN gap IS NULL THEN 1 ELSE least(ln(1 + gap) / 20, 1) END, 6) AS recency,
  round(ln(1 + coalesce(gaps, 0) / greatest(k - 1, 1)), 6) AS mean_gap, round(sw / greatest(k - 1, 1), 6) AS switch_rate FROM q""")
def h03_lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, r = order.keyed("wallet_id"), order.running("wallet_id")
    t = trades_ev(spark, sf_dir).withColumns({"gap": F.col("timestamp_unix") - F.lag("timestamp_unix").over(w), "prev": F.lag("market_id").over(w)})
    t = t.withColumns({"k": F.row_number().over(w), "gaps": F.sum("gap").over(r), "sw": F.sum(F.when(F.col("prev") != F.col("market_id"), 1).otherwise(0)).over(r)})
    rest = F.greatest(F.col("k") - 1, F.lit(1))
    return t.select(
        "trade_id", F.coalesce("gap", F.lit(0)).alias("gap"), F.coalesce(F.col("prev") == F.col("market_id"), F.lit(False)).alias("same_market"),
        F.round(F.when(F.col("gap").isNull(), 1.0).otherwise(F.least(F.log1p("gap") / 20, F.lit(1.0))), 6).alias("recency"),
        F.round(F.log1p(F.coalesce("gaps", F.lit(0)) / rest), 6).alias("mean_gap"), F.round(F.col("sw") / rest, 6).alias("switch_rate"),
    )


@query(f"""{EV}, {ORIENTED}, r AS (SELECT market_id, trade_id, timestamp_unix, p0, direction, row_number() OVER w AS k, timestamp_unix - lag(timestamp_unix) OVER w AS dt FROM o WINDOW w AS (PARTITION BY market_id ORDER BY timestamp_unix, trade_id))
SELECT a.trade_id, """ + ", ".join(f"round(sum((CASE WHEN b.dt IS NULL THEN 1 ELSE 1 - pow(2.0, -b.dt / {h}.0) END) * b.{v} * pow(2.0, -(a.timestamp_unix - b.timestamp_unix) / {h}.0)), 6) + 0.0 AS ema_{v}_{h}" for v in ("p0", "direction") for h in (3600, 86400))
    + " FROM r a JOIN r b ON a.market_id = b.market_id AND b.k <= a.k GROUP BY a.trade_id")
def h04_market_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = running.keyed_ema(oriented(trades_ev(spark, sf_dir)), "market_id", ["p0", "direction"], (3600, 86400))
    return rounded(e, ["trade_id"], [c for c in e.columns if c != "trade_id"])


@query(f"""{EV}, w AS (SELECT *, ln(1 + count(*) OVER v) / 20 AS d0, ln(1 + sum(notional_usd) OVER v) / 24 AS d1, 1 / sqrt(count(*) OVER v) AS d6 FROM trades WINDOW v AS (PARTITION BY wallet_id {UPTO})),
m AS (SELECT trade_id, sum(notional_usd) OVER u AS n, """ + ", ".join(f"sum({d} * notional_usd) OVER u AS s{d}, sum({d} * {d} * notional_usd) OVER u AS q{d}" for d in ("d0", "d1", "d6")) + f" FROM w WINDOW u AS (PARTITION BY market_id {UPTO})) SELECT trade_id, "
    + ", ".join(f"round(s{d} / n, 6) AS mean_{d}, round(sqrt(greatest(q{d} / n - (s{d} / n) * (s{d} / n), 0)), 5) AS std_{d}" for d in ("d0", "d1", "d6")) + " FROM m")
def h05_wallet_moments_of_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, u, n = order.running("wallet_id"), order.running("market_id"), F.col("notional_usd")
    t = trades_ev(spark, sf_dir).withColumns({"d0": F.log1p(F.count("*").over(v)) / 20, "d1": F.log1p(F.sum(n).over(v)) / 24, "d6": 1 / F.sqrt(F.count("*").over(v))})
    d = ("d0", "d1", "d6")
    t = t.withColumns({"n": F.sum(n).over(u)} | {f"s{x}": F.sum(F.col(x) * n).over(u) for x in d} | {f"q{x}": F.sum(F.col(x) * F.col(x) * n).over(u) for x in d})
    return t.select("trade_id", *(F.round(S.safe_ratio(f"s{x}", "n"), 6).alias(f"mean_{x}") for x in d), *(F.round(S.weighted_std(f"s{x}", f"q{x}", "n"), 5).alias(f"std_{x}") for x in d))


@query(f"""{EV} SELECT trade_id, round(sum(notional_usd) OVER m / sum(notional_usd) OVER c, 6) AS market_share, round(count(*) OVER m / count(*) OVER c, 6) AS count_share,
  round(pow(sum(notional_usd) OVER m, 2) / sum(notional_usd * notional_usd) OVER m, 4) AS effective_count FROM trades WINDOW m AS (PARTITION BY market_id {UPTO}), c AS (PARTITION BY component_id {UPTO})""")
def h06_h07_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, c, n = order.running("market_id"), order.running("component_id"), F.col("notional_usd")
    return trades_ev(spark, sf_dir).select(
        "trade_id", F.round(F.sum(n).over(m) / F.sum(n).over(c), 6).alias("market_share"), F.round(F.count("*").over(m) / F.count("*").over(c), 6).alias("count_share"),
        F.round(F.pow(F.sum(n).over(m), F.lit(2)) / F.sum(n * n).over(m), 4).alias("effective_count"),
    )


_HEART = f"""{EV.replace('WITH', 'WITH RECURSIVE', 1)}, r AS (SELECT component_id, trade_id, timestamp_unix, row_number() OVER (PARTITION BY component_id ORDER BY timestamp_unix, trade_id) AS n FROM trades),
walk AS (SELECT component_id, trade_id, timestamp_unix, n FROM r WHERE n = 1 UNION ALL
  SELECT component_id, trade_id, timestamp_unix, n FROM (SELECT r.*, row_number() OVER (PARTITION BY r.component_id ORDER BY r.n) AS k FROM walk w JOIN r ON r.component_id = w.component_id AND r.n > w.n
    AND ((r.n <= 1024 AND r.n & (r.n - 1) = 0) OR (r.n > 1024 AND r.n % 128 = 0) OR r.timestamp_unix - w.timestamp_unix >= 21600)) WHERE k = 1)
SELECT component_id, trade_id, timestamp_unix, n, CASE WHEN n = 1 THEN 'first' WHEN n <= 1024 AND n & (n - 1) = 0 THEN 'early_power_of_two' WHEN n > 1024 AND n % 128 = 0 THEN 'trade_stride' ELSE 'heartbeat' END AS reason FROM walk"""


@query(_HEART)
def h09_decision_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursor.decisions(trades_ev(spark, sf_dir)).select("component_id", "trade_id", "timestamp_unix", "n", F.col("reasons")[0].alias("reason"))


@query(f"{EV}, r AS (SELECT market_id, trade_id, row_number() OVER (PARTITION BY market_id ORDER BY timestamp_unix, trade_id) AS n FROM trades) SELECT market_id, trade_id, n FROM r WHERE n >= 128 AND (n - 128) % 32 = 0")
def h10_stride_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = trades_ev(spark, sf_dir).select("market_id", "trade_id", F.row_number().over(order.keyed("market_id")).cast("bigint").alias("n"))
    return r.where("n >= 128 and (n - 128) % 32 = 0")


_SEQ = f"""{EV}, {ORIENTED}, r AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY timestamp_unix, trade_id) AS n FROM o),
a AS (SELECT market_id, n AS anchor FROM r WHERE n >= 128 AND (n - 128) % 32 = 0),
s AS (SELECT r.*, a.anchor, r.n - (a.anchor - 64) - 1 AS i FROM a JOIN r ON r.market_id = a.market_id AND r.n > a.anchor - 64 AND r.n <= a.anchor)"""


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 64 trades at each anchor of h10 (from trade 128 on, every 32nd), numbered i = 0..63: every
    trade goes to the two anchors that cover it, so there is no range join."""
    t = oriented(trades_ev(spark, sf_dir)).withColumn("n", F.row_number().over(order.keyed("market_id")).cast("bigint"))
    t = t.withColumn("last", F.max("n").over(W.partitionBy("market_id")))
    next_ = (F.ceil(F.col("n") / 32) * 32).cast("bigint")
    t = t.withColumn("anchor", F.explode(F.array(next_, next_ + 32))).where("anchor >= 128 and anchor <= last")
    return t.withColumn("i", F.col("n") - F.col("anchor") + 63)


@query(_SEQ + """ SELECT market_id, anchor, i, round(least(count(*) OVER p / 64.0, 1), 9) AS prior_count, round(least(coalesce(sum(notional_usd) OVER p, 0) / greatest(sum(notional_usd) OVER t, 1), 1), 9) AS prior_share,
  round(sum(notional_usd) OVER u / greatest(sum(notional_usd) OVER t, 1), 9) AS share, round(p0 - avg(p0) OVER u, 9) + 0.0 AS deviation, round(avg(p0) OVER b, 9) AS mean16 FROM s
WINDOW p AS (PARTITION BY market_id, anchor, wallet_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY market_id, anchor), u AS (PARTITION BY market_id, anchor ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY market_id, anchor ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def h11_h12_h19_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = _sequences(spark, sf_dir), ["market_id", "anchor"]
    p = W.partitionBy(*key, "wallet_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    t, u, b = W.partitionBy(*key), W.partitionBy(*key).orderBy("i").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*key).orderBy("i").rowsBetween(-15, 0)
    total = F.greatest(F.sum("notional_usd").over(t), F.lit(1.0))
    return s.select(
        *key, "i", F.round(F.least(F.count("*").over(p) / 64, F.lit(1.0)), 9).alias("prior_count"), F.round(F.least(F.coalesce(F.sum("notional_usd").over(p), F.lit(0.0)) / total, F.lit(1.0)), 9).alias("prior_share"),
        F.round(F.sum("notional_usd").over(u) / total, 9).alias("share"), F.round(F.col("p0") - F.avg("p0").over(u), 9).alias("deviation"), F.round(F.avg("p0").over(b), 9).alias("mean16"),
    )


@query(_SEQ + """, w AS (SELECT market_id, anchor, wallet_id, sum(notional_usd) AS n, count(*) AS c FROM s GROUP BY ALL) SELECT market_id, anchor, wallet_id, round(n, 4) AS notional, c AS trades, k FROM (SELECT *, row_number() OVER (PARTITION BY market_id, anchor ORDER BY n DESC, wallet_id) AS k FROM w) WHERE k <= 4""")
def h13_top_wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _sequences(spark, sf_dir).groupBy("market_id", "anchor", "wallet_id").agg(F.sum("notional_usd").alias("n"), F.count("*").alias("trades"))
    w = w.withColumn("k", F.row_number().over(W.partitionBy("market_id", "anchor").orderBy(F.desc("n"), "wallet_id"))).where("k <= 4")
    return w.select("market_id", "anchor", "wallet_id", F.round("n", 4).alias("notional"), "trades", F.col("k").cast("bigint").alias("k"))


@query(_SEQ + """ SELECT market_id, anchor, i // 16 AS block, round(avg(p0), 9) AS mean, round(stddev_pop(p0), 7) AS std, round(min(p0), 6) AS low, round(max(p0), 6) AS high, round(arg_max(p0, i) - arg_min(p0, i), 6) + 0.0 AS change, count(DISTINCT wallet_id) AS wallets FROM s GROUP BY ALL""")
def h14_context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sequences(spark, sf_dir).withColumn("block", F.floor(F.col("i") / 16))
    return s.groupBy("market_id", "anchor", "block").agg(
        F.round(F.avg("p0"), 9).alias("mean"), F.round(F.stddev_pop("p0"), 7).alias("std"), F.round(F.min("p0"), 6).alias("low"), F.round(F.max("p0"), 6).alias("high"),
        F.round(F.max_by("p0", "i") - F.min_by("p0", "i"), 6).alias("change"), F.countDistinct("wallet_id").alias("wallets"),
    )


@query(f"{LI}, c AS (SELECT component_id, max(timestamp_unix) AS anchor FROM trades GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY anchor, component_id) AS k, count(*) OVER () AS n FROM c) SELECT component_id, anchor, CASE WHEN k <= least(n - 1, greatest(1, CAST(floor(n * 0.7) AS BIGINT))) THEN 'fit' ELSE 'selection' END AS side FROM r")
def h17_time_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.time_partition(trades_li(spark, sf_dir), "component_id", "timestamp_unix", 0.7)


@query(f"{EV}, f AS (SELECT trade_id, market_id, timestamp_unix, row_number() OVER (PARTITION BY market_id, wallet_id ORDER BY timestamp_unix, trade_id) AS k FROM trades) SELECT trade_id, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY market_id {UPTO}) AS BIGINT) AS wallets FROM f")
def g04_running_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.running_distinct(trades_ev(spark, sf_dir), "market_id", "wallet_id", "wallets").select("trade_id", "wallets")


def _mixed_sql(source: str, x: str) -> str:
    """CTEs m0 .. m3: the source's columns and h, splitmix64 of x."""
    product = "CAST((xor(z, z >> {}) ::UHUGEINT * {}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    return (
        f"m0 AS (SELECT *, CAST(({x} + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM {source}), m1 AS (SELECT * REPLACE ({product.format(30, 13787848793156543929)} AS z) FROM m0), "
        f"m2 AS (SELECT * REPLACE ({product.format(27, 10723151780598845931)} AS z) FROM m1), m3 AS (SELECT *, xor(z, z >> 31) AS h FROM m2), "
        "ranked AS (SELECT *, h & 63 AS reg, 59 - CASE WHEN h >> 6 = 0 THEN 0 ELSE length(bin(h >> 6)) END AS rank FROM m3)"
    )


def _estimate_sql(s: str, zeros: str) -> str:
    return f"CASE WHEN {zeros} > 0 AND 0.709 * 4096 / {s} <= 160 THEN 64 * ln(64.0 / greatest({zeros}, 1)) ELSE 0.709 * 4096 / {s} END"


@query(f"""{EV}, {_mixed_sql('trades', 'wallet_id::UHUGEINT')}, o AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY market_id, reg ORDER BY timestamp_unix, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old FROM ranked),
d AS (SELECT trade_id, 64 + sum(CASE WHEN rank > old THEN pow(2.0, -rank) - pow(2.0, -old) ELSE 0 END) OVER w AS s, 64 - sum(CASE WHEN old = 0 THEN 1 ELSE 0 END) OVER w AS zeros FROM o WINDOW w AS (PARTITION BY market_id {UPTO}))
SELECT trade_id, round({_estimate_sql('s', 'zeros')}, 6) AS estimate FROM d""")
def g02_g04_running_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.running_sketch(trades_ev(spark, sf_dir), "market_id", "wallet_id", "estimate").select("trade_id", F.round("estimate", 6).alias("estimate"))


@query(f"""{LI}, {_mixed_sql('trades', 'wallet_id::UHUGEINT')}, r AS (SELECT market_id, reg, max(rank) AS rank FROM ranked GROUP BY ALL), d AS (SELECT market_id, 64 - count(*) + sum(pow(2.0, -rank)) AS s, 64 - count(*) AS zeros FROM r GROUP BY 1)
SELECT market_id, round({_estimate_sql('s', 'zeros')}, 6) AS estimate FROM d""")
def g02_g03_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.sketch_distinct(trades_li(spark, sf_dir), "market_id", "wallet_id").withColumn("estimate", F.round("estimate", 6))


@query(f"{LI}, c AS (SELECT DISTINCT component_id FROM trades), {_mixed_sql('c', '(component_id + 17)::UHUGEINT')} SELECT component_id, CAST(h % 5 AS BIGINT) AS fold FROM m3")
def g01_g05_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = trades_li(spark, sf_dir).select("component_id").distinct()
    return c.select("component_id", running.fold_of("component_id", 17, 5).alias("fold"))


# --- order, duplicates, selections --------------------------------------------------------------


@query(f"{LI}, r AS (SELECT *, row_number() OVER (PARTITION BY wallet_id, market_id, timestamp_unix ORDER BY trade_id) - 1 AS occurrence FROM trades) SELECT trade_id, occurrence FROM r")
def h16_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.occurrence(trades_li(spark, sf_dir), ["wallet_id", "market_id", "timestamp_unix"], ["trade_id"]).select("trade_id", F.col("occurrence").cast("bigint").alias("occurrence"))


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) AS j FROM lineitem) WHERE k = 1 OR j = 1""")
def j02_j03_keep_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    a = W.partitionBy("l_orderkey", "l_linenumber")
    li = li.withColumns({"k": F.row_number().over(a.orderBy("l_partkey", "l_suppkey")).cast("bigint"), "j": F.row_number().over(a.orderBy(F.desc("l_partkey"), F.desc("l_suppkey"))).cast("bigint")})
    return li.where("k = 1 or j = 1")


@query(f"{EV}, r AS (SELECT trade_id, row_number() OVER (ORDER BY timestamp_unix, trade_id) - 1 AS rank, count(*) OVER () AS n FROM trades) SELECT trade_id, rank FROM r WHERE rank IN (SELECT i * n // 100 FROM range(100) AS x(i))")
def a08_spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, day = trades_ev(spark, sf_dir), F.floor(F.col("timestamp_unix") / DAY)
    picked = order.spread_sample(t, order.ORDER, day, 100).select("trade_id")
    return order.global_rank(t, order.ORDER, day).select("trade_id", "rank").join(picked, "trade_id", "left_semi")


@query(f"{EV}, m AS (SELECT market_id, sum(notional_usd) AS v, count(*) AS n FROM trades GROUP BY 1) SELECT market_id, round(v, 4) AS volume, n FROM m ORDER BY m.v DESC, market_id DESC LIMIT 7")
def i04_i05_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trades_ev(spark, sf_dir).groupBy("market_id").agg(F.sum("notional_usd").alias("v"), F.count("*").alias("n"))
    return order.top_n(m, 7, F.desc("v"), F.desc("market_id")).select("market_id", F.round("v", 4).alias("volume"), "n")


@query(f"{LI}, x AS (SELECT component_id, wallet_id, count(*) AS n, sum(notional_usd) AS score FROM trades GROUP BY ALL) SELECT component_id, wallet_id, n, k FROM (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY (n = 1) DESC, n DESC, round(score, 4) DESC, wallet_id) AS k FROM x) WHERE k <= 5")
def i06_i07_top_per_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trades_li(spark, sf_dir).groupBy("component_id", "wallet_id").agg(F.count("*").alias("n"), F.sum("notional_usd").alias("score"))
    place = [(F.col("n") == 1).desc(), F.desc("n"), F.round("score", 4).desc(), F.col("wallet_id")]
    x = x.withColumn("k", F.row_number().over(W.partitionBy("component_id").orderBy(*place))).where("k <= 5")
    return x.select("component_id", "wallet_id", "n", F.col("k").cast("bigint").alias("k"))


@query(f"{EV}, w AS (SELECT market_id, min(timestamp_unix) AS a, max(timestamp_unix) + 1 AS b FROM trades GROUP BY 1) SELECT market_id, i AS part, a + (b - a) * i // 7 AS part_start, a + (b - a) * (i + 1) // 7 AS part_end FROM w, range(7) AS x(i)")
def i09_integer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trades_ev(spark, sf_dir).groupBy("market_id").agg(F.min("timestamp_unix").alias("a"), (F.max("timestamp_unix") + 1).alias("b"))
    return order.integer_windows(w, "a", "b", 7).select("market_id", F.col("part").cast("bigint").alias("part"), "part_start", "part_end")


@query(f"{EV} SELECT count(*) FILTER (WHERE p > timestamp_unix) AS by_time, count(*) FILTER (WHERE q > timestamp_unix) AS by_id FROM (SELECT timestamp_unix, lag(timestamp_unix) OVER (PARTITION BY wallet_id ORDER BY timestamp_unix, trade_id) AS p, lag(timestamp_unix) OVER (PARTITION BY wallet_id ORDER BY trade_id DESC) AS q FROM trades)")
def i03_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    a = order.regressions(t, "wallet_id", ["timestamp_unix", "trade_id"]).agg(F.count("*").alias("by_time"))
    w = W.partitionBy("wallet_id").orderBy(F.desc("trade_id"))
    b = t.withColumn("q", F.lag("timestamp_unix").over(w)).agg(F.count_if(F.col("q") > F.col("timestamp_unix")).alias("by_id"))
    return a.join(b)  # one row each


@query(f"{EV} (SELECT DISTINCT 'removed' AS change, wallet_id FROM trades WHERE timestamp_unix < {START + 2 * DAY} AND wallet_id NOT IN (SELECT wallet_id FROM trades WHERE timestamp_unix >= {START + 29 * DAY})) UNION ALL (SELECT DISTINCT 'added', wallet_id FROM trades WHERE timestamp_unix >= {START + 29 * DAY} AND wallet_id NOT IN (SELECT wallet_id FROM trades WHERE timestamp_unix < {START + 2 * DAY}))")
def j05_j07_set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    a, b = t.where(F.col("timestamp_unix") < START + 2 * DAY).select("wallet_id"), t.where(F.col("timestamp_unix") >= START + 29 * DAY).select("wallet_id")
    return order.missing(a, b, "wallet_id").select(F.lit("removed").alias("change"), "wallet_id").unionByName(order.missing(b, a, "wallet_id").select(F.lit("added").alias("change"), "wallet_id"))


@query(f"{EV} SELECT component_id, count(DISTINCT wallet_id) AS wallets FROM (SELECT component_id, wallet_id FROM trades WHERE side = 'BUY' INTERSECT SELECT component_id, wallet_id FROM trades WHERE side = 'SELL') GROUP BY 1")
def j06_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    both = t.where("side = 'BUY'").select("component_id", "wallet_id").intersect(t.where("side = 'SELL'").select("component_id", "wallet_id"))
    return both.groupBy("component_id").agg(F.countDistinct("wallet_id").alias("wallets"))


@query(f"{EV} SELECT wallet_id, (row_number() OVER (PARTITION BY wallet_id % 8 ORDER BY wallet_id) - 1) // 5 AS chunk, wallet_id % 8 AS shard FROM (SELECT DISTINCT wallet_id FROM trades)")
def j08_f32_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trades_ev(spark, sf_dir).select("wallet_id").distinct().withColumn("shard", F.col("wallet_id") % 8)
    return w.select("wallet_id", F.floor((F.row_number().over(W.partitionBy("shard").orderBy("wallet_id")) - 1) / 5).alias("chunk"), "shard")


# --- joins --------------------------------------------------------------------------------------

_RES = """res AS (SELECT t.wallet_id, t.market_id, r.resolution_ts, round(sum(CASE WHEN outcome_index = 0 THEN 1 ELSE -1 END * (payout0 - 0.5) * size * (CASE side WHEN 'BUY' THEN 1 ELSE -1 END)), 6) AS pnl
  FROM trades t JOIN resolutions r USING (market_id) WHERE t.timestamp_unix <= r.resolution_ts GROUP BY ALL)"""


def _wallet_resolutions(t: DataFrame) -> DataFrame:
    j = t.join(resolutions(t), "market_id").where("timestamp_unix <= resolution_ts")
    sign = F.when(F.col("outcome_index") == 0, 1).otherwise(-1) * F.when(F.col("side") == "BUY", 1).otherwise(-1)
    return j.groupBy("wallet_id", "market_id", "resolution_ts").agg(F.round(F.sum(sign * (F.col("payout0") - 0.5) * F.col("size")), 6).alias("pnl"))


@query(f"{EV}, {RESOLUTIONS}, {_RES} SELECT t.trade_id, count(r.pnl) AS n, round(coalesce(sum(r.pnl), 0), 5) + 0.0 AS pnl, count(*) FILTER (WHERE r.pnl > 0) AS wins FROM trades t LEFT JOIN res r ON r.wallet_id = t.wallet_id AND r.resolution_ts < t.timestamp_unix GROUP BY 1")
def e09_strict_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    sums = {"n": F.lit(1), "pnl": F.col("pnl"), "wins": F.when(F.col("pnl") > 0, 1).otherwise(0)}
    j = asof.strict_asof_sums(t, _wallet_resolutions(t), "wallet_id", "timestamp_unix", "resolution_ts", sums, "trade_id")
    return j.select("trade_id", F.col("n").cast("bigint").alias("n"), F.round("pnl", 5).alias("pnl"), F.col("wins").cast("bigint").alias("wins"))


@query(f"{EV}, {RESOLUTIONS}, {_RES} SELECT market_id, wallet_id, resolution_ts, pnl, pnl > 0 AS profitable FROM res")
def f03_resolution_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wallet_resolutions(trades_ev(spark, sf_dir)).withColumn("profitable", F.col("pnl") > 0)


@query(f"""{EV}, d AS (SELECT wallet_id, (timestamp_unix - {START}) // {7 * DAY} AS k, sum(notional_usd) AS n, count(*) AS c FROM trades GROUP BY ALL), v AS (SELECT wallet_id, {START} + (k + 1) * {7 * DAY} AS available, n, c FROM d)
SELECT t.trade_id, CAST(coalesce(sum(v.c), 0) AS BIGINT) AS known_trades, round(coalesce(sum(v.n), 0), 4) AS known_notional FROM trades t LEFT JOIN v ON v.wallet_id = t.wallet_id AND v.available <= t.timestamp_unix GROUP BY 1""")
def e10_additive_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_totals(trades_ev(spark, sf_dir))


def known_totals(t: DataFrame) -> DataFrame:
    """trade_id, known_trades, known_notional: the wallet's totals of the weeks that ended by the trade's time."""
    week = F.floor((F.col("timestamp_unix") - START) / (7 * DAY))
    d = t.groupBy("wallet_id", (START + (week + 1) * 7 * DAY).alias("available")).agg(F.sum("notional_usd").alias("n"), F.count("*").alias("c"))
    # available at a second means visible at it: one second earlier makes the strict form inclusive
    j = asof.strict_asof_sums(t, d.withColumn("visible", F.col("available") - 1), "wallet_id", "timestamp_unix", "visible", {"c": F.col("c"), "n": F.col("n")}, "trade_id")
    return j.select("trade_id", F.col("c").cast("bigint").alias("known_trades"), F.round("n", 4).alias("known_notional"))


@query(f"""{EV}, {ORIENTED}, u AS (SELECT market_id, timestamp_unix, arg_min(p0, trade_id) AS p FROM o GROUP BY ALL) SELECT o.trade_id, """
    + ", ".join(f"round((SELECT arg_min(u.p, u.timestamp_unix) FROM u WHERE u.market_id = o.market_id AND u.timestamp_unix BETWEEN o.timestamp_unix + {h} AND o.timestamp_unix + {h + tol}) - o.p0, 6) + 0.0 AS markout_{h}" for h, tol in ((300, 900), (3600, 3600), (86400, 21600))) + " FROM o")
def e11_l03_markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cut(oriented(trades_ev(spark, sf_dir)).select("trade_id", "market_id", "timestamp_unix", "p0"), "prices")
    # several trades of a second: the first in total order is the one found
    leads = {f"markout_{h}": (h, tol) for h, tol in ((300, 900), (3600, 3600), (86400, 21600))}
    t = asof.forward_asof(t, "market_id", "timestamp_unix", F.col("p0"), "trade_id", leads)
    return t.select("trade_id", *(F.round(F.col(k) - F.col("p0"), 6).alias(k) for k in leads))


def history_cut(t: DataFrame, most: int = 16) -> DataFrame:
    """trade_id, n, mean_size, oldest over the last `most` trades of the wallet in earlier seconds.

    All trades of a second have the history of its first one, which no row of the same second precedes:
    window frames, no join. Trades without history have no row.
    """
    w = order.keyed("wallet_id").rowsBetween(-most, -1)
    first = W.partitionBy("wallet_id", "timestamp_unix").orderBy("trade_id")
    rows = t.withColumns({"n": F.count("*").over(w), "mean_size": F.avg("size").over(w), "oldest": F.min("timestamp_unix").over(w)})
    rows = rows.withColumns({c: F.first(c).over(first) for c in ("n", "mean_size", "oldest")}).where("n > 0")
    return rows.select("trade_id", "n", F.round("mean_size", 6).alias("mean_size"), "oldest")


@query(f"""{EV}, h AS (SELECT a.trade_id, t.size, t.timestamp_unix AS ht, row_number() OVER (PARTITION BY a.trade_id ORDER BY t.timestamp_unix DESC, t.trade_id DESC) AS k
FROM trades a JOIN trades t ON t.wallet_id = a.wallet_id AND t.timestamp_unix < a.timestamp_unix) SELECT trade_id, count(*) AS n, round(avg(size), 6) AS mean_size, min(ht) AS oldest FROM h WHERE k <= 16 GROUP BY 1""")
def e12_history_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """history_cut() of every trade."""
    return history_cut(trades_ev(spark, sf_dir))


@query(f"{EV}, {SCHEDULES} SELECT t.trade_id, s.schedule_id, CAST(s.rate AS DOUBLE) AS rate FROM trades t LEFT JOIN schedules s ON s.market_id = t.market_id AND t.timestamp_unix >= s.from_ts AND t.timestamp_unix < s.to_ts")
def e13_e15_interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    j = asof.interval_lookup(t, schedules(t), "market_id", "timestamp_unix", "from_ts", "to_ts", 10 * DAY)
    return j.select("trade_id", "schedule_id", F.col("rate").cast("double").alias("rate"))


@query(f"{EV}, w AS (SELECT market_id, wallet_id, min(timestamp_unix) AS a, max(timestamp_unix) AS b FROM trades GROUP BY ALL) SELECT DISTINCT x.market_id, x.wallet_id FROM w x JOIN w y ON x.market_id = y.market_id AND (y.a, y.b, y.wallet_id) < (x.a, x.b, x.wallet_id) AND y.b > x.a")
def e14_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trades_ev(spark, sf_dir).groupBy("market_id", "wallet_id").agg(F.min("timestamp_unix").alias("a"), F.max("timestamp_unix").alias("b"))
    return asof.overlaps(w, "market_id", "a", "b").select("market_id", "wallet_id")


@query(f"{EV}, {SPLITS_SQL}, w AS (SELECT market_id, wallet_id, min(timestamp_unix) AS a, max(timestamp_unix) + 1 AS b FROM trades GROUP BY ALL) SELECT market_id, split AS epoch, min(greatest(a, start_ts)) AS start_ts, max(least(b, end_ts)) AS end_ts FROM w JOIN splits ON a < end_ts AND b > start_ts GROUP BY ALL")
def e16_window_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trades_ev(spark, sf_dir).groupBy("market_id", "wallet_id").agg(F.min("timestamp_unix").alias("start_ts"), (F.max("timestamp_unix") + 1).alias("end_ts"))
    return asof.split_by_epochs(w, splits(spark).toDF("epoch", "e_start", "e_end"), "market_id")


@query(f"""{EV}, r AS (SELECT *, row_number() OVER (PARTITION BY wallet_id ORDER BY timestamp_unix, trade_id) AS n FROM trades)
SELECT a.trade_id, arg_max(b.trade_id, b.n) AS donor FROM r a LEFT JOIN r b ON a.wallet_id = b.wallet_id AND b.n < a.n AND b.market_id <> a.market_id GROUP BY 1""")
def e24_prior_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.last_of_other(trades_ev(spark, sf_dir), "wallet_id", "market_id", "trade_id", order.ORDER).select("trade_id", "donor")


@query("SELECT conv_id, turn, role, i - 1 AS i, word FROM (SELECT conv_id, turn, role, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT *, string_split(coalesce(text, ''), ' ') AS w FROM conversations))")
def e25_posexplode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every text with its place."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    return c.select("conv_id", "turn", "role", F.posexplode(words).alias("i", "word")).withColumn("i", F.col("i").cast("bigint"))


@query(f"{EV}, a AS (SELECT wallet_id AS k, count(*) AS c FROM trades WHERE market_id < 5 GROUP BY 1), b AS (SELECT wallet_id AS k, count(*) AS c FROM trades WHERE market_id > 14 GROUP BY 1) SELECT count(*) FILTER (WHERE a.c IS NOT NULL AND b.c IS NOT NULL) AS matched, count(*) FILTER (WHERE b.c IS NULL) AS only_left, count(*) FILTER (WHERE a.c IS NULL) AS only_right, count(*) FILTER (WHERE a.c > 1) AS repeated_left, count(*) FILTER (WHERE b.c > 1) AS repeated_right FROM a FULL JOIN b USING (k)")
def e18_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    return order.coverage(t.where("market_id < 5"), t.where("market_id > 14"), "wallet_id")


@query("SELECT o_custkey, c_name, len(list(o_orderkey)) AS n, list(o_orderkey ORDER BY o_orderkey)[1] AS first_order, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def e01_e03_e07_nested_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("c_custkey", F.col("o_custkey"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    g = order.strict_join(o, c, "c_custkey").groupBy("o_custkey", "c_name").agg(F.count("o_orderkey").alias("n"), F.min("o_orderkey").alias("first_order"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.select("o_custkey", "c_name", "n", "first_order", "total")


# --- graph and splits ---------------------------------------------------------------------------

_EDGES = "edges AS (SELECT DISTINCT l_partkey AS a, 1000000 + l_suppkey * 10000 + CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) // 200 AS b FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and, of every line, the event of its supplier and period; components need no distinct edges."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))
    return li.select(F.col("l_partkey").alias("a"), (1000000 + F.col("l_suppkey") * 10000 + F.floor(days / 200)).alias("b"))


_COMPONENTS = f"""WITH RECURSIVE {_EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), c(node, component) USING KEY (node) AS (SELECT DISTINCT a AS node, a AS component FROM both_ways
  UNION (SELECT e.a, min(x.component) FROM c x JOIN both_ways e ON e.b = x.node JOIN recurring.c o ON o.node = e.a WHERE x.component < o.component GROUP BY e.a))"""


@query(f"{_COMPONENTS} SELECT node, component FROM c")
def k01_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(_edges(spark, sf_dir), "a", "b").select("node", "component")


@query(f"""{_COMPONENTS}, parts AS (SELECT component, string_agg(CAST(node AS VARCHAR), chr(10) ORDER BY CAST(node AS VARCHAR)) AS m, count(*) AS n FROM c GROUP BY component)
SELECT p_partkey, coalesce(sha256('event-component-v1' || chr(10) || parts.m), sha256('orphan-market-v1' || chr(10) || p_partkey)) AS component_id, coalesce(parts.n, 1) AS n_members FROM part LEFT JOIN c ON p_partkey = node LEFT JOIN parts USING (component)""")
def k02_k03_component_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component_ids(spark, sf_dir, _edges(spark, sf_dir))


def _component_ids(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    c = components.connected_components(edges, "a", "b")
    ids = components.stable_ids(c)
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    j = p.join(c, p["p_partkey"] == c["node"], "left").join(ids, "component", "left")
    return j.select("p_partkey", F.coalesce("component_id", components.orphan_id("p_partkey")).alias("component_id"), F.coalesce("n_members", F.lit(1)).alias("n_members"))


@query(f"{EV}, {RESOLUTIONS}, {SPLITS_SQL}, c AS (SELECT market_id % 6 AS component_id, max(resolution_ts) AS close_ts, count(*) AS markets, sum(CASE WHEN payout0 = 1 THEN 1 ELSE 0 END) AS ones FROM resolutions GROUP BY 1) SELECT component_id, close_ts, markets, CAST(ones AS BIGINT) AS ones, split FROM c LEFT JOIN splits ON close_ts >= start_ts AND close_ts < end_ts")
def k04_l02_f01_component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolutions(trades_ev(spark, sf_dir)).withColumn("component_id", F.col("market_id") % 6)
    c = r.groupBy("component_id").agg(F.max("resolution_ts").alias("close_ts"), F.count("*").alias("markets"), F.count_if(F.col("payout0") == 1).alias("ones"))
    s = splits(spark)
    return c.join(F.broadcast(s), (F.col("close_ts") >= F.col("start_ts")) & (F.col("close_ts") < F.col("end_ts")), "left").select("component_id", "close_ts", "markets", "ones", "split")


@query(f"{EV}, {RESOLUTIONS} SELECT t.trade_id, t.market_id FROM trades t JOIN resolutions r USING (market_id) WHERE t.timestamp_unix BETWEEN (SELECT min(timestamp_unix) FROM trades) + {DAY} AND r.resolution_ts")
def l05_d10_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    start = t.agg((F.min("timestamp_unix") + DAY).alias("s"))
    return t.join(resolutions(t), "market_id").join(F.broadcast(start)).where("timestamp_unix >= s and timestamp_unix <= resolution_ts").select("trade_id", "market_id")


@query(f"{EV}, {RESOLUTIONS} SELECT t.trade_id, CASE WHEN t.timestamp_unix < r.resolution_ts AND market_id % 3 <> 0 THEN payout0 END AS label, round(payout0 - price, 6) + 0.0 AS edge, round(payout0 - price - 0.005, 6) + 0.0 AS net_edge FROM trades t JOIN resolutions r USING (market_id)")
def d09_l03_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    j = t.join(resolutions(t), "market_id")
    return j.select("trade_id", F.when((F.col("timestamp_unix") < F.col("resolution_ts")) & (F.col("market_id") % 3 != 0), F.col("payout0")).alias("label"), F.round(F.col("payout0") - F.col("price"), 6).alias("edge"), F.round(F.col("payout0") - F.col("price") - 0.005, 6).alias("net_edge"))


# --- the feature pack ---------------------------------------------------------------------------


def pack_inputs(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """markets, wallet resolutions and actor deltas derived from trades."""
    m = t.groupBy("market_id", "component_id").agg(F.min("timestamp_unix").alias("created"), (F.max("timestamp_unix") - DAY * (F.col("market_id") % 5)).alias("end_ts"))
    m = m.withColumns({"neg_risk": (F.col("market_id") % 3 == 0).cast("int"), "unclosed": (F.col("market_id") % 4 == 0).cast("int")})
    r = _wallet_resolutions(t).select("wallet_id", "resolution_ts", (F.col("pnl") / 100).alias("edge"), "pnl")
    week = F.floor((F.col("timestamp_unix") - START) / (7 * DAY))
    buy, n = F.col("side") == "BUY", F.col("notional_usd")
    a = t.groupBy("wallet_id", (START + (week + 1) * 7 * DAY).cast("bigint").alias("available")).agg(
        F.count_if(F.col("outcome_index") == 0).alias("maker_fills"), F.count_if(F.col("outcome_index") == 1).alias("taker_fills"), F.count_if(buy).alias("buy_fills"), F.count_if(~buy).alias("sell_fills"),
        F.coalesce(F.sum(F.when(buy, n)), F.lit(0.0)).alias("buy_notional"), F.coalesce(F.sum(F.when(~buy, n)), F.lit(0.0)).alias("sell_notional"), F.countDistinct("market_id").alias("counterparties"), F.countDistinct("component_id").alias("assets"),
        F.avg("price").alias("average_price"), F.stddev_pop("price").alias("price_std"),
    )
    return m, r, features.actor_deltas(a)


@query()
def feature_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 128 features at the decisions of the adaptive cursor."""
    t = trades_ev(spark, sf_dir)
    return features.feature_pack(t, *pack_inputs(t), only=cursor.decisions(t))
