"""Queries of projections, parsing, decisions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.plans.catalog import query
from tideline.plans.views import TRADES_EV, trades_ev

EV = f"WITH {TRADES_EV} "


@query(EV + """SELECT trade_id, CASE WHEN (side = 'BUY') = (outcome_index = 0) THEN 1 ELSE -1 END AS direction,
  round(CASE WHEN outcome_index = 0 THEN price ELSE 1 - price END, 6) AS p0, CASE WHEN side = 'BUY' THEN 1 ELSE 0 END AS side_buy,
  round(CASE WHEN price > 0 AND price < 1 THEN CASE WHEN outcome_index = 0 THEN price ELSE 1 - price END END, 6) AS yes_price,
  (CASE side WHEN 'BUY' THEN 1 ELSE -1 END) * (CASE outcome_index WHEN 0 THEN 1 ELSE -1 END) AS yes_direction FROM trades""")
def c01_c04_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_ev(spark, sf_dir).select(
        "trade_id", S.direction().alias("direction"), F.round(S.probability0(), 6).alias("p0"), F.when(F.col("side") == "BUY", 1).otherwise(0).alias("side_buy"),
        F.round(S.yes_price(), 6).alias("yes_price"), S.yes_direction().alias("yes_direction"),
    )


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(event_type AS DECIMAL(28,12)), 0)::DOUBLE AS bad_number,
  coalesce(TRY_CAST(CAST(value AS VARCHAR) AS DECIMAL(28,12)), 0)::DOUBLE AS number,
  CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN NULL ELSE 0 END AS n_strings FROM events""")
def c05_c07_c22_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["a,1","'), "event_type", F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.lit('["a",1]')).otherwise(F.lit("[]"))
    n = S.string_list(text)
    return e.select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), S.decimal_or_zero("event_type").cast("double").alias("bad_number"),
        S.decimal_or_zero(F.col("value").cast("string")).cast("double").alias("number"), F.when(n.isNotNull(), F.size(n)).alias("n_strings"),
    )


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS unix, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text,
  CAST(epoch(date_trunc('week', ts)) AS BIGINT) AS week, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day FROM events""")
def c08_c09_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("u", F.unix_timestamp(F.col("ts").cast("timestamp")))
    text = S.format_utc(F.col("ts").cast("timestamp"))
    back = F.unix_timestamp(S.parse_utc(text))
    return e.select("event_id", back.alias("unix"), text.alias("text"), S.week_id("u").alias("week"), (F.floor(F.col("u") / 86400) * 86400).cast("bigint").alias("day"))


@query(EV + """, w AS (SELECT wallet_id, min(timestamp_unix) AS a, max(timestamp_unix) + 1 AS b FROM trades GROUP BY wallet_id)
SELECT wallet_id, greatest(a, CAST(epoch(m) AS BIGINT)) AS start_ts, least(b, CAST(epoch(m + INTERVAL 1 MONTH) AS BIGINT)) AS end_ts
FROM w, unnest(generate_series(date_trunc('month', make_timestamp(a * 1000000)), make_timestamp(b * 1000000), INTERVAL 1 MONTH)) AS g(m)
WHERE CAST(epoch(m) AS BIGINT) < b""")
def c10_month_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trades_ev(spark, sf_dir).groupBy("wallet_id").agg(F.min("timestamp_unix").alias("a"), (F.max("timestamp_unix") + 1).alias("b"))
    months = F.sequence(F.date_trunc("month", F.timestamp_seconds("a")), F.timestamp_seconds("b"), F.expr("interval 1 month"))
    w = w.withColumn("m", F.explode(months)).where(F.unix_timestamp("m") < F.col("b"))
    return w.select("wallet_id", F.greatest("a", F.unix_timestamp("m")).alias("start_ts"), F.least("b", F.unix_timestamp(F.col("m") + F.expr("interval 1 month"))).alias("end_ts"))


@query(EV + """SELECT trade_id, round(sin(2 * pi() * (timestamp_unix % 86400) / 86400), 6) + 0.0 AS day_sin, round(cos(2 * pi() * (timestamp_unix % 86400) / 86400), 6) + 0.0 AS day_cos,
  round(sin(2 * pi() * (timestamp_unix % 604800) / 604800), 6) + 0.0 AS week_sin, round(cos(2 * pi() * (timestamp_unix % 604800) / 604800), 6) + 0.0 AS week_cos,
  round(least(greatest((timestamp_unix - 1704067200) / 2592000.0, 0), 1), 6) AS elapsed, round(least(greatest((1706659200 - timestamp_unix) / 2592000.0, 0), 1), 6) AS remaining,
  round(least(greatest(ln(1 + size) / 12, 0), 1), 6) AS log_size, round(CASE WHEN size > 0 THEN notional_usd / size ELSE 0 END, 6) AS ratio FROM trades""")
def c11_c14_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("timestamp_unix")
    (ds, dc), (ws, wc) = S.phase(ts, 86400), S.phase(ts, 604800)
    elapsed, remaining = S.lifecycle(ts, F.lit(1704067200), F.lit(1706659200))
    named = {"day_sin": ds, "day_cos": dc, "week_sin": ws, "week_cos": wc, "elapsed": elapsed, "remaining": remaining, "log_size": S.clipped_log("size", 12), "ratio": S.safe_ratio("notional_usd", "size")}
    return trades_ev(spark, sf_dir).select("trade_id", *(F.round(v, 6).alias(k) for k, v in named.items()))


@query("""SELECT event_id, sha256(concat_ws('|', event_id, user_id, event_type)) AS id,
  '0x' || lpad(substr(sha256(CAST(event_id AS VARCHAR)), 1, 40), 64, '0') AS topic, '0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 40) AS address,
  substr(sha256('a' || event_id), 1, 64) AS word0 FROM events""")
def c15_c18_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    address = F.concat(F.lit("0x"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 40))
    data = F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("a"), "event_id"), 256), F.sha2(F.concat(F.lit("b"), "event_id"), 256))
    topic = S.address_topic(address)
    return e.select("event_id", S.stable_id("event_id", "user_id", "event_type").alias("id"), topic.alias("topic"), S.topic_address(topic).alias("address"), S.words(data)[0].alias("word0"))


@query(EV + """SELECT trade_id, CASE WHEN price < 0.5 THEN 'below_0_50' WHEN price < 0.7 THEN '0_50_to_0_70' WHEN price < 0.8 THEN '0_70_to_0_80'
  WHEN price < 0.9 THEN '0_80_to_0_90' WHEN price < 0.95 THEN '0_90_to_0_95' WHEN price < 0.98 THEN '0_95_to_0_98' ELSE 'at_least_0_98' END AS bin,
  round(ln(greatest(1 - 0.05 + 0.05 / price * outcome_index, 1e-8)), 6) + 0.0 AS utility, round(least(1, 1 / greatest(1 / price, 1e-8)), 6) AS break_even FROM trades""")
def c23_c24_c38_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    payout = 1 / F.col("price")
    return trades_ev(spark, sf_dir).select(
        "trade_id", S.price_bin("price").alias("bin"), F.round(S.log_utility(F.lit(0.05), payout, "outcome_index"), 6).alias("utility"), F.round(S.break_even(payout), 6).alias("break_even")
    )


_SCORES = "SELECT trade_id, price, (market_id * 37 + wallet_id * 11) % 101 / 100.0 - 0.4 AS m, (wallet_id * 7) % 13 / 10.0 - 0.6 AS q50, (market_id * 5 + wallet_id) % 17 / 10.0 - 0.5 AS q90 FROM trades"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir)
    return t.select("trade_id", "price", ((F.col("market_id") * 37 + F.col("wallet_id") * 11) % 101 / 100.0 - 0.4).alias("m"), (F.col("wallet_id") * 7 % 13 / 10.0 - 0.6).alias("q50"), ((F.col("market_id") * 5 + F.col("wallet_id")) % 17 / 10.0 - 0.5).alias("q90"))


@query(EV + f", s AS ({_SCORES}) " + " UNION ALL ".join(
    f"SELECT '{n}' AS gate, count(*) FILTER (WHERE {c}) AS kept, count(*) FILTER (WHERE NOT ({c})) AS vetoed, round(coalesce(avg(price) FILTER (WHERE {c}), 0), 6) AS kept_price FROM s"
    for n, c in (("all", "true"), ("mean_positive", "m > 1e-9"), ("median_nonnegative", "q50 >= -1e-9"), ("optimistic_nonnegative", "q90 >= -1e-9"), ("mean_or_median", "m > 1e-9 OR q50 >= -1e-9"), ("mean_or_optimistic", "m > 1e-9 OR q90 >= -1e-9"))
))
def c25_f08_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    gates = [F.struct(F.lit(g).alias("gate"), S.gate(g, F.col("m") - 1e-9, F.col("q50") + 1e-9, F.col("q90") + 1e-9).alias("keep")) for g in S.GATES]
    s = s.select("price", F.inline(F.array(*gates)))
    return s.groupBy("gate").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("vetoed"), F.round(F.coalesce(F.avg(F.when(F.col("keep"), F.col("price"))), F.lit(0.0)), 6).alias("kept_price"))


@query(EV + """, s AS (SELECT trade_id, (trade_id * 7) % 20 AS age, (trade_id * 31) % 1000 AS depth, (trade_id * 13) % 100 / 100.0 AS confidence,
  (trade_id * 3) % 13 / 100.0 AS ye, (trade_id * 5) % 11 / 100.0 AS ne, CASE trade_id % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' END AS held FROM trades)
SELECT trade_id, CASE WHEN age > 15 THEN 'SKIP' WHEN depth < 250 THEN 'SKIP' WHEN confidence < 0.7 THEN 'SKIP'
  WHEN held IS NOT NULL AND (CASE held WHEN 'YES' THEN ye ELSE ne END) < 0.01 THEN 'CLOSE' WHEN held IS NOT NULL THEN 'HOLD' WHEN ye >= 0.04 THEN 'BUY_YES' WHEN ne >= 0.04 THEN 'BUY_NO' ELSE 'SKIP' END AS action,
  CASE WHEN age > 15 THEN 'STALE_SIGNAL' WHEN depth < 250 THEN 'LOW_DEPTH' WHEN confidence < 0.7 THEN 'LOW_CONFIDENCE'
  WHEN held IS NOT NULL AND (CASE held WHEN 'YES' THEN ye ELSE ne END) < 0.01 THEN 'EDGE_GONE' WHEN held IS NOT NULL THEN 'EDGE_REMAINS' WHEN ye >= 0.04 THEN 'YES_EDGE' WHEN ne >= 0.04 THEN 'NO_EDGE' ELSE 'NO_NET_EDGE' END AS reason FROM s""")
def c26_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("trade_id")
    d = S.decide(i * 7 % 20, i * 31 % 1000, i * 13 % 100 / 100.0, i * 3 % 13 / 100.0, i * 5 % 11 / 100.0, F.when(i % 4 == 0, "YES").when(i % 4 == 1, "NO"))
    return trades_ev(spark, sf_dir).select("trade_id", d.alias("d")).select("trade_id", "d.action", "d.reason")


@query(EV + """, s AS (SELECT *, price - 0.5 AS e, outcome_index AS y, ln(price / (1 - price)) AS x FROM trades)
SELECT trade_id, round(CASE WHEN abs(e) < 0.25 THEN 0.5 * e * e / 0.25 ELSE abs(e) - 0.125 END, 6) AS huber,
  round((greatest(0.1 * e, -0.9 * e) + greatest(0.5 * e, -0.5 * e) + greatest(0.9 * e, -0.1 * e)) / 3, 6) AS pinball,
  round(greatest(x, 0) - x * y + ln(1 + exp(-abs(x))), 6) + 0.0 AS bce, round(-(y * ln(price) + (1 - y) * ln(1 - price)), 6) AS log_loss, round(1 / (1 + exp(-x)), 6) AS p,
  round(greatest(price, size, 0.3) - (price + size + 0.3 - greatest(price, size, 0.3) - least(price, size, 0.3)), 6) + 0.0 AS margin,
  round(exp(price - greatest(price, size, 0.3)) / (exp(price - greatest(price, size, 0.3)) + exp(size - greatest(price, size, 0.3)) + exp(0.3 - greatest(price, size, 0.3))), 6) AS first_share FROM s""")
def c28_c39_q10_q13_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, e = S.logit("price"), F.col("price") - 0.5
    three = [F.col("price"), F.col("size"), F.lit(0.3)]
    named = {"huber": S.huber(e, 0.25), "pinball": S.pinball(e), "bce": S.bce_with_logits(x, "outcome_index"), "log_loss": S.log_loss("price", "outcome_index"), "p": S.sigmoid(x), "margin": S.top_margin(F.array(*three)), "first_share": S.softmax(three)[0]}
    return trades_ev(spark, sf_dir).select("trade_id", *(F.round(v, 6).alias(k) for k, v in named.items()))


@query("""SELECT vec_id, embedding[1 + vec_id % 8]::DOUBLE AS chosen, list_position(embedding[1:8], list_max(embedding[1:8])) - 1 AS best FROM embeddings""")
def c29_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    head = F.slice("embedding", 1, 8)
    return e.select("vec_id", S.gather("embedding", (F.col("vec_id") % 8).cast("int")).cast("double").alias("chosen"), (F.array_position(head, F.array_max(head)) - 1).cast("int").alias("best"))


_RULES = {
    "bad_price": "price <= 0 OR price >= 1",
    "bad_size": "size <= 0",
    "bad_side": "side NOT IN ('BUY', 'SELL')",
    "bad_outcome": "outcome_index NOT IN (0, 1)",
    "bad_notional": "abs(notional_usd - size * price) > 1e-9",
    "bad_time": "timestamp_unix <= 0",
}


@query(EV + ", o AS (SELECT *, lag(timestamp_unix) OVER (PARTITION BY market_id ORDER BY timestamp_unix, trade_id) AS prev FROM trades) SELECT count(*) AS n_rows, count(DISTINCT trade_id) AS n_ids, count(*) FILTER (WHERE prev > timestamp_unix) AS n_regressions, "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _RULES.items()) + " FROM o")
def d12_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    t = trades_ev(spark, sf_dir).withColumn("prev", F.lag("timestamp_unix").over(W.partitionBy("market_id").orderBy("timestamp_unix", "trade_id")))
    return t.agg(F.count("*").alias("n_rows"), F.countDistinct("trade_id").alias("n_ids"), F.count_if(F.col("prev") > F.col("timestamp_unix")).alias("n_regressions"), *(F.count_if(F.expr(c)).alias(n) for n, c in _RULES.items()))


@query("""SELECT p_partkey, p_name FROM part WHERE p_size >= 10 AND regexp_full_match(p_brand, '[A-Za-z#0-9 ]+') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def d05_selected_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return p.where((F.col("p_size") >= 10) & F.col("p_brand").rlike("^[A-Za-z#0-9 ]+$")).join(li, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query(EV + """SELECT DISTINCT a.trade_id, a.wallet_id, a.market_id FROM trades a WHERE wallet_id % 10 = 3 OR market_id IN (SELECT market_id FROM trades GROUP BY market_id HAVING avg(price) > 0.5)""")
def d13_endpoint_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades_ev(spark, sf_dir).select("trade_id", "wallet_id", "market_id", "price")
    markets = t.groupBy("market_id").agg(F.avg("price").alias("a")).where("a > 0.5").select("market_id")
    one = t.where("wallet_id % 10 = 3")
    other = t.where("wallet_id % 10 <> 3").join(markets, "market_id", "left_semi").select(*t.columns)
    return one.unionByName(other).select("trade_id", "wallet_id", "market_id")
