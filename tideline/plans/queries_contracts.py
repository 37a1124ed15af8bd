"""Queries of contracts between tables: domains, coverage, bindings, receipts, lookups and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.operators import cursor, fees, order
from tideline.plans.catalog import query
from tideline.plans.queries_ledger import EV, LI, _HEART
from tideline.plans.shared import cut, new_folder, partitions
from tideline.plans.views import DAY, RESOLUTIONS, SPLITS_SQL, START, resolutions, splits, trades_ev, trades_li
from tideline.sources import ledgers
from tideline.streaming import live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# --- row contracts ------------------------------------------------------------------------------


@query(f"""{EV}, q AS (SELECT trade_id, price - 0.02 * (trade_id % 4 - 1) AS yb, price + 0.01 * (trade_id % 3) AS ya, size - 20 AS depth, trade_id % 50 - 2 AS seconds, price * 1.01 AS prob, (wallet_id % 13 - 1) / 11.0 AS conf FROM trades),
c AS (SELECT *, 1 - ya AS nb, 1 - yb AS na FROM q)
SELECT trade_id, concat_ws(',', CASE WHEN NOT yb BETWEEN 0 AND 1 THEN 'yes_bid' END, CASE WHEN NOT ya BETWEEN 0 AND 1 THEN 'yes_ask' END, CASE WHEN NOT nb BETWEEN 0 AND 1 THEN 'no_bid' END, CASE WHEN NOT na BETWEEN 0 AND 1 THEN 'no_ask' END,
  CASE WHEN NOT (yb <= ya AND nb <= na) THEN 'crossed' END, CASE WHEN depth < 0 THEN 'depth' END, CASE WHEN seconds < 0 THEN 'seconds' END, CASE WHEN NOT prob BETWEEN 0 AND 1 THEN 'probability' END, CASE WHEN NOT 1 - prob BETWEEN 0 AND 1 THEN 'flow' END, CASE WHEN NOT conf BETWEEN 0 AND 1 THEN 'confidence' END) AS broken FROM c""")
def c27_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the checks of states and signals each row breaks."""
    i = F.col("trade_id")
    t = trades_ev(spark, sf_dir).select(i, (F.col("price") - 0.02 * (i % 4 - 1)).alias("yb"), (F.col("price") + 0.01 * (i % 3)).alias("ya"), (F.col("size") - 20).alias("depth"), (i % 50 - 2).alias("seconds"), (F.col("price") * 1.01).alias("prob"), ((F.col("wallet_id") % 13 - 1) / F.lit(11.0)).alias("conf"))
    checks = S.state_checks(F.col("yb"), F.col("ya"), 1 - F.col("ya"), 1 - F.col("yb"), F.col("depth"), F.col("seconds")) | S.signal_checks(F.col("prob"), 1 - F.col("prob"), F.col("conf"))
    return t.select("trade_id", F.array_join(S.violations(checks), ",").alias("broken"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '["a", ' || user_id || ', null]' WHEN 1 THEN '{"k": 1}' WHEN 2 THEN 'no list' WHEN 3 THEN NULL ELSE '[]' END AS raw FROM events)
SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN json_array_length(raw) ELSE 0 END AS BIGINT) AS n, CASE WHEN event_id % 5 = 0 THEN json_extract_string(raw, '$[1]') END AS second FROM r""")
def c06_lenient_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists from text: what is no list is an empty one."""
    i = F.col("event_id") % 5
    raw = F.when(i == 0, F.concat(F.lit('["a", '), F.col("user_id").cast("string"), F.lit(", null]"))).when(i == 1, F.lit('{"k": 1}')).when(i == 2, F.lit("no list")).when(i == 4, F.lit("[]"))
    items = S.lenient_list(raw)
    return _events(spark, sf_dir).select("event_id", F.size(items).cast("bigint").alias("n"), F.get(items, F.lit(1)).alias("second"))


@query()
def c36_feature_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the raw floats of each vector with its head."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", S.row_digest(F.col("embedding").cast("array<float>"), F.lit("n1"), F.lit("2024-01-01"), F.col("vec_id")).alias("digest"))


@query(f"{EV}, x AS (SELECT trade_id, 1 / (1 + exp(-((wallet_id % 21 - 10) / 200.0) / 0.05)) AS keep, (outcome_index - price) / 4 AS u FROM trades) SELECT trade_id, round(keep, 9) AS keep, round(keep * greatest(-u, 0) * 2.0 + (1 - keep) * greatest(u, 0) * 0.5, 9) AS regret FROM x")
def q14_keep_and_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep, regret = S.keep_and_regret((F.col("wallet_id") % 21 - 10) / F.lit(200.0), (F.col("outcome_index") - F.col("price")) / 4, 0.05, 2.0, 0.5)
    return trades_ev(spark, sf_dir).select("trade_id", F.round(keep, 9).alias("keep"), F.round(regret, 9).alias("regret"))


@query(f"{EV}, w AS (SELECT trade_id, market_id, timestamp_unix AS a, timestamp_unix + 2 + 30 + 1 AS b FROM trades) SELECT trade_id, b AS covered_until, b <= {START + 10 * DAY} AS in_first FROM w")
def l08_fill_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end (exclusive) of the time a decision may be filled in, and whether the first schedule covers it."""
    until = F.col("timestamp_unix") + S.fill_horizon(2, 30)
    return trades_ev(spark, sf_dir).select("trade_id", until.alias("covered_until"), (until <= START + 10 * DAY).alias("in_first"))


# --- coverage, bindings, lookups ----------------------------------------------------------------


@query(f"{LI}, c AS (SELECT component_id, CASE WHEN max(timestamp_unix) % 3 = 0 THEN 'train' WHEN component_id % 7 <> 0 THEN 'test' END AS split FROM trades WHERE component_id % 11 <> 0 GROUP BY 1), m AS (SELECT DISTINCT market_id, component_id FROM trades) SELECT market_id, (SELECT split FROM c WHERE c.component_id = m.component_id) AS split FROM m")
def e05_splits_of_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every market takes the split of its component; null where the component has none or is missing."""
    t = trades_li(spark, sf_dir)
    c = t.where("component_id % 11 <> 0").groupBy("component_id").agg(F.max("timestamp_unix").alias("m"))
    c = c.select("component_id", F.when(F.col("m") % 3 == 0, "train").when(F.col("component_id") % 7 != 0, "test").alias("split"))
    return t.select("market_id", "component_id").distinct().join(c, "component_id", "left").select("market_id", "split")


@query(f"{EV} SELECT t.trade_id, e.vec_id IS NOT NULL AS found, round(CAST(e.embedding[1] AS DOUBLE), 6) AS terminal FROM trades t LEFT JOIN embeddings e ON e.vec_id = t.trade_id % 1009")
def e20_encoding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodings by the row number a decision points to; rows that are not there are reported."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    t = trades_ev(spark, sf_dir).select("trade_id", (F.col("trade_id") % 1009).alias("vec_id"))
    return t.join(e.withColumn("hit", F.lit(True)), "vec_id", "left").select("trade_id", F.coalesce("hit", F.lit(False)).alias("found"), F.round("x", 6).alias("terminal"))


@query(f"""{LI}, f AS (SELECT DISTINCT component_id FROM trades WHERE component_id % 10 < 7), s AS (SELECT DISTINCT component_id FROM trades WHERE component_id % 10 >= 6 AND component_id % 10 < 9),
x AS (SELECT timestamp_unix // {DAY} AS day, component_id IN (SELECT component_id FROM f) AS in_fit, component_id IN (SELECT component_id FROM s) AS in_selection FROM trades)
SELECT day, count(*) AS n, count(*) FILTER (in_fit) AS n_fit, count(*) FILTER (in_selection) AS n_selection, count(*) FILTER (in_fit = in_selection) AS uncovered FROM x GROUP BY 1""")
def e23_partition_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a day by membership of their component; a cover has each row on exactly one side."""
    t = trades_li(spark, sf_dir)
    r = F.col("component_id") % 10
    sides = t.select("component_id").distinct().select("component_id", (r < 7).alias("in_fit"), ((r >= 6) & (r < 9)).alias("in_selection"))
    x = t.select("component_id", F.floor(F.col("timestamp_unix") / DAY).alias("day")).join(sides, "component_id")
    return x.groupBy("day").agg(F.count("*").alias("n"), F.count_if("in_fit").alias("n_fit"), F.count_if("in_selection").alias("n_selection"), F.count_if(F.col("in_fit") == F.col("in_selection")).alias("uncovered"))


@query(f"""{EV}, d AS (SELECT CAST((timestamp_unix - {START}) // {DAY} AS VARCHAR) AS day, count(*) AS n, sha256(count(*) || '|' || CAST(sum(trade_id) AS BIGINT)) AS sha FROM trades GROUP BY 1),
a AS (SELECT count(*) AS days, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(day || ':' || sha || chr(10), '' ORDER BY day)) AS digest FROM d)
SELECT 'same' AS copy, days, n_rows, true AS bound FROM a UNION ALL SELECT 'changed', days, n_rows, false FROM a""")
def f38_replay_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether day receipts still give the digest chain, days and rows that an audit recorded; one receipt of the second copy is altered."""
    t = trades_ev(spark, sf_dir).withColumn("day", F.floor((F.col("timestamp_unix") - START) / DAY).cast("string"))
    receipts = cut(t.groupBy("day").agg(F.count("*").alias("n"), F.sum("trade_id").cast("bigint").alias("ids")).select("day", "n", F.sha2(F.concat_ws("|", "n", "ids"), 256).alias("sha")), "receipts")
    changed = receipts.withColumn("sha", F.when(F.col("day") == "3", F.sha2("sha", 256)).otherwise(F.col("sha")))
    return ledgers.bound(receipts, receipts).withColumn("copy", F.lit("same")).unionByName(ledgers.bound(changed, receipts).withColumn("copy", F.lit("changed"))).select("copy", "days", "n_rows", "bound")


@query("""WITH l AS (SELECT l_orderkey AS tx, l_partkey AS oh, l_returnflag, l_suppkey % 4 = 0 AS active, CASE WHEN l_suppkey % 3 = 0 THEN 'v1' ELSE 'v2' END AS protocol, CASE WHEN l_partkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, (l_partkey % 100) / 99.0::DOUBLE AS price, l_suppkey * 10 AS fee, o_orderstatus <> 'P' AS ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 3 <> 0),
r AS (SELECT l_orderkey AS tx, l_partkey AS oh, max(l_linenumber) AS refunded FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), j AS (SELECT l.*, refunded FROM l LEFT JOIN r USING (tx, oh)),
g AS (SELECT tx, bool_and(ok) AS ok, count(*) FILTER (active) AS n_active, count(*) AS n, max(oh) FILTER (active) AS oh, max(protocol) FILTER (active) AS protocol, max(side) FILTER (active) AS side, max(price) FILTER (active) AS price, max(coalesce(refunded, fee)) FILTER (active) AS fee_raw, max(refunded) FILTER (active) AS refunded FROM j GROUP BY 1),
p AS (SELECT *, CASE WHEN NOT ok THEN 'failed' WHEN n_active <> 1 THEN 'active' WHEN NOT (price > 0 AND price < 1) THEN 'price' END AS problem FROM g)
SELECT tx AS transaction_hash, problem, CASE WHEN problem IS NULL THEN oh END AS order_hash, CASE WHEN problem IS NULL THEN CASE WHEN protocol = 'v1' AND side = 'BUY' THEN 'OUTCOME' ELSE 'COLLATERAL' END END AS fee_asset, CASE WHEN problem IS NULL THEN fee_raw END AS fee_raw, CASE WHEN problem IS NULL THEN refunded IS NOT NULL END AS refunded, CASE WHEN problem IS NULL THEN greatest(1, n - 1) END AS maker_fills FROM p""")
def m07_receipt_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one active fill of each receipt with its fee after refunds; receipts with none or several say so."""
    li, od = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    logs = li.where("l_partkey % 3 <> 0").join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("transaction_hash"), p.alias("order_hash"), (s % 4 == 0).alias("active"), F.when(s % 3 == 0, "v1").otherwise("v2").alias("protocol"), F.when(p % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (p % 100 / F.lit(99.0)).alias("price"), (s * 10).alias("fee_raw"), (F.col("o_orderstatus") != "P").alias("succeeded"),
    )
    refunds = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("transaction_hash"), p.alias("order_hash"), F.col("l_linenumber").alias("refunded_raw"))
    return fees.active_fills(logs, refunds)


@query(f"{EV} SELECT trade_id, timestamp_unix, market_id, price, timestamp_unix < {START + 20 * DAY} AND price < 0.99 AS label_mask FROM trades")
def b13_masked_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that rewrites one column; the others are read from the files as they are."""
    t = trades_ev(spark, sf_dir).select("trade_id", "timestamp_unix", "market_id", "price").withColumn("label_mask", F.lit(True))
    return t.withColumn("label_mask", (F.col("timestamp_unix") < START + 20 * DAY) & (F.col("price") < 0.99))


@query("""WITH first AS (SELECT o_custkey AS k, arg_min(o_orderstatus, o_orderkey) AS payload FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1)
SELECT c_custkey AS key, first.k IS NOT NULL AS hit, coalesce(first.payload, 'fetched-' || c_custkey) AS payload FROM customer LEFT JOIN first ON k = c_custkey""")
def b14_lookup_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache as a table: the first payload of a key stays, misses are filled by the source."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey % 4 <> 0")
    held = o.groupBy(F.col("o_custkey").alias("key")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("payload"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"))
    return c.join(held, "key", "left").select("key", F.col("payload").isNotNull().alias("hit"), F.coalesce("payload", F.concat(F.lit("fetched-"), "key")).alias("payload"))


@query(f"{EV} SELECT DISTINCT w.wallet_id, EXISTS (SELECT 1 FROM trades t WHERE t.wallet_id = w.wallet_id AND t.price > 0.97) AS matched FROM trades w")
def i11_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any row of a key matches: a semi-join, which needs no more than the first."""
    t = trades_ev(spark, sf_dir)
    hit = t.where("price > 0.97").select("wallet_id").distinct().withColumn("hit", F.lit(True))
    return t.select("wallet_id").distinct().join(hit, "wallet_id", "left").select("wallet_id", F.coalesce("hit", F.lit(False)).alias("matched"))


@query(f"""{EV}, f AS (SELECT *, size * (trade_id % 3) / 2.0 AS filled, size * (trade_id % 3) / 2.0 * (outcome_index - price) AS pnl FROM trades)
SELECT count(*) AS orders, count(*) FILTER (filled > 0) AS fills, count(*) FILTER (filled = 0) AS cancelled, count(*) FILTER (filled > 0 AND filled < size) AS partial, round(sum(filled * price), 2) AS cost, round(sum(pnl), 2) AS profit,
  round(sum(CASE WHEN pnl > 0 THEN pnl END) / -sum(CASE WHEN pnl < 0 THEN pnl END), 6) AS profit_factor, round(count(*) FILTER (pnl > 0) / count(*) FILTER (pnl <> 0)::DOUBLE, 6) AS hit_rate FROM f""")
def n06_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and results of a replay's audit table."""
    filled = F.col("size") * (F.col("trade_id") % 3) / 2
    t = trades_ev(spark, sf_dir).withColumn("filled", filled).withColumn("pnl", F.col("filled") * (F.col("outcome_index") - F.col("price")))
    f, pnl = F.col("filled"), F.col("pnl")
    return t.agg(
        F.count("*").alias("orders"), F.count_if(f > 0).alias("fills"), F.count_if(f == 0).alias("cancelled"), F.count_if((f > 0) & (f < F.col("size"))).alias("partial"), F.round(F.sum(f * F.col("price")), 2).alias("cost"), F.round(F.sum(pnl), 2).alias("profit"),
        F.round(F.sum(F.when(pnl > 0, pnl)) / -F.sum(F.when(pnl < 0, pnl)), 6).alias("profit_factor"), F.round(F.count_if(pnl > 0) / F.count_if(pnl != 0), 6).alias("hit_rate"),
    )


@query("""WITH r AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, value, user_id FROM events), m AS (SELECT DISTINCT k, sha256('market|' || k) AS market_key FROM r WHERE k % 7 <> 0)
SELECT event_id, m.market_key, concat_ws(',', CASE WHEN m.market_key IS NULL THEN 'market' END, CASE WHEN NOT coalesce(value > 1, false) THEN 'value' END, CASE WHEN NOT coalesce(event_type IN ('purchase', 'click', 'view'), false) THEN 'type' END, CASE WHEN NOT coalesce(user_id % 50 <> 0, false) THEN 'user' END) AS errors FROM r LEFT JOIN m USING (k)""")
def c02_mapped_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the key their market maps to, and all fields that are wrong by name."""
    r = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    m = r.where("k % 7 <> 0").select("k").distinct().withColumn("market_key", S.stable_id(F.lit("market"), "k"))
    checks = {"market": F.col("market_key").isNotNull(), "value": F.col("value") > 1, "type": F.col("event_type").isin("purchase", "click", "view"), "user": F.col("user_id") % 50 != 0}
    return r.join(m, "k", "left").select("event_id", "market_key", F.array_join(S.violations(checks), ",").alias("errors"))


@query(f"{EV}, {RESOLUTIONS}, {SPLITS_SQL}, e AS (SELECT market_id % 6 AS component_id, max(resolution_ts) AS latest, count(*) AS markets FROM resolutions WHERE market_id % 4 <> 0 GROUP BY 1) SELECT component_id, latest, markets, split FROM e LEFT JOIN splits ON latest >= start_ts AND latest < end_ts")
def l04_event_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of an event is that of its latest eligible resolution; null in an embargo."""
    r = resolutions(trades_ev(spark, sf_dir)).where("market_id % 4 <> 0").groupBy((F.col("market_id") % 6).alias("component_id")).agg(F.max("resolution_ts").alias("latest"), F.count("*").alias("markets"))
    return r.join(F.broadcast(splits(spark)), (F.col("latest") >= F.col("start_ts")) & (F.col("latest") < F.col("end_ts")), "left").select("component_id", "latest", "markets", "split")


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'status' AS kind, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'lines', CAST(n AS VARCHAR), count(*) FROM c GROUP BY 2 UNION ALL SELECT 'orders', 'all', count(*) FROM orders""")
def f29_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of statuses and of multiplicities, and the number of sources."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    values = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority")), ("orders", F.lit("all")))))
    return o.select(F.inline(values)).unionByName(n.select(F.lit("lines").alias("kind"), F.col("n").cast("string").alias("value"))).groupBy("kind", "value").agg(F.count("*").alias("n"))


@query(f"{EV}, {RESOLUTIONS}, {SPLITS_SQL} SELECT split, count(*) AS n, count(DISTINCT market_id) AS markets, max(resolution_ts - timestamp_unix) AS longest, count(*) FILTER (timestamp_unix > resolution_ts) AS after_close FROM trades JOIN resolutions USING (market_id) LEFT JOIN splits ON timestamp_unix >= start_ts AND timestamp_unix < end_ts GROUP BY 1")
def f30_horizon_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by split: how many, of how many markets, and how far before the resolution."""
    t = trades_ev(spark, sf_dir)
    j = t.join(resolutions(t), "market_id").join(F.broadcast(splits(spark)), (F.col("timestamp_unix") >= F.col("start_ts")) & (F.col("timestamp_unix") < F.col("end_ts")), "left")
    wait = F.col("resolution_ts") - F.col("timestamp_unix")
    return j.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("market_id").alias("markets"), F.max(wait).alias("longest"), F.count_if(wait < 0).alias("after_close"))


@query(f"""{EV}, s AS (SELECT *, (timestamp_unix - {START}) // {DAY} AS shard, row_number() OVER (PARTITION BY (timestamp_unix - {START}) // {DAY} ORDER BY timestamp_unix, trade_id) - 1 AS k FROM trades),
p AS (SELECT shard, k, market_id + CASE WHEN trade_id % 97 = 0 THEN 1 ELSE 0 END AS market_id, timestamp_unix, price * 0.9 AS predicted FROM s)
SELECT shard, count(*) AS n, count(*) FILTER (s.market_id <> p.market_id OR s.timestamp_unix <> p.timestamp_unix) AS mismatches, round(avg(predicted), 6) AS mean FROM s JOIN p USING (shard, k) GROUP BY 1""")
def e21_bound_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined to examples by shard and row, with the metadata of both compared."""
    t = trades_ev(spark, sf_dir).withColumn("shard", F.floor((F.col("timestamp_unix") - START) / DAY))
    s = t.withColumn("k", F.row_number().over(W.partitionBy("shard").orderBy(*order.ORDER)) - 1)
    p = s.select("shard", "k", (F.col("market_id") + (F.col("trade_id") % 97 == 0).cast("int")).alias("p_market"), F.col("timestamp_unix").alias("p_ts"), (F.col("price") * 0.9).alias("predicted"))
    wrong = (F.col("market_id") != F.col("p_market")) | (F.col("timestamp_unix") != F.col("p_ts"))
    return s.join(p, ["shard", "k"]).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(wrong).alias("mismatches"), F.round(F.avg("predicted"), 6).alias("mean"))


@query(f"""{EV}, s AS (SELECT (timestamp_unix - {START}) // {DAY} AS shard, count(*) AS n, count(price) AS prices, count(size) AS sizes, count(*) FILTER (NOT (price > 0 AND price <= 1)) AS bad_prices, count(*) FILTER (size <= 20) AS bad_sizes, count(*) FILTER (side NOT IN ('BUY', 'SELL')) AS bad_codes, sha256(count(*) || '|' || CAST(sum(trade_id) AS BIGINT)) AS sha FROM trades GROUP BY 1)
SELECT shard, n = prices AND n = sizes AS aligned, bad_prices, bad_sizes, bad_codes, sha = CASE WHEN shard % 10 = 4 THEN sha256(sha) ELSE sha END AS intact FROM s""")
def f36_shard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, domains and recorded hash of each day's shard; the record of every tenth is wrong."""
    t = trades_ev(spark, sf_dir).groupBy(F.floor((F.col("timestamp_unix") - START) / DAY).alias("shard")).agg(
        F.count("*").alias("n"), F.count("price").alias("prices"), F.count("size").alias("sizes"), F.count_if(~((F.col("price") > 0) & (F.col("price") <= 1))).alias("bad_prices"), F.count_if(F.col("size") <= 20).alias("bad_sizes"),
        F.count_if(~F.col("side").isin("BUY", "SELL")).alias("bad_codes"), F.sum("trade_id").cast("bigint").alias("ids"),
    )
    sha = F.sha2(F.concat_ws("|", "n", "ids"), 256)
    recorded = F.when(F.col("shard") % 10 == 4, F.sha2(sha, 256)).otherwise(sha)
    return t.select("shard", ((F.col("n") == F.col("prices")) & (F.col("n") == F.col("sizes"))).alias("aligned"), "bad_prices", "bad_sizes", "bad_codes", (sha == recorded).alias("intact"))


# --- sources and sinks --------------------------------------------------------------------------

_LINE = "trade_id bigint, timestamp_unix bigint, wallet_id bigint, side string"
_LINES_SQL = f"{EV} SELECT trade_id, timestamp_unix, wallet_id, side FROM trades"


def _lines(spark: SparkSession, sf_dir: str) -> str:
    folder = new_folder(spark, "lines")
    ledgers.write_json_lines(trades_ev(spark, sf_dir).select("trade_id", "timestamp_unix", "wallet_id", "side"), folder, 20_000)
    return folder


@query(_LINES_SQL)
def a01_b01_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as compressed JSON lines, read back strictly."""
    return ledgers.read_json_lines(spark, _lines(spark, sf_dir), _LINE)


@query(f"{EV} SELECT count(*) AS n, count(*) AS n_parsed FROM trades")
def a03_a04_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines counted without parsing, beside parsed rows."""
    folder = _lines(spark, sf_dir)
    counted = ledgers.line_counts(spark, folder).agg(F.sum("rows").alias("n"))
    parsed = ledgers.read_json_lines(spark, folder, _LINE).agg(F.count("*").alias("n_parsed"))
    return counted.join(parsed).select("n", "n_parsed")  # one row each


@query(f"{EV} SELECT (timestamp_unix - {START}) // {DAY} AS day, count(*) AS n, min(trade_id) AS first_id FROM trades WHERE timestamp_unix >= {START + 5 * DAY} AND timestamp_unix < {START + 9 * DAY} GROUP BY 1")
def a19_b03_b04_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades written by day and read for a range of dates: other days' files are not opened."""
    folder = new_folder(spark, "days")
    ledgers.write_days(trades_ev(spark, sf_dir).select("trade_id", "timestamp_unix"), folder)
    t = spark.read.parquet(folder).where("date >= date'2024-01-06' and date < date'2024-01-10'")
    return t.groupBy(F.floor((F.col("timestamp_unix") - START) / DAY).alias("day")).agg(F.count("*").alias("n"), F.min("trade_id").alias("first_id"))


@query("SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def a09_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-only catalog tables as temporary views, asked in SQL."""
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"catalog_{name}")
    return spark.sql("SELECT r_name, n_name FROM catalog_nation JOIN catalog_region ON n_regionkey = r_regionkey")


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def a07_column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column and the key of a wide shard: the scan reads no other."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(f"{EV} SELECT count(*) AS n, 64 AS digest_chars FROM trades")
def b06_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of written files, and the rows that these files hold."""
    folder = _lines(spark, sf_dir)
    m = ledgers.manifest(spark, folder).where("bytes > 0").agg(F.max(F.length("sha256")).alias("digest_chars"), F.countDistinct("name").alias("files"))
    return spark.read.text(folder).agg(F.count("*").alias("n")).join(m).where("files > 0").select("n", "digest_chars")  # one row each


@query("""WITH r AS (SELECT event_type AS record_type, event_id AS record_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id) AS prev FROM events)
SELECT record_type, count(*) AS n, min(t) AS first_ts, max(t) AS last_ts, count(*) FILTER (prev > t) AS back FROM r GROUP BY 1""")
def b07_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _events(spark, sf_dir).select(F.col("event_type").alias("record_type"), F.col("event_id").alias("record_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp_unix"))
    a = ledgers.audit_counts(r)
    return a.toDF("record_type", "n", "first_ts", "last_ts", "repeated", "back").drop("repeated")


@query(f"{EV}, f AS (SELECT (timestamp_unix - {START}) // {DAY} AS day, max(timestamp_unix) AS m FROM trades GROUP BY 1), n AS (SELECT max(timestamp_unix) AS now FROM trades) SELECT CAST(DATE '2024-01-01' + CAST(day AS INTEGER) AS DATE) AS date FROM f, n WHERE day < (now - {START}) // {DAY} AND m <= now - 300")
def b12_settled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that are over and quiet, as seen at the ledger's last second."""
    t = trades_ev(spark, sf_dir)
    now = t.agg(F.max("timestamp_unix")).first()[0]
    return ledgers.settled_days(t.select(F.to_date(F.timestamp_seconds("timestamp_unix")).alias("date"), F.col("timestamp_unix").alias("modified_unix")), now)


# --- streams ------------------------------------------------------------------------------------


def _stream_folder(df: DataFrame, what: str, files: int) -> str:
    folder = new_folder(df.sparkSession, what)
    df.repartition(files).write.json(folder)
    return folder


@query("""SELECT event_type AS record_type, i - 1 AS message_item_index, CAST(event_id * 10 + i AS VARCHAR) AS item, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour FROM (SELECT *, unnest(range(1, event_id % 3 + 2)) AS i FROM events)""")
def b05_o01_o02_item_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a stream of files: items exploded with their index, appended by hour of receipt, read back."""
    i = F.col("event_id")
    ms = (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).alias("received_at_ms")
    payload = F.to_json(F.transform(F.sequence(F.lit(1), i % 3 + 1), lambda k: (i * 10 + k).cast("string")))
    messages = _events(spark, sf_dir).select(ms, F.col("event_type").alias("record_type"), F.lit("feed").alias("source"), payload.alias("payload"))
    folder, out, state = _stream_folder(messages, "messages", 4), new_folder(spark, "hours"), new_folder(spark, "stream-state")
    live.append_hours(live.explode_items(live.read_messages(spark, folder, 2)), out, state).awaitTermination()
    return spark.read.parquet(out).select("record_type", F.col("message_item_index").cast("bigint").alias("message_item_index"), "item", "date", F.col("hour").cast("int").alias("hour"))


@query(_HEART.replace("SELECT component_id, trade_id, timestamp_unix, n, CASE", "SELECT component_id, trade_id, n, CASE"))
def o05_stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision cursor over days as they come: runs of five days, each starting from the state of the one before.

    A run's files are one micro-batch, whatever their number, so days need neither one file nor one task.
    """
    t = trades_ev(spark, sf_dir).select("component_id", "trade_id", "timestamp_unix")
    day = F.floor((F.col("timestamp_unix") - START) / DAY)
    inbox, out, state = (new_folder(spark, x) for x in ("days", "decisions", "stream-state"))
    for first in range(0, 30, 5):
        five = day < 5 if first == 0 else day >= 25 if first == 25 else (day >= first) & (day < first + 5)
        t.where(five).repartition(partitions(spark), "component_id").write.mode("append").json(inbox)
        rows = live.decisions(spark.readStream.schema(t.schema).json(inbox))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("component_id", "trade_id", "n", F.col("reasons")[0].alias("reason"))


@query(f"""{EV}, a AS (SELECT DISTINCT market_id FROM trades WHERE timestamp_unix < {START + 3 * DAY} AND wallet_id % 9 = 0), b AS (SELECT DISTINCT market_id FROM trades WHERE timestamp_unix >= {START + 3 * DAY} AND timestamp_unix < {START + 3 * DAY + 7200})
SELECT 'add' AS change, market_id FROM b WHERE market_id NOT IN (SELECT market_id FROM a) UNION ALL SELECT 'remove', market_id FROM a WHERE market_id NOT IN (SELECT market_id FROM b)""")
def o03_subscription_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fresh snapshot of a catalog adds to and removes from the subscriptions."""
    t, at = trades_ev(spark, sf_dir), START + 3 * DAY
    before = t.where((F.col("timestamp_unix") < at) & (F.col("wallet_id") % 9 == 0))
    after = t.where((F.col("timestamp_unix") >= at) & (F.col("timestamp_unix") < at + 7200))
    return live.subscription_changes(before, after, "market_id")


@query(f"SELECT event_type AS source, {(START + 30 * DAY) * 1000} - CAST(floor(epoch(max(ts))) AS BIGINT) * 1000 <= 120000 AS healthy FROM events GROUP BY 1")
def o04_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _events(spark, sf_dir).select(F.col("event_type").alias("source"), (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1000).alias("received_at_ms"))
    return live.healthy(s, (START + 30 * DAY) * 1000)
